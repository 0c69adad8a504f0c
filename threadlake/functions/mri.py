"""Member ids (MRIs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_mri(mri: Column) -> Column:
    """Trimmed of surrounding white space, in lower case."""
    return F.lower(F.regexp_replace(mri, r"(?U)^\s+|\s+$", ""))


def is_person(mri: Column) -> Column:
    """True for a person (prefix ``8:`` after cleaning); null counts as no person."""
    return F.coalesce(clean_mri(mri).startswith("8:"), F.lit(False))


def is_bot(mri: Column) -> Column:
    return F.coalesce(clean_mri(mri).startswith("28:"), F.lit(False))
