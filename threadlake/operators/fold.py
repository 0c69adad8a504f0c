"""Version folds: one row per key by a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (case apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep, per ``keys``, the row that is highest by ``order`` (descending, nulls last).

    Written as ``row_number() == 1``: Spark puts a WindowGroupLimit before the shuffle, so a key that
    holds a third of all rows sends one row per map task. Rows tie only if ``order`` isn't total.
    """
    w = W.partitionBy(*keys).orderBy(*[o.desc_nulls_last() for o in order])
    rank = unused(df, "_rank")
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank)


def kept_messages(messages: DataFrame) -> DataFrame:
    """One row per (conv_id, id): the highest version (null is 0), then the highest row_no.

    Rows without conv_id are left out; a null id counts as a key of its own value (one null id per conversation).
    """
    rows = messages.filter(F.col("conv_id").isNotNull())
    return latest(rows, ["conv_id", "id"], [F.coalesce(F.col("version"), F.lit(0)), F.col("row_no")])
