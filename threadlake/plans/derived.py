"""Derived tables that are written once per state of their sources and read by every query after that.

A table is built on first use into the shared folder, under a name made of its sources' files (names, sizes and times):
when a source changes, its name does, and the table is built anew. Within the shared folder of a cluster the tables
outlive the session. ``forget`` deletes them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from threadlake import storage
from threadlake.session import shared_folder

#: Raised when a table's content is defined otherwise.
VERSION = 1


def _state(spark: SparkSession, root: str, sources: Sequence[str]) -> str:
    lines = [f"{VERSION}|{root.rstrip('/')}"]
    for name in sources:
        lines += [f"{name}|{f}" for f in storage.files(spark, f"{root.rstrip('/')}/{name}.parquet")]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:24]


def derived(spark: SparkSession, root: str, name: str, sources: Sequence[str], build: Callable[[], DataFrame], partition: str | None = None) -> DataFrame:
    """The table ``name`` of a folder of tables, built from ``sources`` unless it already is. A query that fails leaves no half table: the last step is a rename."""
    path = f"{shared_folder(spark)}/derived/{name}-{_state(spark, root, sources)}"
    if not storage.exists(spark, path):
        new, df = f"{path}.{uuid.uuid4().hex}", build()
        writer = df.write.partitionBy(partition) if partition else df.write
        writer.parquet(new)
        storage.rename(spark, new, path)
    return spark.read.parquet(path)


def forget(spark: SparkSession) -> None:
    storage.delete(spark, f"{shared_folder(spark)}/derived")
