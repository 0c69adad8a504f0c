"""Snapshots of a cache's log: last writer wins, buckets, sequence caps, and fingerprints of its layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.operators.fold import latest, unused


def winners(entries: DataFrame, cap: int | None = None) -> DataFrame:
    """Per (cache_id, entry_key), the entry of the highest seq; of equal seqs the first in canonical order.

    Canonical order: tables (.ldb) before logs (.log), each by name, then place in the file. With ``cap``, entries
    above that seq are as if never written. Deletes win like puts and are still there.
    """
    rows = entries.filter("cache_id is not null and entry_key is not null and seq is not null")
    if cap is not None:
        rows = rows.filter(F.col("seq") <= cap)
    log = F.coalesce(F.col("file"), F.lit("")).endswith(".log").cast("int")
    w = W.partitionBy("cache_id", "entry_key").orderBy(F.desc("seq"), log, "file", "entry_ord", "entry_id")
    rank = unused(rows, "_rank")
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank)


def live(entries: DataFrame, cap: int | None = None) -> DataFrame:
    return winners(entries, cap).filter("op_type <> 0")


def buckets(entries: DataFrame) -> DataFrame:
    """cache_id, db_id, os_id, entity, records (alive), max_seq (deletes counted)."""
    return winners(entries).groupBy("cache_id", "db_id", "os_id", "entity").agg(F.count_if(F.col("op_type") != 0).alias("records"), F.max("seq").alias("max_seq"))


def normal_db(name: Column) -> Column:
    """A database name without ids, numbers and locale."""
    n = F.regexp_replace(name, r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<guid>")
    n = F.regexp_replace(n, r":[a-z]{2}-[a-zA-Z]{2,4}$", ":<locale>")
    n = F.regexp_replace(n, r":\d+(?=:|$)", ":<n>")
    return F.regexp_replace(n, r"_\d+_", "_<n>_")


def normal_version(version: Column) -> Column:
    """Digits of a mapping version as three numbers; null where there are none."""
    v = F.regexp_extract(F.trim(F.lower(version)), r"^v?(\d+(?:\.\d+)*)$", 1)
    parts = F.split(v, r"\.")
    padded = F.slice(F.concat(F.transform(parts, lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")), F.array(F.lit("0"), F.lit("0"))), 1, 3)
    return F.when(v != "", F.array_join(padded, "."))


def fingerprints(files: DataFrame) -> DataFrame:
    """cache_id, file_no, version, hash: the layout's hash over sorted (db, store, fields) with normal names.

    One row per file: of repeated rows the highest row_no.
    """
    rows = latest(files.filter("cache_id is not null and file_no is not null"), ["cache_id", "file_no"], [F.col("row_no")])
    parts = F.array_sort(F.transform("stores", lambda s: F.concat_ws("|", normal_db(s["db"]), s["store"], F.array_join(F.array_sort(F.array_distinct(s["fields"])), ","))))
    return rows.select("cache_id", "file_no", normal_version(F.col("mapping_version")).alias("version"), F.substring(F.sha2(F.array_join(F.coalesce(parts, F.array().cast("array<string>")), ";"), 256), 1, 16).alias("hash"))


def layout_changes(files: DataFrame) -> DataFrame:
    """cache_id, file_no, old_version, new_version, layout_changed of files that differ from the one before."""
    w = W.partitionBy("cache_id").orderBy("file_no")
    rows = fingerprints(files).withColumn("old_version", F.lag("version").over(w)).withColumn("old_hash", F.lag("hash").over(w))
    changed = rows.filter(F.col("old_hash").isNotNull() & ((F.col("old_hash") != F.col("hash")) | ~F.col("old_version").eqNullSafe(F.col("version"))))
    return changed.select("cache_id", "file_no", "old_version", F.col("version").alias("new_version"), (F.col("old_hash") != F.col("hash")).alias("layout_changed"))
