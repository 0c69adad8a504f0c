"""Streams (an extension: the batch engine needs none). Watermarks bound their state; what comes later is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake import storage
from threadlake.functions.mri import clean_mri
from threadlake.operators import changefeed


def session_counts(messages: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each sender of a stream of messages: sender, start, end, n. Copies of a row within ``late`` count once."""
    rows = messages.filter("not coalesce(is_system, false) and ts > 0 and sender_mri is not null").select("conv_id", "id", clean_mri(F.col("sender_mri")).alias("sender"), F.timestamp_millis("ts").alias("at"))
    once = rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["conv_id", "id"])
    return once.groupBy("sender", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("sender", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def daily_counts(messages: DataFrame, late: str = "2 days") -> DataFrame:
    rows = messages.filter("not coalesce(is_system, false) and ts > 0").select(F.timestamp_millis("ts").alias("at"))
    return rows.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "n")


def apply_feed(stream: DataFrame, folder: str, checkpoint: str, keep: tuple[str, ...] = ()):
    """Keep the state of a change feed up to a stream of store entries: each batch is merged into the next version.

    ``changefeed.live_records`` of the latest version is the table. A version's folder is named by its batch, so a batch
    that is run again after a failure writes the same version; the version before the last is deleted. A batch reads
    and writes the state, whose size is that of the keys, not of the feed.
    """
    columns = ["cache_id", "entry_key", "seq", "op_type", "version", *keep]

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*columns)
        base = spark.read.parquet(f"{folder}/v{n - 1}") if n else new.limit(0)
        changefeed.merge(base, new, keep=list(keep)).write.mode("overwrite").parquet(f"{folder}/v{n}")
        if n > 1:
            storage.delete(spark, f"{folder}/v{n - 2}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
