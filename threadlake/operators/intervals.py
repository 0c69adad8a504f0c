"""Merging of overlapping, nested and touching intervals, and the gaps between them.

1. ``session_window`` with a row-specific duration merges the overlapping intervals that start in the same cell of
   time of an entity, so that an entity with a third of all rows is spread over its cells.
2. What is left is merged across cells: the latest end before a cell comes from a summary with one row per
   (entity, cell), the latest end before a period within its cell from a window over that cell. A period opens where
   its start lies beyond that end; a start equal to it touches and is joined.
3. A period ends at the latest end before the next opening (``lead``), which is also where its gap begins.

Defined results: intervals with a null entity, start or end, or of no positive length, are left out; repeated rows
change nothing; times are longs of any unit and size (those outside Spark's timestamps skip step 1, which is only a
reduction); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Milliseconds that are surely valid as timestamps (year 9999) and as interval seconds.
_SAFE_MS = 253_402_300_000_000


def _premerged(rows: DataFrame) -> DataFrame:
    safe = "start between 0 and {0} and finish <= {0}".format(_SAFE_MS)
    length = F.make_interval(secs=((F.col("finish") - F.col("start")).cast("decimal(18,0)") / F.lit(1000).cast("decimal(5,0)")).cast("decimal(18,6)"))
    merged = (
        rows.filter(safe)
        .select("entity", "cell", F.timestamp_millis("start").alias("at"), length.alias("length"))
        .groupBy("entity", "cell", F.session_window("at", F.col("length")))
        .agg(F.lit(1).alias("_"))
        .select("entity", "cell", F.unix_millis("session_window.start").alias("start"), F.unix_millis("session_window.end").alias("finish"))
    )
    return merged.unionByName(rows.filter(f"not ({safe})"))


def periods(intervals: DataFrame, entity: str, start: str, end: str, cell: int = 86_400_000) -> DataFrame:
    """Columns: entity, start, end, next_start (null for an entity's last period)."""
    rows = (
        intervals.select(F.col(entity).alias("entity"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("finish"))
        .filter("entity is not null and start is not null and finish > start")
        .withColumn("cell", F.floor(F.col("start") / F.lit(cell)).cast("long"))
    )
    parts = _premerged(rows)
    ends = parts.groupBy("entity", "cell").agg(F.max("finish").alias("finish"))
    by_cell = W.partitionBy("entity").orderBy("cell")
    before = ends.select("entity", "cell", F.max("finish").over(by_cell.rowsBetween(W.unboundedPreceding, -1)).alias("carried"), F.max("finish").over(W.partitionBy("entity")).alias("very_end"))
    within = W.partitionBy("entity", "cell").orderBy("start", "finish")
    opened = (
        parts.join(before, ["entity", "cell"])
        .withColumn("reached", F.greatest("carried", F.max("finish").over(within.rowsBetween(W.unboundedPreceding, -1))))
        .filter("reached is null or start > reached")
    )
    firsts = opened.groupBy("entity", "cell").agg(F.min(F.struct("start", "reached")).alias("head"))
    heads = firsts.select("entity", "cell", F.lead("head").over(by_cell).alias("head"))
    nxt = F.coalesce(F.lead(F.struct("start", "reached")).over(within), F.col("head"))
    return (
        opened.join(heads, ["entity", "cell"])
        .withColumn("nxt", nxt)
        .select(F.col("entity").alias(entity), F.col("start").alias(start), F.coalesce("nxt.reached", "very_end").alias(end), F.col("nxt.start").alias("next_start"))
    )


def periods_and_gaps(intervals: DataFrame, entity: str, start: str, end: str, cell: int = 86_400_000) -> DataFrame:
    """Columns: entity, what ('period' or 'gap'), start, end."""
    p = periods(intervals, entity, start, end, cell)
    gap = F.struct(F.lit("gap").alias("what"), F.col(end).alias(start), F.col("next_start").alias(end))
    period = F.struct(F.lit("period").alias("what"), F.col(start), F.col(end))
    return p.select(entity, F.inline(F.when(F.col("next_start").isNull(), F.array(period)).otherwise(F.array(period, gap))))
