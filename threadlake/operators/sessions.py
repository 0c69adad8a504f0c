"""Sessions of activity, by start-end pairing.

A session of an entity is a longest run of events in which no event comes more than ``gap`` after the one before.

Plan, made for entities that hold a third of all rows:

1. Events are summed per (entity, cell), a cell being ``gap`` wide. Two events of a cell are nearer than ``gap``, so
   only a cell's first and last event can be a start or an end. The sum combines map-side, and an entity has at most
   (time span / gap) cells, however many events it has: that bounds every later per-entity window.
2. RANGE frames over the first and last events find those with no event in the ``gap`` before them (starts) and none
   in the ``gap`` after them (ends).
3. Starts and ends are numbered apart and joined on equal rank; the number of events is the difference of their
   running counts.

Defined results: rows with a null entity or time are left out (no session); equal times fall in one session; an event
exactly ``gap`` after the last one stays in its session; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.session import cut


def sessions(events: DataFrame, entity: str, ts: str, gap: int, distinct: str | None = None) -> DataFrame:
    """Columns: entity, start_ts, end_ts, n_events and, with ``distinct``, n_distinct of that column (nulls not counted)."""
    cell = (F.col("ts") - F.pmod(F.col("ts"), F.lit(gap))).alias("cell")
    rows = events.select(F.col(entity).alias("entity"), F.col(ts).cast("long").alias("ts"), *([F.col(distinct).alias("item")] if distinct else []))
    rows = rows.filter("entity is not null and ts is not null")
    keys = ["entity", "cell"] + (["item"] if distinct else [])
    # Written once, as the steps below read it three times: small beside the events where they are dense.
    fine = rows.select("*", cell).groupBy(*keys).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    fine = cut(fine)
    cells = fine.groupBy("entity", "cell").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")) if distinct else fine

    # Both ends of each cell as points; the later one carries no count.
    later = F.when(F.col("last") > F.col("first"), F.array(F.struct(F.col("last").alias("ts"), F.lit(0).cast("long").alias("n"))))
    points = cells.select("entity", "cell", F.inline(F.concat(F.array(F.struct(F.col("first").alias("ts"), "n")), F.coalesce(later, F.array().cast("array<struct<ts:bigint,n:bigint>>")))))
    by = W.partitionBy("entity").orderBy("ts")
    run = by.rowsBetween(W.unboundedPreceding, 0)
    flagged = (
        points.withColumn("is_start", F.count(F.lit(1)).over(by.rangeBetween(-gap, -1)) == 0)
        .withColumn("is_end", F.count(F.lit(1)).over(by.rangeBetween(1, gap)) == 0)
        .withColumn("upto", F.sum("n").over(run))
        .withColumn("start_rank", F.sum(F.col("is_start").cast("long")).over(run))
        .withColumn("end_rank", F.sum(F.col("is_end").cast("long")).over(run))
    )
    starts = flagged.filter("is_start").select("entity", F.col("start_rank").alias("rank"), F.col("ts").alias("start_ts"), (F.col("upto") - F.col("n")).alias("before"))
    ends = flagged.filter("is_end").select("entity", F.col("end_rank").alias("rank"), F.col("ts").alias("end_ts"), "upto")
    paired = starts.join(ends, ["entity", "rank"]).select("entity", "rank", "start_ts", "end_ts", (F.col("upto") - F.col("before")).alias("n_events"))
    if not distinct:
        return paired.select(F.col("entity").alias(entity), "start_ts", "end_ts", "n_events")
    # All events of a cell lie in one session: its rank is that of the cell's first point.
    where = flagged.groupBy("entity", "cell").agg(F.min("start_rank").alias("rank"))
    items = fine.filter("item is not null").join(where, ["entity", "cell"]).groupBy("entity", "rank").agg(F.count_distinct("item").alias("n_distinct"))
    return paired.join(items, ["entity", "rank"], "left").select(F.col("entity").alias(entity), "start_ts", "end_ts", "n_events", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))
