"""Queries of the general data-processing problems (p2, p4, p5, p6, p7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions.mri import clean_mri, is_person
from threadlake.operators import changefeed, drift, intervals, ledger, sessions
from threadlake.operators.fold import kept_messages
from threadlake.session import scratch
from threadlake.tables import table

#: More than this between two messages of a sender starts a new session.
SESSION_GAP_MS = 1_800_000


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return drift.changes(table(spark, root, "raw_records"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    kept = kept_messages(table(spark, root, "messages").select("row_no", "conv_id", "id", "version", "ts", "sender_mri", "is_system"))
    said = kept.filter("not coalesce(is_system, false) and ts > 0").filter(is_person(F.col("sender_mri"))).select(clean_mri(F.col("sender_mri")).alias("sender_mri"), "ts", "conv_id")
    return sessions.sessions(said, "sender_mri", "ts", SESSION_GAP_MS, distinct="conv_id").withColumnsRenamed({"n_events": "n_messages", "n_distinct": "n_convs"})


def busy_intervals(spark: SparkSession, root: str) -> DataFrame:
    """owner_mri, start_ts, end_ts of events that stand and calls that are not deleted."""
    events = table(spark, root, "calendar_events").filter("not coalesce(is_cancelled, false)").select("owner_mri", "start_ts", "end_ts")
    calls = table(spark, root, "calls").filter("not coalesce(is_deleted, false)").select("owner_mri", "start_ts", F.expr("try_add(start_ts, duration_ms)").alias("end_ts"))
    return events.unionByName(calls).filter("owner_mri is not null and start_ts > 0").withColumn("owner_mri", clean_mri(F.col("owner_mri"))).filter("owner_mri <> ''")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return intervals.periods_and_gaps(busy_intervals(spark, root), "owner_mri", "start_ts", "end_ts")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return ledger.pending_entries(table(spark, root, "store_entries"), table(spark, root, "refresh_states"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return changefeed.live_records(table(spark, root, "store_entries")).select("cache_id", "entry_key", "seq")


def p6_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Runs of a ledger over the entries as they arrive: run (1 to 4), cache_id, n of the records it processed.

    Three arrivals (by thirds of the time they landed in), the second run once failing before its commit and then run
    again, and a last run that finds nothing: each record is processed once, late ones below the highest number too.
    """
    entries = table(spark, root, "store_entries").filter("cache_id is not null and seq is not null")
    at = F.unix_micros(F.col("landed_at").cast("timestamp"))
    span = entries.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    first, last = span["a"] or 0, span["b"] or 0
    book = ledger.Ledger(spark, scratch(spark, "ledger"), ["cache_id"])
    done = []
    for n, part in enumerate((1, 2, 2, 3, 3), 1):
        seen = entries.filter(F.coalesce(at, F.lit(first)) <= first + (last - first) * part // 3).select("cache_id", "seq").distinct()
        if n == 2:
            try:
                book.run(seen, _fail)
            except RuntimeError:
                continue
        done.append(book.run(seen, lambda df: df))
    runs = [spark.read.parquet(f"{book.root}/{name}/output").groupBy("cache_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).cast("int").alias("run"), "cache_id", "n") for i, name in enumerate(done, 1)]
    return reduce(DataFrame.unionByName, runs)


def _fail(df: DataFrame) -> DataFrame:
    raise RuntimeError("lost before the commit")


QUERIES = {"p6_ledger": p6_ledger, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found}
