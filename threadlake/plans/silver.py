"""The shaped tables all queries read: one row per message, person, event and call, with defaults in place of nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.functions.mri import clean_mri
from threadlake.functions.text import conversation_kind, handle
from threadlake.operators.fold import kept_messages, latest
from threadlake.plans.derived import derived
from threadlake.tables import table


SHAPED = ("conv_id", "id", "row_no", "version", "ts", "sender", "sender_name", "kind", "is_mine", "is_system", "has_attach", "mentions_me", "content", "reactions", "root_id")


def _shape_messages(spark: SparkSession, root: str) -> DataFrame:
    kept = kept_messages(table(spark, root, "messages"))
    shaped = {
        "conv_id": F.col("conv_id"), "id": F.col("id"), "row_no": F.col("row_no"), "version": F.coalesce("version", F.lit(0)), "ts": F.coalesce("ts", F.lit(0)),
        "sender": F.coalesce(clean_mri(F.col("sender_mri")), F.lit("?")), "sender_name": F.coalesce("sender_name", F.lit("")), "kind": conversation_kind(F.col("conv_id")),
        "is_mine": F.coalesce("is_mine", F.lit(False)), "is_system": F.coalesce("is_system", F.lit(False)), "has_attach": F.coalesce("has_attach", F.lit(False)), "mentions_me": F.coalesce("mentions_me", F.lit(False)),
        "content": F.coalesce("content", F.lit("")), "reactions": F.col("reactions"), "root_id": F.coalesce("root_id", "id"),
    }
    return kept.select(*[shaped[c].alias(c) for c in SHAPED])


def messages(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """One row per message: ``SHAPED``, or some of them. Folded and shaped once, then read with its columns pruned and filters pushed down."""
    rows = derived(spark, root, "messages", ["messages"], lambda: _shape_messages(spark, root))
    return rows.select(*columns) if columns else rows


def profiles(spark: SparkSession, root: str) -> DataFrame:
    """The current profile of each MRI; rows without an MRI or a name are skipped."""
    rows = table(spark, root, "profiles").withColumn("mri", clean_mri(F.col("mri"))).filter("mri is not null and coalesce(name, '') <> ''")
    return latest(rows, ["mri"], [F.col("row_no")])


def events(spark: SparkSession, root: str) -> DataFrame:
    return latest(table(spark, root, "calendar_events").filter("id is not null"), ["id"], [F.col("row_no")])


def calls(spark: SparkSession, root: str) -> DataFrame:
    return latest(table(spark, root, "calls").filter("id is not null"), ["id"], [F.col("row_no")])


def folded(spark: SparkSession, root: str) -> DataFrame:
    """The columns the derived tables need."""
    return messages(spark, root, "conv_id", "id", "ts", "sender", "sender_name", "is_system", "is_mine")


def people(spark: SparkSession, root: str, rows: DataFrame | None = None) -> DataFrame:
    """Senders of messages that aren't system rows: mri, handle, name (of the latest message), msg_count, last_ts.

    Here and below, ``rows`` may be the result of ``folded``.
    """
    said = (rows or messages(spark, root, "id", "ts", "sender", "sender_name", "is_system", "conv_id")).filter("not is_system")
    found = said.groupBy("sender").agg(F.max_by("sender_name", F.struct("ts", "id", "conv_id")).alias("name"), F.count(F.lit(1)).alias("msg_count"), F.max("ts").alias("last_ts"))
    return found.select(F.col("sender").alias("mri"), handle("p:", F.col("sender")).alias("handle"), "name", "msg_count", "last_ts")


def self_mri(spark: SparkSession, root: str, rows: DataFrame | None = None) -> str | None:
    """The owner: most frequent sender among the rows sent by the owner (equal: the first by MRI). One row comes to the driver."""
    row = (rows or messages(spark, root, "sender", "is_mine")).filter("is_mine and sender <> '?'").groupBy("sender").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sender").first()
    return row["sender"] if row else None


def conversations(spark: SparkSession, root: str, rows: DataFrame | None = None) -> DataFrame:
    """id, handle, kind, msg_count, participant_count, last_ts of each conversation with rows."""
    rows = rows or messages(spark, root, "conv_id", "ts", "sender", "is_system")
    counted = rows.groupBy("conv_id").agg(
        F.count_if(~F.col("is_system")).alias("msg_count"),
        F.coalesce(F.max(F.when(~F.col("is_system"), F.col("ts"))), F.lit(0)).alias("last_ts"),
        F.count_distinct(F.when(~F.col("is_system"), F.col("sender"))).alias("participant_count"),
    )
    return counted.select(F.col("conv_id").alias("id"), handle("c:", F.col("conv_id")).alias("handle"), conversation_kind(F.col("conv_id")).alias("kind"), "msg_count", "participant_count", "last_ts")


def participant_names(spark: SparkSession, root: str, most: int = 5, rows: DataFrame | None = None) -> DataFrame:
    """conv_id, participant_names: the latest ``most`` named speakers besides the owner, joined with a comma."""
    rows = rows or folded(spark, root)
    me = self_mri(spark, root, rows)
    said = rows.filter("not is_system")
    spoke = said.filter(F.col("sender") != F.lit(me or "")).groupBy("conv_id", "sender").agg(F.max("ts").alias("last_ts"))
    named = spoke.join(people(spark, root, rows).select(F.col("mri").alias("sender"), "name").filter("name <> ''"), "sender")
    ranked = named.withColumn("rn", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("last_ts"), "sender"))).filter(F.col("rn") <= most)
    return ranked.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]), ", ").alias("participant_names"))
