"""Queries on conversations, messages, people, calls and events, as functions with parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.functions.text import clip, conversation_kind, handle, strip_tags
from threadlake.plans import silver


def contains(column: Column | str, part: str) -> Column:
    """Case-insensitive substring test; % and _ stand for themselves."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.contains(F.lower(c), F.lower(F.lit(part))), F.lit(False))


# Conversations


def conv_list(spark: SparkSession, root: str, kind: str | None = None, query: str | None = None, since: int | None = None, include_empty: bool = False, limit: int | None = None) -> DataFrame:
    """Conversations, newest first: id, handle, kind, msg_count, participant_count, last_ts, participant_names."""
    rows = silver.folded(spark, root)
    found = silver.conversations(spark, root, rows).join(silver.participant_names(spark, root, rows=rows).withColumnRenamed("conv_id", "id"), "id", "left").withColumn("participant_names", F.coalesce("participant_names", F.lit("")))
    if not include_empty:
        found = found.filter("msg_count > 0")
    if kind:
        found = found.filter(F.col("kind") == kind)
    if query:
        found = found.filter(contains("participant_names", query))
    if since is not None:
        found = found.filter(F.col("last_ts") >= since)
    return found.orderBy(F.desc("last_ts"), "id").limit(limit) if limit else found


def conv_resolve(spark: SparkSession, root: str, selector: str) -> DataFrame:
    """Conversations a selector names: a handle (c:...) or part of the participants' names."""
    found = conv_list(spark, root, include_empty=True)
    return found.filter(F.col("handle") == selector) if selector.startswith("c:") else found.filter(contains("participant_names", selector))


def largest_conversation(spark: SparkSession, root: str) -> str:
    """The id of the conversation with most rows; one row comes to the driver."""
    row = silver.messages(spark, root, "conv_id").groupBy("conv_id").count().orderBy(F.desc("count"), "conv_id").first()
    return row["conv_id"] if row else ""


# Messages


def page(spark: SparkSession, root: str, conv_id: str, before: tuple[int, str] | None = None, since: int | None = None, until: int | None = None, limit: int = 50) -> DataFrame:
    """The last ``limit`` rows of a conversation before a cursor (ts, id), oldest first."""
    rows = silver.messages(spark, root, "conv_id", "id", "ts", "sender", "content", "is_system").filter((F.col("conv_id") == conv_id) & ~F.col("is_system"))
    if since is not None:
        rows = rows.filter(F.col("ts") >= since)
    if until is not None:
        rows = rows.filter(F.col("ts") < until)
    if before:
        rows = rows.filter((F.col("ts") < before[0]) | ((F.col("ts") == before[0]) & (F.col("id") < before[1])))
    return rows.drop("is_system").orderBy(F.desc("ts"), F.desc("id")).limit(limit).orderBy("ts", "id")


def around(spark: SparkSession, root: str, conv_id: str, ts: int, limit: int = 20) -> DataFrame:
    """Half of ``limit`` rows up to a time and as many after it."""
    rows = silver.messages(spark, root, "conv_id", "id", "ts", "sender", "is_system").filter((F.col("conv_id") == conv_id) & ~F.col("is_system")).drop("is_system")
    half = limit // 2
    older = rows.filter(F.col("ts") <= ts).orderBy(F.desc("ts"), F.desc("id")).limit(half)
    newer = rows.filter(F.col("ts") > ts).orderBy("ts", "id").limit(half)
    return older.unionByName(newer)


def threads(spark: SparkSession, root: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """conv_id, root_id, n, last_ts of each thread."""
    rows = silver.messages(spark, root, "conv_id", "id", "root_id", "ts", "is_system").filter("not is_system")
    if since is not None:
        rows = rows.filter(F.col("ts") >= since)
    if until is not None:
        rows = rows.filter(F.col("ts") < until)
    return rows.groupBy("conv_id", "root_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


def thread(spark: SparkSession, root: str, conv_id: str, root_id: str) -> DataFrame:
    rows = silver.messages(spark, root, "conv_id", "id", "root_id", "ts", "sender", "is_system")
    return rows.filter((F.col("conv_id") == conv_id) & (F.col("root_id") == root_id) & ~F.col("is_system")).drop("is_system")


def conv_stats(spark: SparkSession, root: str) -> DataFrame:
    """conv_id, n, first_ts, last_ts over rows that aren't system rows; times above 0 only."""
    rows = silver.messages(spark, root, "conv_id", "ts", "is_system").filter("not is_system")
    good = F.when(F.col("ts") > 0, F.col("ts"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min(good).alias("first_ts"), F.max(good).alias("last_ts"))


def coverage(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    rows = silver.messages(spark, root, "ts", "is_system", "kind").filter("not is_system and ts > 0")
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    return rows.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def substring_search(spark: SparkSession, root: str, text: str, kind: str | None = None, sender: str | None = None, exclude: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Messages that hold a text: conv_id, id, ts, sender, snippet (120 code points). An empty text browses all.

    ``exclude`` takes handles of conversations (c:) and people (p:), and words.
    """
    rows = silver.messages(spark, root, "conv_id", "id", "ts", "sender", "content", "kind", "sender_name", "is_system").filter("not is_system")
    if text:
        rows = rows.filter(contains("content", text))
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if sender:
        rows = rows.filter(handle("p:", F.col("sender")) == sender) if sender.startswith("p:") else rows.filter(contains("sender_name", sender))
    for x in exclude:
        if x.startswith("c:"):
            rows = rows.filter(handle("c:", F.col("conv_id")) != x)
        elif x.startswith("p:"):
            rows = rows.filter(handle("p:", F.col("sender")) != x)
        else:
            rows = rows.filter(~contains("content", x))
    found = rows.select("conv_id", "id", "ts", "sender", clip(strip_tags(F.col("content")), 120).alias("snippet"))
    return found.orderBy(F.desc("ts"), F.desc("id")).limit(limit) if limit else found


# People


def people_find(spark: SparkSession, root: str, query: str | None = None, limit: int | None = None) -> DataFrame:
    """People with their profiles: mri, handle, display (message name, else profile name), org, msg_count, last_ts."""
    prof = silver.profiles(spark, root).select("mri", F.col("name").alias("profile_name"), "org")
    found = silver.people(spark, root).join(prof, "mri", "left").withColumn("display", F.coalesce(F.nullif("name", F.lit("")), F.nullif("profile_name", F.lit(""))))
    if query:
        found = found.filter(F.col("handle") == query) if query.startswith("p:") else found.filter(contains("display", query))
    found = found.select("mri", "handle", "display", "org", "msg_count", "last_ts")
    return found.orderBy(F.desc("msg_count"), "mri").limit(limit) if limit else found


def name_for(spark: SparkSession, root: str, ids: DataFrame, mri: str = "mri") -> DataFrame:
    """``ids`` with ``label``: name in messages, else in profiles, else null."""
    a = silver.people(spark, root).select(F.col("mri").alias("_m"), F.nullif("name", F.lit("")).alias("_n1"))
    b = silver.profiles(spark, root).select(F.col("mri").alias("_p"), F.nullif("name", F.lit("")).alias("_n2"))
    return ids.join(a, ids[mri] == F.col("_m"), "left").join(b, ids[mri] == F.col("_p"), "left").withColumn("label", F.coalesce("_n1", "_n2")).drop("_m", "_n1", "_p", "_n2")


# Calls and events


def call_list(spark: SparkSession, root: str, participant: str | None = None, limit: int | None = None) -> DataFrame:
    """Calls that aren't deleted: id, start_ts, duration_ms, label. A multi-party call is labelled with its conversation's handle."""
    from threadlake.functions.mri import clean_mri

    rows = silver.calls(spark, root).filter("not coalesce(is_deleted, false)").select("id", "start_ts", "duration_ms", "call_type", "group_thread_id", clean_mri(F.col("counterpart_mri")).alias("mri"))
    named = name_for(spark, root, rows)
    multi = (F.col("call_type") == "MultiParty") & F.col("group_thread_id").isNotNull()
    found = named.select("id", "start_ts", "duration_ms", F.when(multi, handle("c:", F.col("group_thread_id"))).otherwise(F.coalesce("label", F.lit("(unknown)"))).alias("label"))
    if participant:
        found = found.filter(contains("label", participant))
    return found.orderBy(F.desc("start_ts"), "id").limit(limit) if limit else found


def event_list(spark: SparkSession, root: str, text: str | None = None, attendee: str | None = None, since: int | None = None, until: int | None = None, cancelled: bool = False, limit: int | None = None) -> DataFrame:
    """Events by start: id, subject, start_ts, end_ts, n_attendees, n_accepted."""
    rows = silver.events(spark, root)
    if not cancelled:
        rows = rows.filter("not coalesce(is_cancelled, false)")
    if since is not None:
        rows = rows.filter(F.col("start_ts") >= since)
    if until is not None:
        rows = rows.filter(F.col("start_ts") < until)
    if text:
        rows = rows.filter(contains("subject", text))
    if attendee:
        rows = rows.filter(F.exists("attendees", lambda a: contains(a["n"], attendee) | contains(a["e"], attendee)))
    people = F.coalesce("attendees", F.array().cast("array<struct<n:string,e:string,r:string>>"))
    found = rows.select("id", F.coalesce("subject", F.lit("")).alias("subject"), "start_ts", "end_ts", F.size(people).alias("n_attendees"), F.size(F.filter(people, lambda a: F.coalesce(F.lower(a["r"]) == "accepted", F.lit(False)))).alias("n_accepted"))
    return found.orderBy("start_ts", "id").limit(limit) if limit else found


def series_collapse(spark: SparkSession, root: str, least: int = 3) -> DataFrame:
    """Series with ``least`` events or more as one row: series_id, first_start, n_more, next_start. Others keep their rows."""
    rows = silver.events(spark, root).filter("not coalesce(is_cancelled, false) and start_ts > 0").withColumn("series", F.coalesce("series_id", F.concat(F.lit("single:"), "id")))
    # Only the first rows of a series are ranked (limited before the shuffle); its size is a count that combines map-side.
    sizes = rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("rn", F.row_number().over(W.partitionBy("series").orderBy("start_ts", "id"))).filter(F.col("rn") <= max(2, least - 1))
    second = first.filter("rn = 2").select("series", F.col("start_ts").alias("next_start"))
    marked = first.join(sizes, "series").filter((F.col("n") < least) | (F.col("rn") == 1)).join(second, "series", "left")
    return marked.select("id", "series", "start_ts", F.when(F.col("n") >= least, F.col("n") - 1).otherwise(0).alias("n_more"), F.when(F.col("n") >= least, F.col("next_start")).alias("next_start"))


def digest(spark: SparkSession, root: str, budget: int = 40, whole: int = 5, shown: int = 4) -> DataFrame:
    """Per conversation, its latest threads whose cost fits the budget (always one): conv_id, root_id, n, used."""
    rows = threads(spark, root).withColumn("cost", F.when(F.col("n") <= whole, F.col("n")).otherwise(shown))
    # A thread costs one at least, so no more than ``budget`` of a conversation can fit: they are ranked first (limited before the shuffle), then summed.
    w = W.partitionBy("conv_id").orderBy(F.desc("last_ts"), F.desc("root_id"))
    few = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max(1, budget))
    return few.withColumn("used", F.sum("cost").over(w.rowsBetween(W.unboundedPreceding, 0))).filter((F.col("used") <= budget) | (F.col("rn") == 1)).select("conv_id", "root_id", "n", "used")


def bursts(spark: SparkSession, root: str, gap: int = 900_000) -> DataFrame:
    """Messages of a conversation that open a burst: another sender than the row before, or more than ``gap`` after it.

    conv_id, id, sender, ts, burst (its number). Windows run within days of a conversation; the row before a day comes
    from the day before it that has rows, the bursts before it from a sum over days.
    """
    rows = silver.messages(spark, root, "conv_id", "id", "sender", "ts", "is_system").filter("not is_system").withColumn("day", F.floor(F.col("ts") / 86_400_000))
    days = rows.groupBy("conv_id", "day").agg(F.max(F.struct("ts", "id", "sender")).alias("last"))
    by = W.partitionBy("conv_id").orderBy("day")
    carried = days.select("conv_id", "day", F.lag("last").over(by).alias("carried"))
    w = W.partitionBy("conv_id", "day").orderBy("ts", "id")
    before = F.coalesce(F.lag(F.struct("ts", "id", "sender")).over(w), F.col("carried"))
    opened = rows.join(carried, ["conv_id", "day"]).withColumn("before", before).filter(F.col("before").isNull() | (F.col("before.sender") != F.col("sender")) | (F.col("ts") - F.col("before.ts") > gap))
    from threadlake.operators.ordering import ordinals

    return ordinals(opened.select("conv_id", "id", "sender", "ts"), ["conv_id"], "ts", ["id"], name="burst").select("conv_id", "id", "sender", "ts", "burst")


def attendee_summary(spark: SparkSession, root: str) -> DataFrame:
    """id, names (three at most), more: the people among an event's attendees, rooms left out."""
    rows = silver.events(spark, root)
    people = F.filter(F.coalesce("attendees", F.array().cast("array<struct<n:string,e:string,r:string>>")), lambda a: F.coalesce(a["n"], a["e"]).isNotNull())
    names = F.array_sort(F.transform(people, lambda a: F.coalesce(a["n"], a["e"])))
    return rows.select("id", F.array_join(F.slice(names, 1, 3), "; ").alias("names"), F.greatest(F.size(names) - 3, F.lit(0)).alias("more"))


def reaction_counts(spark: SparkSession, root: str) -> DataFrame:
    """conv_id, id, key, n, first_ts: reactions by key, empty groups dropped."""
    rows = silver.messages(spark, root, "conv_id", "id", "reactions").select("conv_id", "id", F.inline("reactions"))
    kept = rows.filter("k is not null and size(u) > 0")
    return kept.groupBy("conv_id", "id", F.col("k").alias("key")).agg(F.sum(F.size("u")).alias("n"), F.min(F.array_min(F.transform("u", lambda x: x["ts"]))).alias("first_ts"))


def missing_conversations(spark: SparkSession, root: str) -> DataFrame:
    """Conversations documents speak of that hold no messages: conv_id, kind."""
    from threadlake.tables import table

    spoken = table(spark, root, "documents").filter("conv_id is not null").select("conv_id").distinct()
    return spoken.join(silver.messages(spark, root, "conv_id").distinct(), "conv_id", "left_anti").select("conv_id", conversation_kind(F.col("conv_id")).alias("kind"))


def replies_with_root(spark: SparkSession, root: str) -> DataFrame:
    """Replies beside their roots: conv_id, id, root_id, delay_ms, to_self."""
    rows = silver.messages(spark, root, "conv_id", "id", "root_id", "ts", "sender", "is_system").filter("not is_system")
    roots = rows.select("conv_id", F.col("id").alias("root_id"), F.col("ts").alias("root_ts"), F.col("sender").alias("root_sender"))
    return rows.filter("root_id <> id").join(roots, ["conv_id", "root_id"]).select("conv_id", "id", "root_id", (F.col("ts") - F.col("root_ts")).alias("delay_ms"), (F.col("sender") == F.col("root_sender")).alias("to_self"))


def coparticipants(spark: SparkSession, root: str) -> DataFrame:
    """People who wrote in conversations the owner wrote in, without the owner: sender, n."""
    rows = silver.messages(spark, root, "conv_id", "sender", "is_system", "is_mine").filter("not is_system")
    mine = rows.filter("is_mine").select("conv_id").distinct()
    return rows.filter("not is_mine").join(mine, "conv_id", "left_semi").groupBy("sender").agg(F.count(F.lit(1)).alias("n"))
