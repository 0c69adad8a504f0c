"""Answers to readers: selectors with reasons when they miss, scoped search, pages with cursors, windows and notes.

An ``Answer`` holds a DataFrame and what must be known before it is shown. Selectors (handles, titles, parts of names)
stay DataFrames and are joined; only single rows come to the driver (whether anything matches, the last row of a page).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.functions.text import clip, elide_urls, html_to_text, strip_tags
from threadlake.plans import chat, silver

DAY = 86_400_000


@dataclass(frozen=True)
class Answer:
    """``rows`` is None where a selector names nothing: ``miss`` then says which kind, ``value`` what was asked for."""

    rows: DataFrame | None
    miss: str | None = None
    value: str | None = None
    total: int | None = None
    older: str | None = None
    notes: tuple[str, ...] = ()


# Selectors


def conversations_of(spark: SparkSession, root: str, selector: str) -> DataFrame:
    """id, handle, title, last_ts of the conversations that a handle (c:...) or a part of title or participants names."""
    found = chat.conv_list(spark, root, include_empty=True).select("id", "handle", F.col("participant_names").alias("title"), "last_ts")
    return found.filter(F.col("handle") == selector) if selector.startswith("c:") else found.filter(chat.contains("title", selector))


def people_of(spark: SparkSession, root: str, selector: str) -> DataFrame:
    """mri of the people that a handle (p:...) or a part of the name names."""
    found = silver.people(spark, root)
    return (found.filter(F.col("handle") == selector) if selector.startswith("p:") else found.filter(chat.contains("name", selector))).select("mri")


def _scope(spark: SparkSession, root: str, rows: DataFrame, conversation: str | None, sender: str | None, exclude: Sequence[str]) -> Answer:
    if conversation is not None:
        ids = conversations_of(spark, root, conversation).select(F.col("id").alias("conv_id"))
        if not ids.take(1):
            return Answer(None, "no-such-conversation", conversation)
        rows = rows.join(ids, "conv_id", "left_semi")
    if sender is not None:
        mris = people_of(spark, root, sender).select(F.col("mri").alias("sender"))
        if not mris.take(1):
            return Answer(None, "no-such-sender", sender)
        rows = rows.join(mris, "sender", "left_semi")
    for x in (x.strip() for x in exclude):
        if x.startswith("c:"):
            ids = conversations_of(spark, root, x).select(F.col("id").alias("conv_id"))
            if not ids.take(1):
                return Answer(None, "no-such-excluded-conversation", x)
            rows = rows.join(ids, "conv_id", "left_anti")
        elif x.startswith("p:"):
            mris = people_of(spark, root, x).select(F.col("mri").alias("sender"))
            if not mris.take(1):
                return Answer(None, "no-such-excluded-person", x)
            rows = rows.join(mris, "sender", "left_anti")
        elif x:
            rows = rows.filter(~chat.contains("content", x))
    return Answer(rows)


def search(spark: SparkSession, root: str, text: str = "", conversation: str | None = None, sender: str | None = None, exclude: Sequence[str] = (), since: int | None = None, until: int | None = None, kind: str | None = None, mentions_me: bool = False, has_attach: bool = False, limit: int | None = None) -> Answer:
    """Messages that hold a text, newest first, in a scope: conv_id, id, ts, sender, snippet. ``total`` is not counted: see ``coverage``."""
    rows = silver.messages(spark, root, "conv_id", "id", "ts", "sender", "content", "kind", "is_system", "mentions_me", "has_attach").filter("not is_system")
    if since is not None:
        rows = rows.filter(F.col("ts") >= since)
    if until is not None:
        rows = rows.filter(F.col("ts") < until)
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if mentions_me:
        rows = rows.filter("mentions_me")
    if has_attach:
        rows = rows.filter("has_attach")
    if text:
        rows = rows.filter(chat.contains("content", text))
    found = _scope(spark, root, rows, conversation, sender, exclude)
    if found.rows is None:
        return found
    notes = ()
    if conversation is not None and (note := ambiguity(spark, root, conversation)):
        notes = (note,)
    shown = found.rows.select("conv_id", "id", "ts", "sender", clip(strip_tags(F.col("content")), 120).alias("snippet"))
    return Answer(shown.orderBy(F.desc("ts"), F.desc("id")).limit(limit) if limit else shown, notes=notes)


def coverage(spark: SparkSession, root: str, conversation: str | None = None, sender: str | None = None, exclude: Sequence[str] = ()) -> Answer:
    """first_ts, last_ts, n of the messages in a scope."""
    found = _scope(spark, root, silver.messages(spark, root, "conv_id", "ts", "sender", "content", "is_system").filter("not is_system and ts > 0"), conversation, sender, exclude)
    return found if found.rows is None else Answer(found.rows.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")))


def ambiguity(spark: SparkSession, root: str, selector: str, most: int = 4) -> str:
    """A note where a part of a title names more than one conversation: how many, and the newest of them."""
    if selector.startswith("c:"):
        return ""
    found = conversations_of(spark, root, selector)
    n = found.count()
    if n < 2:
        return ""
    newest = found.orderBy(F.desc("last_ts"), "id").limit(most).collect()
    return f"{selector!r} names {n} conversations, all are searched: " + "; ".join(f"{r.handle} {r.title}".strip() for r in newest)


# Pages and threads


def page(spark: SparkSession, root: str, conv_id: str, cursor: str | None = None, limit: int = 50, **window: int) -> Answer:
    """The last rows of a conversation before a cursor, oldest first, and the cursor of the page before (only where this one is full; it may turn out empty)."""
    before = None
    if cursor:
        ts, _, id_ = cursor.removeprefix("older:").partition(":")
        before = (int(ts), id_)
    rows = chat.page(spark, root, conv_id, before=before, limit=limit, **window)
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "id")).alias("f")).first()
    return Answer(rows, older=f"older:{first['f']['ts']}:{first['f']['id']}" if first["n"] >= limit else None)


def thread_window(spark: SparkSession, root: str, conv_id: str, root_id: str, hit: str | None = None, before: str | None = None, inline: int = 40, size: int = 20) -> Answer:
    """A thread's root and replies: all of a thread of ``inline`` rows or fewer, else ``size`` replies, the newest, those around a hit, or those before a reply.

    place (of a reply, from 0; the root has -1), id, ts, sender. ``older`` names the reply before which the next window lies. A page of one thread is small.
    """
    rows = chat.thread(spark, root, conv_id, root_id)
    total = rows.count()
    if not total:
        return Answer(None, "no-such-message", root_id)
    # Replies are numbered from the newest: a window of one thread is an ordered limit, never the whole thread in one task.
    replies = rows.filter(F.col("id") != root_id)
    n = replies.count()
    earlier, shown = 0, replies
    older = lambda key: (F.col("ts") < key["ts"]) | ((F.col("ts") == key["ts"]) & (F.col("id") < key["id"]))
    pivot = replies.filter(F.col("id") == (hit or before or "")).select("ts", "id").first() if (hit or before) else None
    if before:
        upto = replies.filter(older(pivot)) if pivot else replies
        have = upto.count()
        shown, earlier = upto.orderBy(F.desc("ts"), F.desc("id")).limit(size), max(0, have - size)
    elif hit and pivot and total > inline:
        earlier = max(0, replies.filter(older(pivot)).count() - size // 2)
        shown = replies.orderBy("ts", "id").offset(earlier).limit(size)
    elif total > inline:
        shown, earlier = replies.orderBy(F.desc("ts"), F.desc("id")).limit(size), n - size
    placed = shown.withColumn("place", F.row_number().over(W.orderBy("ts", "id")) + earlier - 1) if total <= inline or shown is not replies else shown
    out = placed.select(F.col("place").cast("long").alias("place"), "id", "ts", "sender").unionByName(rows.filter(F.col("id") == root_id).select(F.lit(-1).cast("long").alias("place"), "id", "ts", "sender"))
    first = out.filter("place >= 0").orderBy("place").first()
    notes = () if rows.filter(F.col("id") == root_id).take(1) else ("the thread's root is not in the store",)
    return Answer(out, total=total, older=first["id"] if earlier > 0 and first else None, notes=notes)


# People, calls and events


def people(spark: SparkSession, root: str, query: str | None = None, limit: int = 8) -> Answer:
    """People by messages, with the number of all that match."""
    found = chat.people_find(spark, root, query)
    return Answer(found.orderBy(F.desc("msg_count"), "mri").limit(limit), total=found.count())


def max_event_start(spark: SparkSession, root: str) -> DataFrame:
    return silver.events(spark, root).agg(F.coalesce(F.max("start_ts"), F.lit(0)).alias("max_start"))


def events(spark: SparkSession, root: str, now: int, since: int | None = None, until: int | None = None, body: bool = False, **filters) -> Answer:
    """Events by start; without bounds those of the next seven days.

    With ``body`` the body of a single event that isn't confidential is added to the notes, as text of 1,000 code points at most.
    """
    if since is None and until is None:
        since, until = now, now + 7 * DAY
    rows, notes = chat.event_list(spark, root, since=since, until=until, **filters), []
    if until is not None:
        last = max_event_start(spark, root).first()["max_start"]
        if until > last:
            notes.append(f"the window ends after the last stored occurrence ({last}): later ones of recurring events may be missing")
    if body:
        found = rows.select("id").limit(2).collect()
        if len(found) != 1:
            notes.append("no body: it is shown for a single event only")
        else:
            event = silver.events(spark, root).filter(F.col("id") == found[0]["id"])
            if event.filter("is_confidential").take(1):
                notes.append("no body: the event is confidential")
            elif text := event_bodies(event).first():
                notes.append(text["body"])
    return Answer(rows, notes=tuple(notes))


def event_bodies(events_: DataFrame, most: int = 1000) -> DataFrame:
    """id, body: bodies of events that aren't confidential, as text without link paths, at most ``most`` code points."""
    shown = events_.filter("body_html is not null and not coalesce(is_confidential, false)")
    return shown.select("id", clip(elide_urls(html_to_text("body_html")), most).alias("body"))


def calls(spark: SparkSession, root: str, state: str | None = None, direction: str | None = None, missed: bool = False, since: int | None = None, until: int | None = None, min_ms: int | None = None) -> DataFrame:
    """Calls that aren't deleted, filtered: id, call_type, direction, state, start_ts, duration_ms, title (participants' names of calls of several people)."""
    rows = silver.calls(spark, root).filter("not coalesce(is_deleted, false)")
    for column, wanted in (("state", state), ("direction", direction)):
        if wanted is not None:
            rows = rows.filter(F.lower(column) == wanted.lower())
    if missed:
        rows = rows.filter("is_missed")
    if since is not None:
        rows = rows.filter(F.col("start_ts") >= since)
    if until is not None:
        rows = rows.filter(F.col("start_ts") < until)
    if min_ms is not None:
        rows = rows.filter(F.col("duration_ms") >= min_ms)
    named = F.array_sort(F.filter(F.transform(F.coalesce("participants", F.array().cast("array<struct<mri:string,name:string>>")), lambda p: p["name"]), lambda n: F.coalesce(n, F.lit("")) != ""))
    return rows.select("id", "call_type", "direction", "state", "start_ts", "duration_ms", F.array_join(F.slice(named, 1, 4), ", ").alias("title"))


def known_conversations(spark: SparkSession, root: str) -> DataFrame:
    """Every conversation that messages, meetings or calls name: id, msg_count, last_ts (of messages, meetings and calls), stored (whether it has messages)."""
    met = silver.events(spark, root).filter("cid is not null").groupBy(F.col("cid").alias("id")).agg(F.max("start_ts").alias("meta_ts"))
    called = silver.calls(spark, root).filter("group_thread_id is not null").groupBy(F.col("group_thread_id").alias("id")).agg(F.max("start_ts").alias("meta_ts"))
    meta = met.unionByName(called).groupBy("id").agg(F.max("meta_ts").alias("meta_ts"))
    own = silver.conversations(spark, root).select("id", "msg_count", "last_ts")
    both = own.join(meta, "id", "full")
    return both.select("id", F.coalesce("msg_count", F.lit(0)).alias("msg_count"), F.greatest(F.coalesce("last_ts", F.lit(0)), F.coalesce("meta_ts", F.lit(0))).alias("last_ts"), F.col("msg_count").isNotNull().alias("stored"))
