"""The engine's queries by name, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions.text import clip, elide_urls, html_to_text, initials, ngrams, strip_tags, topic_tokens, words
from threadlake.operators import changefeed, drift, ledger, snapshot
from threadlake.plans import analytics as a
from threadlake.plans import answers as an
from threadlake.plans import chat as c
from threadlake.plans import search as s
from threadlake.plans import render, silver
from threadlake.session import cut
from threadlake.tables import table


def _middle_ts(spark: SparkSession, root: str, conv: str) -> int:
    """The lower middle of a conversation's times, by a sort over all executors."""
    rows = silver.messages(spark, root, "conv_id", "ts", "is_system").filter((F.col("conv_id") == conv) & ~F.col("is_system") & (F.col("ts") > 0)).select("ts")
    row = rows.orderBy("ts").offset(max(0, (rows.count() + 1) // 2 - 1)).limit(1).first()
    return row["ts"] if row else 0


def msg_page(spark, root):
    return c.page(spark, root, c.largest_conversation(spark, root), limit=50)


def msg_page_keyset(spark, root):
    conv = c.largest_conversation(spark, root)
    first = c.page(spark, root, conv, limit=50).first()
    return c.page(spark, root, conv, before=(first["ts"], first["id"]) if first else None, limit=50)


def msg_around(spark, root):
    conv = c.largest_conversation(spark, root)
    return c.around(spark, root, conv, _middle_ts(spark, root, conv), 20)


def msg_point_lookup(spark, root):
    rows = silver.messages(spark, root, "conv_id", "id", "ts", "sender")
    key = rows.agg(F.min(F.struct("conv_id", "id")).alias("k")).first()["k"]
    return rows.filter((F.col("conv_id") == (key["conv_id"] if key else "")) & (F.col("id") == (key["id"] if key else "")))


def thread_read(spark, root):
    top = c.threads(spark, root).orderBy(F.desc("n"), "conv_id", "root_id").first()
    return c.thread(spark, root, top["conv_id"] if top else "", top["root_id"] if top else "")


def conv_resolve(spark, root):
    top = silver.conversations(spark, root).orderBy(F.desc("msg_count"), "id").first()
    return c.conv_resolve(spark, root, top["handle"] if top else "c:")


def handles(spark, root):
    """Handles of all conversations, then all people, each in the order of their ids: the shortest digits, six at least, that no id before it has taken.

    Ids that share six digits are few (their number over 16 million), so they are settled together.
    """
    ids = silver.conversations(spark, root).select(F.lit("c:").alias("p"), F.col("id")).unionByName(silver.people(spark, root).select(F.lit("p:").alias("p"), F.col("mri").alias("id")))
    groups = ids.withColumn("h", F.sha1("id")).groupBy("p", F.substring("h", 1, 6).alias("six")).agg(F.array_sort(F.collect_list(F.struct("id", "h"))).alias("members"))
    free = lambda taken, x: F.element_at(F.filter(F.transform(F.sequence(F.lit(6), F.lit(40)), lambda n: F.substr(x["h"], F.lit(1), n)), lambda h: ~F.exists(taken, lambda t: t["handle"] == h)), 1)
    given = F.aggregate("members", F.array().cast("array<struct<id:string,handle:string>>"), lambda taken, x: F.concat(taken, F.array(F.struct(x["id"].alias("id"), free(taken, x).alias("handle")))))
    return groups.select("p", F.inline(given)).select("id", F.concat("p", "handle").alias("handle"))


def store_counts(spark, root):
    m = silver.messages(spark, root, "ts").agg(F.count(F.lit(1)).alias("messages"), F.min(F.when(F.col("ts") > 0, F.col("ts"))).alias("earliest_ts"))
    counts = {"people": silver.people(spark, root), "profiles": silver.profiles(spark, root), "events": silver.events(spark, root), "calls": silver.calls(spark, root)}
    out = m.withColumn("k", F.lit(1))
    for name, df in counts.items():
        out = out.join(df.agg(F.count(F.lit(1)).alias(name)).withColumn("k", F.lit(1)), "k")
    return out.drop("k")


def self_vote(spark, root):
    rows = silver.messages(spark, root, "sender", "is_mine").filter("is_mine and sender <> '?'").groupBy("sender").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "sender").limit(1)


def events_pivot(spark, root):
    """Events with the chat of their meeting: id, handle, msg_count."""
    rows = silver.events(spark, root).filter("cid is not null").select("id", "cid")
    conv = silver.conversations(spark, root).select(F.col("id").alias("cid"), "handle", "msg_count")
    return rows.join(conv, "cid", "left").select("id", "cid", "handle", "msg_count")


def recording_pivot(spark, root):
    """Calls with a recording beside the message that holds it: id, conv_id, message_id, sender."""
    rows = silver.calls(spark, root).filter("recording_link is not null").select(F.col("id").alias("call_id"), F.col("recording_link.conversation_id").alias("conv_id"), F.col("recording_link.linked_message_id").alias("id"))
    return rows.join(silver.messages(spark, root, "conv_id", "id", "sender"), ["conv_id", "id"], "left").select("call_id", "conv_id", F.col("id").alias("message_id"), "sender")


def person_names(spark, root):
    """Profiles with display name and initials; of federated people without a family name (their given name may be an address) the parts of the name."""
    name = F.trim(F.regexp_replace("name", r"\([^)]*\)", ""))
    federated = (F.coalesce("type", F.lit("")) == "Federated") & (F.trim(F.coalesce("surname", F.lit(""))) == "")
    comma = F.instr(name, ",") > 0
    given = F.when(federated, F.when(comma, F.trim(F.substring_index(name, ",", -1))).otherwise(name)).otherwise(F.coalesce("given_name", F.lit("")))
    surname = F.when(federated & comma, F.trim(F.substring_index(name, ",", 1))).otherwise(F.coalesce("surname", F.lit("")))
    rows = silver.profiles(spark, root).select("mri", "name", given.alias("given"), surname.alias("family"))
    both = (F.col("given") != "") & (F.col("family") != "")
    return rows.select("mri", F.when(both, F.concat_ws(" ", "given", "family")).otherwise(F.col("name")).alias("display"), F.when(both, F.concat_ws(" ", "given", initials(F.col("family")))).otherwise(F.col("name")).alias("label"))


def tokenize(spark, root):
    rows = s.indexed(spark, root).select("kind", F.explode(words(F.col("text"))).alias("term"))
    return rows.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n"))


def fts_postings(spark, root):
    return s.index(spark, root).select("term", "conv_id", "id", "tf")


def phrases_ngrams(spark, root):
    tokens = table(spark, root, "documents").filter("text is not null").select(F.explode(F.array(topic_tokens(F.col("text")))).alias("tokens"))
    docs = tokens.select(F.explode(ngrams(F.col("tokens"))).alias("phrase"))
    return docs.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


def url_elide(spark, root):
    return table(spark, root, "documents").select("doc_id", elide_urls(F.col("text")).alias("text"))


def clip_texts(spark, root):
    return table(spark, root, "documents").select("doc_id", clip(F.col("text"), 80).alias("text"))


def strip_html(spark, root):
    return silver.events(spark, root).filter("body_html is not null").select("id", strip_tags(F.col("body_html")).alias("text"))


def html_texts(spark, root):
    return silver.events(spark, root).filter("body_html is not null").select("id", html_to_text("body_html").alias("text"))


def json_path_coalesce(spark, root):
    """The first name that is set among several paths of each record: raw_id, label."""
    rows = table(spark, root, "raw_records").select("raw_id", F.try_parse_json("payload").alias("v"))
    paths = ["$.displayName", "$.subject", "$.threadProperties.topic", "$.imDisplayName", "$.originatorParticipant.displayName"]
    return rows.select("raw_id", F.coalesce(*[F.nullif(F.try_variant_get("v", p, "string"), F.lit("")) for p in paths]).alias("label"))


def describe_schema(spark, root):
    """Fields of each store over all files, with the share of records that have them: store, path, types, files."""
    seen = drift.schemas(table(spark, root, "raw_records")).filter("path <> ''")
    return seen.groupBy("store", "path").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))), ",").alias("types"), F.count(F.lit(1)).alias("files"))


def incremental_equals_full(spark, root):
    """Rows by which applying the feed in three parts, as they arrived and the last one twice, differs from applying it at once: none."""
    feed = table(spark, root, "store_entries")
    columns = ["cache_id", "entry_key", "seq", "version", "entry_value"]
    full = changefeed.live_records(feed, keep=["entry_value"]).select(*columns)
    span = feed.agg(F.unix_micros(F.min("landed_at").cast("timestamp")).alias("a"), F.unix_micros(F.max("landed_at").cast("timestamp")).alias("b")).first()
    first, last = span["a"] or 0, span["b"] or 0
    part = F.coalesce(F.floor(3 * (F.unix_micros(F.col("landed_at").cast("timestamp")) - first) / F.lit(last - first + 1)), F.lit(0))
    state = feed.limit(0).select("cache_id", "entry_key", "seq", "op_type", "version", "entry_value")
    for n in (0, 1, 2, 2):
        state = cut(changefeed.merge(state, feed.filter(part == n), keep=["entry_value"]))
    parts = changefeed.live_records(state, keep=["entry_value"]).select(*columns)
    return full.exceptAll(parts).unionByName(parts.exceptAll(full)).select("cache_id", "entry_key")


def pending_ranges(spark, root):
    """What is available and not yet processed, as intervals per cache: cache_id, lo, hi."""
    open_ = ledger.pending_entries(table(spark, root, "store_entries"), table(spark, root, "refresh_states"))
    return ledger.runs(open_, ["cache_id"])


def rescued(spark, root):
    """Records of all stores under the fields that most of their files hold: how many have rescued values, by file."""
    return drift.promoted_counts(table(spark, root, "raw_records"), first=0.5).drop("replayed")


def glyphs(spark, root):
    """The keys of all reactions with their characters: key, glyph."""
    keys = silver.messages(spark, root, "reactions").select(F.inline("reactions")).filter("k is not null").select(F.col("k").alias("key")).distinct()
    return keys.select("key", render.glyph(F.col("key")).alias("glyph"))


def _top_handles(spark, root):
    conv = silver.conversations(spark, root).orderBy(F.desc("msg_count"), "id").first()
    who = silver.people(spark, root).orderBy(F.desc("msg_count"), "mri").first()
    return (conv["handle"] if conv else "c:"), (who["handle"] if who else "p:")


def search_scoped(spark, root):
    """In the largest conversation, without its busiest writer of all and the word snapshot, over a quarter of a year."""
    conv, who = _top_handles(spark, root)
    return an.search(spark, root, "the", conversation=conv, exclude=[who, "snapshot"], since=1_760_000_000_000, until=1_768_000_000_000).rows


def search_sender(spark, root):
    return an.search(spark, root, sender=_top_handles(spark, root)[1], mentions_me=True).rows


def search_misses(spark, root):
    """What selectors miss: selector, reason."""
    asked = [("c:zzzzzz", an.search(spark, root, conversation="c:zzzzzz")), ("p:zzzzzz", an.search(spark, root, sender="p:zzzzzz")), ("-c:zzzzzz", an.search(spark, root, exclude=["c:zzzzzz"])), ("-p:zzzzzz", an.search(spark, root, exclude=["p:zzzzzz"])), ("m:zzzzzz", an.thread_window(spark, root, "zzzzzz", "zzzzzz"))]
    return spark.createDataFrame([(s_, a.miss) for s_, a in asked], "selector string, reason string")


def page_cursor(spark, root):
    """The second page of the largest conversation, by the cursor of the first."""
    conv = c.largest_conversation(spark, root)
    return an.page(spark, root, conv, cursor=an.page(spark, root, conv).older).rows


def thread_window(spark, root):
    """The window around a reply in the middle of the longest thread."""
    top = c.threads(spark, root).orderBy(F.desc("n"), "conv_id", "root_id").first()
    if not top:
        return silver.messages(spark, root, "id", "ts", "sender").limit(0).select(F.lit(0).cast("long").alias("place"), "id", "ts", "sender")
    rows = c.thread(spark, root, top["conv_id"], top["root_id"]).filter(F.col("id") != top["root_id"])
    mid = rows.orderBy("ts", "id").offset(top["n"] // 2).first()
    return an.thread_window(spark, root, top["conv_id"], top["root_id"], hit=mid["id"] if mid else None, inline=4, size=4).rows


def people_total(spark, root):
    found = an.people(spark, root, query="ro", limit=3)
    return found.rows.select("mri", F.lit(found.total).cast("long").alias("total"))


QUERIES = {
    # selectors and filters
    "conv_list": lambda spark, root: c.conv_list(spark, root),
    "conv_list_kind": lambda spark, root: c.conv_list(spark, root, kind="channel"),
    "conv_list_query": lambda spark, root: c.conv_list(spark, root, query="an"),
    "conv_resolve": conv_resolve,
    "msg_point_lookup": msg_point_lookup,
    "msg_page": msg_page,
    "msg_page_keyset": msg_page_keyset,
    "msg_around": msg_around,
    "thread_read": thread_read,
    "thread_summaries": lambda spark, root: c.threads(spark, root),
    "conv_stats": lambda spark, root: c.conv_stats(spark, root),
    "coverage_span": lambda spark, root: c.coverage(spark, root),
    "browse_search": lambda spark, root: c.substring_search(spark, root, "", kind="1:1"),
    "substring_search": lambda spark, root: c.substring_search(spark, root, "channel export"),
    "substring_top": lambda spark, root: c.substring_search(spark, root, "snapshot", limit=50),
    "exclude_filter": lambda spark, root: c.substring_search(spark, root, "train", exclude=["demo", "retro"]),
    # joins
    "people_profiles": lambda spark, root: c.people_find(spark, root),
    "people_find_name": lambda spark, root: c.people_find(spark, root, query="ro"),
    "call_list": lambda spark, root: c.call_list(spark, root),
    "call_list_participant": lambda spark, root: c.call_list(spark, root, participant="a"),
    "events_chat_pivot": events_pivot,
    "recording_pivot": recording_pivot,
    "missing_conversations": lambda spark, root: c.missing_conversations(spark, root),
    "replies_with_root": lambda spark, root: c.replies_with_root(spark, root),
    "coparticipants": lambda spark, root: c.coparticipants(spark, root),
    # aggregates
    "people_agg": lambda spark, root: silver.people(spark, root),
    "conv_counters": lambda spark, root: silver.conversations(spark, root),
    "participant_top5": lambda spark, root: silver.participant_names(spark, root),
    "self_vote": self_vote,
    "store_counts": store_counts,
    "handles": handles,
    "conv_mix": lambda spark, root: a.kind_mix(spark, root),
    "reactions_total": lambda spark, root: a.reactions_total(spark, root),
    "reaction_counts": lambda spark, root: c.reaction_counts(spark, root),
    "version_fold": lambda spark, root: silver.messages(spark, root, "conv_id", "id", "version", "row_no"),
    "lww_winners": lambda spark, root: snapshot.winners(table(spark, root, "store_entries")).select("cache_id", "entry_key", "seq", "op_type"),
    "snapshot_buckets": lambda spark, root: snapshot.buckets(table(spark, root, "store_entries")),
    "call_percentiles": lambda spark, root: a.call_percentiles(spark, root),
    "p95_positive": lambda spark, root: a.p95_positive(spark, root),
    # windows
    "streak_longest": lambda spark, root: a.streaks(spark, root),
    "burst_60s": lambda spark, root: a.burst_60s(spark, root),
    "bursts_15m": lambda spark, root: c.bursts(spark, root),
    "rolling_35d_7d": lambda spark, root: a.rolling(spark, root),
    "rolling_4w": lambda spark, root: a.rolling_4w(spark, root),
    "series_collapse": lambda spark, root: c.series_collapse(spark, root),
    "digest_budget": lambda spark, root: c.digest(spark, root),
    "top_per_frame": lambda spark, root: a.top_per_frame(spark, root),
    "lead_interpolation": lambda spark, root: a.interpolated(spark, root),
    "hysteresis_rank": a.hysteresis_rank,
    # time
    "messages_per_day": lambda spark, root: a.per_day(spark, root),
    "busiest_day": lambda spark, root: a.busiest_day(spark, root),
    "hour_histogram": lambda spark, root: a.hour_histogram(spark, root),
    "night_owls": lambda spark, root: a.night_owls(spark, root),
    "rhythm_slots": lambda spark, root: a.rhythm(spark, root),
    "interval_occupancy": lambda spark, root: a.occupancy(spark, root),
    "week_axis": lambda spark, root: a.week_axis(spark, root),
    "gaussian_smoothing": lambda spark, root: a.smoothed(spark, root),
    "top_partners": lambda spark, root: a.top_partners(spark, root),
    "people_talked_to": lambda spark, root: a.people_talked_to(spark, root),
    "first_to_me": lambda spark, root: a.first_to_me(spark, root),
    # text
    "tokenize": tokenize,
    "fts_postings": fts_postings,
    "fts_bm25": lambda spark, root: s.bm25(spark, root, ["channel", "export"]),
    "fts_bm25_porter": lambda spark, root: s.bm25(spark, root, ["measured", "snapshots"], stemmed=True),
    "fts_search": lambda spark, root: s.search(spark, root, ["channel", "export"]),
    "phrases_ngrams": phrases_ngrams,
    "fts_bm25_scoped": lambda spark, root: s.bm25(spark, root, ["channel", "export"], kind="channel", since=1_760_000_000_000, until=1_770_000_000_000),
    "topics_rank": lambda spark, root: s.topics(spark, root, days=30),
    "topics_options": lambda spark, root: s.topics(spark, root, since=1_765_000_000_000, until=1_770_000_000_000, kind="channel", exclude=["snapshot"], stopwords=["index"]),
    "topics_scope": lambda spark, root: s.topic_scope(spark, root, days=30),
    "top_terms": lambda spark, root: s.top_terms_per_kind(spark, root),
    "strip_html": strip_html,
    "html_to_text": html_texts,
    "url_elide": url_elide,
    "clip": clip_texts,
    "person_names": person_names,
    # nested and JSON
    "json_path_coalesce": json_path_coalesce,
    "attendee_summary": lambda spark, root: c.attendee_summary(spark, root),
    "event_list": lambda spark, root: c.event_list(spark, root),
    "event_list_attendee": lambda spark, root: c.event_list(spark, root, attendee="elif"),
    "fingerprints": lambda spark, root: snapshot.fingerprints(table(spark, root, "schema_files")),
    "layout_changes": lambda spark, root: snapshot.layout_changes(table(spark, root, "schema_files")),
    "describe_schema": describe_schema,
    # rendering
    "reaction_rows": lambda spark, root: render.reaction_rows(silver.messages(spark, root, "conv_id", "id", "reactions"), me=silver.self_mri(spark, root), people=silver.people(spark, root)),
    "glyphs": glyphs,
    "thread_blocks": lambda spark, root: render.thread_blocks(silver.messages(spark, root, "conv_id", "id", "root_id", "ts", "is_system")).select("conv_id", "root_id", "id", "n", "earlier"),
    "call_durations": lambda spark, root: silver.calls(spark, root).select("id", render.shown_duration(F.col("duration_ms")).alias("shown")),
    "body_chunks": lambda spark, root: table(spark, root, "documents").select("doc_id", render.body_chunk(F.col("text"), 200, 300).alias("chunk")),
    # answers
    "search_scoped": search_scoped,
    "search_sender": search_sender,
    "search_misses": search_misses,
    "coverage_scoped": lambda spark, root: an.coverage(spark, root, conversation=_top_handles(spark, root)[0]).rows,
    "page_cursor": page_cursor,
    "thread_window": thread_window,
    "people_total": people_total,
    "max_event_start": an.max_event_start,
    "events_ahead": lambda spark, root: an.events(spark, root, now=1_765_000_000_000).rows,
    "event_bodies": lambda spark, root: an.event_bodies(silver.events(spark, root)),
    "calls_filtered": lambda spark, root: an.calls(spark, root, direction="incoming", since=1_750_000_000_000, min_ms=1000),
    "known_conversations": an.known_conversations,
    "first_message": lambda spark, root: a.first_message(spark, root),
    "span_anchors": lambda spark, root: a.anchors(spark, root),
    "scale_pick": lambda spark, root: a.scale(spark, root),
    "half_year": lambda spark, root: a.half_year(spark, root),
    # pipeline
    "incremental_equals_full": incremental_equals_full,
    "p6_pending_ranges": pending_ranges,
    "p2_rescued": rescued,
    "p2_promoted": lambda spark, root: drift.promoted_counts(table(spark, root, "raw_records")),
    "p2_table_profiles": lambda spark, root: drift.store_table(table(spark, root, "raw_records"), "profiles"),
    "p2_table_conversations": lambda spark, root: drift.store_table(table(spark, root, "raw_records"), "conversations"),
    "p2_table_replychains": lambda spark, root: drift.store_table(table(spark, root, "raw_records"), "replychains"),
    "p2_table_calendar": lambda spark, root: drift.store_table(table(spark, root, "raw_records"), "calendar"),
    "p2_table_calls": lambda spark, root: drift.store_table(table(spark, root, "raw_records"), "call-history"),
}

