"""Rebuilding conversations from message rows.

A row comes out of the archive as an export fragment: the hashes of the messages it shows, in order. The reply of a
thread shows the message before it in the thread (for the first reply the thread's root) and itself, any other row only
itself. Where the suffix of one fragment equals the prefix of another they overlap: the overlaps are the edges of the
conversation's graph. Edges from a message with one successor are unambiguous, and the fragments along them are merged to
paths; where a message has several successors each of them opens a path of its own. A path whose first prefix no
fragment ends in has a gap there: the message was never delivered. Conversations with a gap, without words, or without
an answer are dropped. The others are ordered by path (the time and id of its first message), then by place in the path.

``assemble`` does the same for fragments of any length (lists of hashes) and overlaps of one message or more.

Scale: rows are folded once, without their contents, and written; suffix and prefix meet in an equi-join on 128-bit
hashes. Threads are linked within their days, so a thread with a third of all replies is spread; paths are merged by
doubling pointers, of the rows that have a predecessor only. Counts per conversation combine map-side; positions come
from counts per day, so no conversation and no path is gathered in one task.

Defined results: rows without conv_id are left out; one row per (conv_id, id) is kept (highest version, null is 0,
then highest row_no); a null root_id is a row of its own; a null content or is_system is an empty text and no system
row; roots that answer each other in a circle are cut at the smallest hash; an empty table gives no rows; other columns
are kept by name only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.functions.mri import clean_mri, is_bot, is_person
from threadlake.operators.fold import kept_messages
from threadlake.operators.ordering import ordinals
from threadlake.session import cut

#: Named entities of blanks and invisible characters.
BLANK_ENTITIES = "nbsp|NonBreakingSpace|ensp|emsp|emsp13|emsp14|numsp|puncsp|thinsp|ThinSpace|hairsp|VeryThinSpace|MediumSpace|ZeroWidthSpace|NegativeThinSpace|NegativeMediumSpace|NegativeThickSpace|NegativeVeryThinSpace|NoBreak|zwnj|zwj|lrm|rlm|shy|Tab|NewLine|ic|InvisibleComma|it|InvisibleTimes|af|ApplyFunction"
#: White space, control and format characters, and the fillers that print nothing.
BLANKS = r"[\s\p{Z}\p{Cc}\p{Cf}\u034F\u115F\u1160\u17B4\u17B5\u180B-\u180F\u2800\u3164\uFFA0\uFE00-\uFE0F]"


def _numeric_blank() -> str:
    decimal = "9|1[0-3]|3[12]|28|29|30|31|1[23][0-9]|160|173|847|1564|4447|4448|5760|61[5-8][0-9]|8192|819[3-9]|820[0-7]|823[2-9]|828[7-9]|829[0-9]|8303|10240|12288|12644|6502[4-9]|6503[0-9]|65279|65440"
    hexa = "9|[aA]|[bB]|[cC]|[dD]|1[cdefCDEF]|20|7[fF]|[89][0-9a-fA-F]|[aA]0|[aA][dD]|34[fF]|61[cC]|115[fF]|1160|1680|180[b-fB-F]|200[0-9a-fA-F]|202[89a-fA-F]|205[fF]|206[0-9a-fA-F]|2800|3000|3164|[fF][eE]0[0-9a-fA-F]|[fF][eE][fF][fF]|[fF][fF][aA]0"
    return f"#0*(?:{decimal});?(?![0-9])|#[xX]0*(?:{hexa});?(?![0-9a-fA-F])"


TAG = r"(?s)<!--.*?-->|</?[A-Za-z!?][^>]*>"
BLANK_ENTITY = f"&(?:(?:{BLANK_ENTITIES});|nbsp|{_numeric_blank()})"


def has_words(content: Column) -> Column:
    """Whether the content, without tags and with entities decoded, holds more than blanks and invisible characters."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(content, F.lit("")), TAG, ""), BLANK_ENTITY, "")
    return F.regexp_replace(bare, BLANKS, "") != ""


def speaking(rows: DataFrame) -> DataFrame:
    """The rows with ``speaks`` and ``person`` (the cleaned MRI of a person, else null)."""
    speaks = ~F.coalesce(F.col("is_system"), F.lit(False)) & has_words(F.col("content"))
    return rows.withColumn("speaks", speaks).withColumn("person", F.when(is_person(F.col("sender_mri")), clean_mri(F.col("sender_mri"))))


DAY = 86_400_000


def kept_rows(messages: DataFrame) -> DataFrame:
    """The kept rows without their contents: row_no, conv_id, id, root_id, ts (null is 0), is_system, sender_mri, speaks, person. Written once."""
    rows = speaking(messages.select("row_no", "conv_id", "id", "version", "ts", "sender_mri", "is_system", "content", "root_id"))
    kept = kept_messages(rows.drop("content")).withColumn("ts", F.coalesce("ts", F.lit(0))).withColumn("is_system", F.coalesce("is_system", F.lit(False)))
    return cut(kept.drop("version"))


def _hash(id_: str) -> Column:
    return F.unhex(F.md5(F.concat(F.col("conv_id"), F.lit("\x1f"), F.coalesce(F.col(id_), F.lit("\x1f")))))


def _is_reply() -> Column:
    return F.col("root_id").isNotNull() & ~F.col("root_id").eqNullSafe(F.col("id"))


def fragments(kept: DataFrame) -> DataFrame:
    """conv_id, suffix, prefix: the hash of the last message that each row shows, and of the one before it (null for a row that shows itself only)."""
    rows = kept.select("conv_id", "id", "root_id", "ts", F.floor(F.col("ts") / DAY).alias("day"))
    alone = rows.filter(~_is_reply()).select("conv_id", _hash("id").alias("suffix"), F.lit(None).cast("binary").alias("prefix"))
    thread = ["conv_id", "root_id"]
    within = W.partitionBy(*thread, "day").orderBy("ts", "id")
    linked = rows.filter(_is_reply()).withColumn("before", F.lag(F.struct("id")).over(within)).withColumn("last", F.lead("ts").over(within).isNull())
    # The first reply of a day follows the last one of the thread's day before, or the root.
    days = linked.filter("last").select(*thread, "day", F.lag("id").over(W.partitionBy(*thread).orderBy("day")).alias("carried"))
    first = linked.filter("before is null").join(days, [*thread, "day"]).select("conv_id", "id", F.coalesce("carried", "root_id").alias("shown"))
    later = linked.filter("before is not null").select("conv_id", "id", F.col("before.id").alias("shown"))
    return alone.unionByName(first.unionByName(later).select("conv_id", _hash("id").alias("suffix"), _hash("shown").alias("prefix")))


def paths(frags: DataFrame) -> DataFrame:
    """The paths of the overlap graph of fragments (a suffix each of its own): conv_id, node, path (the node it starts with), place, gap (whether the message shown before the path was never delivered)."""
    nodes = cut(frags.withColumnRenamed("suffix", "node"))
    alone, linked = nodes.filter("prefix is null"), nodes.filter("prefix is not null")
    shown = linked.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("next"))
    met = cut(shown.join(nodes.select(F.col("node").alias("prefix"), F.lit(True).alias("delivered")), "prefix", "left"))
    merged = merge_paths(met.filter("delivered and n = 1").select(F.col("prefix").alias("src"), F.col("next").alias("dst")))
    missing = met.filter("delivered is null").select("prefix", F.lit(True).alias("gap"))
    opened = linked.join(missing, "prefix").select(F.col("node").alias("path"), "gap")
    # Only fragments with something before them can lie within a path or open one with a gap.
    placed = linked.select("conv_id", "node").join(merged.select(F.col("frag_id").alias("node"), "head", "place"), "node", "left")
    placed = placed.select("conv_id", "node", F.coalesce("head", "node").alias("path"), F.coalesce("place", F.lit(0)).cast("long").alias("place"))
    placed = placed.join(opened, "path", "left").select("conv_id", "node", "path", "place", F.coalesce("gap", F.lit(False)).alias("gap"))
    return placed.unionByName(alone.select("conv_id", "node", F.col("node").alias("path"), F.lit(0).cast("long").alias("place"), F.lit(False).alias("gap")))


def merge_paths(edges: DataFrame) -> DataFrame:
    """frag_id, head, place: for each target of ``edges`` (src, dst; each a source and a target once at most) the start of its path, and how far from it it is.

    Pointers are doubled until all rest at a start: a number of rounds logarithmic in the longest path, each written. A
    circle has no start: when the smallest of a node's predecessors is the node itself, all were passed, and the edge into
    this smallest node is dropped.
    """

    def step(state: DataFrame) -> DataFrame:
        up = state.select(F.col("frag_id").alias("at"), F.col("head").alias("head2"), F.col("place").alias("place2"), F.col("least_id").alias("least2"))
        moved = state.join(up, F.col("head") == F.col("at"), "left")
        return moved.select("frag_id", F.coalesce("head2", "head").alias("head"), (F.col("place") + F.coalesce("place2", F.lit(0))).alias("place"), F.least("least_id", "least2").alias("least_id"), F.col("at").isNotNull().alias("moves"))

    def doubled(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        state = cut(edges.select(F.col("dst").alias("frag_id"), F.col("src").alias("head"), F.lit(1).cast("long").alias("place"), F.col("src").alias("least_id")))
        smallest = None
        while True:
            state = cut(step(step(state).drop("moves")))  # two doublings a round
            seen = state.filter("moves").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("least_id") == F.col("frag_id")).alias("circles")).first()
            if not seen["n"]:
                return state.select("frag_id", "head", "place"), smallest
            if seen["circles"]:
                smallest = state.filter("moves and least_id = frag_id").select("frag_id")
                if not state.filter("moves").join(smallest.withColumnRenamed("frag_id", "least_id"), "least_id", "left_anti").take(1):
                    return state.select("frag_id", "head", "place"), smallest
            state = state.drop("moves")

    state, smallest = doubled(edges)
    if smallest is not None:
        state, _ = doubled(edges.join(smallest.withColumnRenamed("frag_id", "dst"), "dst", "left_anti"))
    return state


def _reasons(kept: DataFrame, graph: DataFrame) -> DataFrame:
    broken = graph.filter("gap").select("conv_id").distinct().withColumn("broken", F.lit(True))
    person = F.when(F.col("speaks"), F.col("person")).alias("person")
    talk = kept.groupBy("conv_id", person).agg(F.bool_or("speaks").alias("speaks")).groupBy("conv_id").agg(F.bool_or("speaks").alias("speaks"), F.count("person").alias("people"))
    why = F.array_compact(
        F.array(
            F.when(F.col("broken"), F.lit("broken")),
            F.when(~F.col("speaks"), F.lit("empty")),
            F.when(F.col("speaks") & (F.col("people") < 2), F.lit("no_reply")),
        )
    )
    return talk.join(broken, "conv_id", "left").select("conv_id", F.explode(why).alias("reason"))


def reasons(messages: DataFrame) -> DataFrame:
    """conv_id, reason: why a conversation is dropped ('broken', 'empty', 'no_reply'), a row for each."""
    kept = kept_rows(messages)
    return _reasons(kept, paths(fragments(kept)))


def conversations(messages: DataFrame) -> DataFrame:
    """The ordered conversations that hold: conv_id, position, id, ts, role, content.

    Rows that speak and system rows, in the order of their paths (time, null is 0, and id of a path's first message),
    then of their places. role: ``system``, ``bot``, ``unknown`` (no MRI of a person) or ``speaker_k``, k counting a
    conversation's people by first time, then id.
    """
    kept = kept_rows(messages)
    graph = cut(paths(fragments(kept)))
    dropped = cut(_reasons(kept, graph).select("conv_id").distinct())
    good = kept.join(dropped, "conv_id", "left_anti").withColumn("node", _hash("id")).withColumn("out", F.col("speaks") | F.col("is_system"))
    # Rows within paths are those behind another; all others, most rows, are the heads of paths and need no join to know it.
    behind = graph.filter("place > 0").select("node", "path", "place")
    replies, alone = good.filter(_is_reply()), good.filter(~_is_reply())
    inner = cut(replies.join(behind, "node").filter("out"))
    heads = alone.unionByName(replies.join(behind, "node", "left_anti"))
    lengths = inner.groupBy(F.col("path").alias("node")).agg(F.count(F.lit(1)).alias("more"))
    heads = cut(heads.join(lengths, "node", "left").withColumn("n", F.col("out").cast("long") + F.coalesce("more", F.lit(0))).drop("more").filter("n > 0"))
    heads = cut(ordinals(heads, ["conv_id"], "ts", ["id"], name="position", weight="n"))
    starts = heads.filter(F.col("n") > F.col("out").cast("long")).select(F.col("node").alias("path"), (F.col("position") + F.col("out").cast("long")).alias("from"))
    inner = ordinals(inner, ["path"], "place", [], cell=1 << 16, name="in_path").join(starts, "path").withColumn("position", F.col("from") + F.col("in_path"))
    columns = ["row_no", "conv_id", "id", "ts", "is_system", "sender_mri", "speaks", "person", "position"]
    rows = cut(heads.filter("out").select(*columns).unionByName(inner.select(*columns)))
    people = rows.filter("speaks and person is not null").groupBy("conv_id", "person").agg(F.min(F.struct("ts", "id")).alias("first"))
    numbered = people.withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy("first"))).select("conv_id", "person", "k")
    role = F.when(F.col("is_system"), "system").when(F.col("k").isNotNull(), F.concat(F.lit("speaker_"), F.col("k"))).when(is_bot(F.col("sender_mri")), "bot").otherwise("unknown")
    told = rows.join(numbered, ["conv_id", "person"], "left").select("row_no", "conv_id", "position", "id", "ts", role.alias("role"))
    return told.join(messages.select("row_no", "content"), "row_no").drop("row_no")


#: Polynomial hash of a list: fixed base, modulus 2^127 - 1. An end of a list is hashed from its prefixes in one step.
_BASE, _MODULUS = 0x5BD1E9955BD1E995C2B2AE3D27D4EB4F, 2**127 - 1
#: Rows given out at once.
_ROWS = 50_000


def _end_batches(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """frag_id, k, tail, head: the hashes of a fragment's last and first k messages, for every k below its length."""
    names, out = ["frag_id", "k", "tail", "head"], ([], [], [], [])

    def batch() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=names)
        for v in out:
            v.clear()
        return done

    for rows in batches:
        for frag, hashes in zip(rows.column("frag_id").to_pylist(), rows.column("hashes"), strict=True):
            prefix = [0]
            for x in hashes.as_py():
                prefix.append((prefix[-1] * _BASE + (2**64 if x is None else x % 2**64) + 1) % _MODULUS)
            n, power = len(prefix) - 1, 1
            for k in range(1, n):
                power = power * _BASE % _MODULUS
                if k < least:
                    continue
                for v, item in zip(out, (frag, k, ((prefix[n] - prefix[n - k] * power) % _MODULUS).to_bytes(16), prefix[k].to_bytes(16)), strict=True):
                    v.append(item)
                if len(out[0]) >= _ROWS:
                    yield batch()
    yield batch()


def _within(once: DataFrame) -> DataFrame:
    """frag_id of the fragments that lie, as a whole and in a row, inside a longer one."""
    places = once.select(F.col("frag_id").alias("outer"), F.size("hashes").alias("m"), F.posexplode("hashes").alias("at", "x"))
    inner = once.select("frag_id", F.size("hashes").alias("n"), F.element_at("hashes", 1).alias("x"), F.element_at("hashes", -1).alias("last"))
    met = inner.join(places, "x").filter("m > n and at + n <= m").select("frag_id", "outer", "at", "n", "last")
    # The last message is compared too before any list is.
    ends = places.select("outer", (F.col("at") + 1).alias("end"), F.col("x").alias("last"))
    met = met.withColumn("end", F.col("at") + F.col("n")).join(ends, ["outer", "end", "last"])
    met = met.join(once.select("frag_id", F.col("hashes").alias("own")), "frag_id").join(once.select(F.col("frag_id").alias("outer"), "hashes"), "outer")
    return met.filter("slice(hashes, at + 1, n) = own").select("frag_id").distinct()


def assemble(frags: DataFrame, least: int = 1) -> DataFrame:
    """Merge fragments (frag_id string, hashes array<long>) along unambiguous overlaps.

    An overlap is a suffix of one fragment, of ``least`` messages or more, equal to a prefix of another; of a fragment's
    overlaps only the longest count. Equal fragments are one, and one within a longer fragment is absorbed by it: it gives
    no row. An edge is unambiguous
    where its source has one successor and its target one predecessor; chains of such edges become one path
    (``merge_paths``). Circles are cut at their smallest fragment. Returns path_id (the fragment it starts with), place,
    frag_id, overlap (messages shared with the fragment before).
    """
    once = frags.filter("size(hashes) > 0").groupBy("hashes").agg(F.min("frag_id").alias("frag_id"))
    once = cut(once.select("frag_id", "hashes"))
    once = cut(once.join(_within(once), "frag_id", "left_anti"))
    cutting = once.mapInArrow(lambda b: _end_batches(least, b), "frag_id string, k int, tail binary, head binary")
    tails = cutting.select(F.col("frag_id").alias("src"), "k", F.col("tail").alias("h"))
    heads = cutting.select(F.col("frag_id").alias("dst"), "k", F.col("head").alias("h"))
    # A hash that ends or begins more than one fragment is ambiguous at that length: counted first, never expanded to pairs.
    tails = tails.groupBy("k", "h").agg(F.count(F.lit(1)).alias("nt"), F.min("src").alias("src"))
    heads = heads.groupBy("k", "h").agg(F.count(F.lit(1)).alias("nh"), F.min("dst").alias("dst"))
    met = tails.join(heads, ["k", "h"]).filter("nt = 1 and nh = 1 and src <> dst")
    out = met.groupBy("src").agg(F.max(F.struct("k", "dst")).alias("e")).select("src", "e.dst", "e.k")
    edges = out.groupBy("dst").agg(F.max(F.struct("k", "src")).alias("e")).select("e.src", "dst", "e.k")
    edges = cut(edges)
    merged = merge_paths(edges.select("src", "dst"))
    shared = edges.select(F.col("dst").alias("frag_id"), F.col("k").alias("overlap"))
    placed = once.select("frag_id").join(merged, "frag_id", "left").join(shared, "frag_id", "left")
    first = F.col("head").isNull()
    return placed.select(F.coalesce("head", "frag_id").alias("path_id"), F.when(first, 0).otherwise(F.col("place")).cast("long").alias("place"), "frag_id", F.when(first, 0).otherwise(F.col("overlap")).alias("overlap"))
