"""Full-text search by an inverted index, and the ranking of topics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.functions.mri import is_bot
from threadlake.functions.text import ngrams, strip_tags, topic_tokens, words
from threadlake.plans import silver
from threadlake.plans.derived import derived

#: Okapi BM25.
K1, B = 1.2, 0.75


def indexed(spark: SparkSession, root: str) -> DataFrame:
    """What the index holds: messages that aren't system rows and aren't empty."""
    rows = silver.messages(spark, root, "conv_id", "id", "ts", "sender", "is_system", "content", "kind").filter("not is_system and content <> ''")
    return rows.select("conv_id", "id", "ts", "sender", "kind", strip_tags(F.col("content")).alias("text"))


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    from threadlake.functions.porter import porter

    return porter(word)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Diacritics off, then Porter's stems."""
    from threadlake.functions.porter import fold

    for part in tokens:
        yield part.map(lambda ts: [stem(fold(t)) for t in ts], na_action="ignore")


def postings(docs: DataFrame, stemmed: bool = False) -> DataFrame:
    """term, conv_id, id, tf, and the document's length. To be kept, write it partitioned or bucketed by term."""
    tokens = words(F.col("text"))
    rest = [c for c in ("kind", "ts", "sender") if c in docs.columns]
    rows = docs.select("conv_id", "id", *rest, tokens.alias("tokens"))
    found = rows.select("conv_id", "id", *rest, F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    if stemmed:  # words are stemmed once each, not once an occurrence
        each = found.groupBy("term").count().select("term", stems(F.array("term")).getItem(0).alias("stem"))
        found = found.join(each, "term").drop("term").withColumnRenamed("stem", "term")
    return found.groupBy("term", "conv_id", "id").agg(F.count(F.lit(1)).alias("tf"), *[F.first(c).alias(c) for c in ("length", *rest)])


#: Parts that the index is written in, by term.
BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def index(spark: SparkSession, root: str, stemmed: bool = False) -> DataFrame:
    """The postings of all indexed messages, built at the first search and kept, in parts by term: a query reads the parts of its terms."""
    name = "postings_stemmed" if stemmed else "postings"
    return derived(spark, root, name, ["messages"], lambda: postings(indexed(spark, root), stemmed).withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("conv_id", "id"), F.lit(8))), partition="bucket")


def statistics(spark: SparkSession, root: str) -> DataFrame:
    """n, avgdl of the index: one row, kept beside it."""
    return derived(spark, root, "index_size", ["messages"], lambda: indexed(spark, root).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(words(F.col("text")))).alias("avgdl")))


def bm25(spark: SparkSession, root: str, query: Sequence[str], stemmed: bool = False, limit: int | None = None, **scope) -> DataFrame:
    """conv_id, id, score of messages that hold all the query's terms; the corpus' statistics aren't scoped.

    ``scope``: kind, conversation (an id), sender, since, until.
    """
    terms = sorted({t.lower() for t in query})
    if stemmed:
        from threadlake.functions.porter import fold

        terms = sorted({stem(fold(t)) for t in terms})
    stats = statistics(spark, root).first()
    parts = [r[0] for r in spark.range(1).select(F.explode(F.transform(F.array(*[F.lit(t) for t in terms]), _bucket))).collect()]
    tf = index(spark, root, stemmed).filter(F.col("bucket").isin(parts) & F.col("term").isin(terms))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # as many rows as the query has terms
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / avgdl))
    scored = _scoped(tf, **scope).join(F.broadcast(df), "term").groupBy("conv_id", "id").agg(F.round(F.sum(gain), 6).alias("score"), F.count(F.lit(1)).alias("terms")).filter(F.col("terms") == len(terms))
    found = scored.select("conv_id", "id", "score")
    return found.orderBy(F.desc("score"), "conv_id", "id").limit(limit) if limit else found


def _scoped(rows: DataFrame, kind: str | None = None, conversation: str | None = None, sender: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    for column, wanted in (("kind", kind), ("conv_id", conversation), ("sender", sender)):
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    if since is not None:
        rows = rows.filter(F.col("ts") >= since)
    return rows.filter(F.col("ts") < until) if until is not None else rows


def snippet(text: str, terms: Sequence[str], width: int = 10) -> str:
    """The ``width`` tokens with most hits, hits in brackets, cuts marked with an ellipsis."""
    tokens = text.split()
    wanted = {t.lower() for t in terms}
    hit = [("".join(c for c in t.lower() if c.isalnum())) in wanted for t in tokens]
    best = max(range(max(1, len(tokens) - width + 1)), key=lambda i: (sum(hit[i : i + width]), -i))
    shown = " ".join(f"[{t}]" if h else t for t, h in zip(tokens[best : best + width], hit[best : best + width], strict=True))
    return ("…" if best else "") + shown + ("…" if best + width < len(tokens) else "")


def search(spark: SparkSession, root: str, query: Sequence[str], limit: int = 20, **scope) -> DataFrame:
    """The ``limit`` best hits with snippets."""
    top = bm25(spark, root, query, limit=limit, **scope)
    terms = list(query)
    cut = F.pandas_udf(lambda s: s.map(lambda t: snippet(t, terms)), "string")
    return top.join(indexed(spark, root).select("conv_id", "id", "text"), ["conv_id", "id"]).select("conv_id", "id", "score", cut("text").alias("snippet"))


#: Stop words of English and German, as phrase breaks.
STOPWORDS = (
    "the and for are but not you all any can had her was one our out has him his how its may new now old see two way who did get let she too use with this that from they will would there their what about which when make like time just know take into your some could them than then also only over after most these does been were more here each such very well much still what where why because "
    "der die das und ist ein eine einen dem den des mit von für auf nicht auch sich als wie aus bei nach nur noch schon wenn aber oder war wird sind hat haben kann ich wir ihr sie man zum zur über vor bis dann doch mal bitte danke"
).split()


def phrases(tokens: Column, stopwords: Sequence[str] = ()) -> Column:
    """The 1- to 3-grams of a column of topic tokens that stop words don't interrupt, with repeats."""
    breaks = F.array(*[F.lit(w) for w in [*STOPWORDS, *stopwords]])
    return ngrams(tokens, is_break=lambda t: F.array_contains(breaks, t) | (F.length(t) < 3) | t.rlike("^[0-9a-f]{5,}$"))


def message_phrases(spark: SparkSession, root: str) -> DataFrame:
    """phrase, conv_id, id, sender, ts, kind, n: the phrases of every message that no bot sent, built once and kept."""

    def build() -> DataFrame:
        rows = indexed(spark, root).filter(~is_bot(F.col("sender")) & (F.col("ts") > 0))
        # Tokens are made once per row: the generator keeps them from being folded into each n-gram.
        tokens = rows.select("conv_id", "id", "sender", "ts", "kind", F.explode(F.array(topic_tokens(F.col("text")))).alias("tokens"))
        found = tokens.select("conv_id", "id", "sender", "ts", "kind", F.explode(phrases(F.col("tokens"))).alias("phrase"))
        return found.groupBy("phrase", "conv_id", "id").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("sender", "ts", "kind")])

    return derived(spark, root, "message_phrases", ["messages"], build)


def name_words(spark: SparkSession, root: str) -> DataFrame:
    """word: the words of people's names, which break phrases."""

    def build() -> DataFrame:
        names = silver.people(spark, root).select("name").unionByName(silver.profiles(spark, root).select("name"))
        return names.select(F.explode(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{M}]{3,}"), 0)).alias("word")).distinct()

    return derived(spark, root, "name_words", ["messages", "profiles"], build)


def topic_scope(spark: SparkSession, root: str, days: int = 7, since: int | None = None, until: int | None = None, **scope) -> DataFrame:
    """since, win, base, bots: the window's start, the messages in it, those before it, and those of bots in it, which don't count. One row."""
    rows = _scoped(silver.messages(spark, root, "conv_id", "ts", "sender", "kind", "is_system", "content").filter("not is_system and content <> '' and ts > 0"), until=until, **scope)
    bot = is_bot(F.col("sender"))
    if since is None:
        newest = rows.filter(~bot).agg(F.max("ts").alias("t")).first()["t"] or 0
        since = newest - days * 86_400_000
    new = F.col("ts") >= since
    return rows.agg(F.lit(since).cast("long").alias("since"), F.count_if(new & ~bot).alias("win"), F.count_if(~new & ~bot).alias("base"), F.count_if(new & bot).alias("bots"))


def topics(spark: SparkSession, root: str, days: int = 7, least: int = 3, senders: int = 2, stopwords: Sequence[str] = (), exclude: Sequence[str] = (), names_break: bool = True, limit: int | None = None, since: int | None = None, until: int | None = None, **scope) -> DataFrame:
    """phrase, count, senders, score and first (conv_id and id of the first message) of phrases that stand out in the window against all time before.

    The window is from ``since`` (else the last ``days``) to ``until``; ``scope``: kind, conversation, sender. Bots are
    left out of both sides. Words of people's names and ``stopwords`` break phrases; phrases with a word of ``exclude``
    are dropped. score = lift * log2(1 + count), lift from document frequencies.
    """
    sizes = topic_scope(spark, root, days, since, until, **scope).first()
    found = _scoped(message_phrases(spark, root), until=until, **scope).withColumn("new", F.col("ts") >= sizes["since"])
    per_sender = found.groupBy("phrase", "sender").agg(F.sum(F.when(F.col("new"), F.col("n")).otherwise(0)).alias("count"), F.count_if("new").alias("df"), F.count_if(~F.col("new")).alias("base_df"), F.min(F.when(F.col("new"), F.struct("ts", "conv_id", "id"))).alias("first"))
    stats = per_sender.groupBy("phrase").agg(F.sum("count").alias("count"), F.sum("df").alias("df"), F.sum("base_df").alias("base_df"), F.count_if(F.col("df") > 0).alias("senders"), F.min("first").alias("first"))
    kept = stats.filter((F.col("count") >= least) & (F.col("senders") >= senders))
    # What breaks a phrase is looked for in the few phrases that are left.
    parts = F.split("phrase", " ")
    if barred := [*stopwords, *(x.lower() for x in exclude)]:
        kept = kept.filter(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in barred])))
    if names_break:
        named = kept.select("phrase", F.explode(parts).alias("word")).join(name_words(spark, root), "word", "left_semi").select("phrase").distinct()
        kept = kept.join(named, "phrase", "left_anti")
    lift = (F.col("df") / F.greatest(F.lit(1), F.lit(sizes["win"]))) / ((F.col("base_df") + 0.5) / (F.lit(sizes["base"]) + 1))
    ranked = kept.select("phrase", "count", "senders", F.round(lift * F.log2(1 + F.col("count")), 6).alias("score"), F.col("first.conv_id").alias("first_conv_id"), F.col("first.id").alias("first_id"))
    return ranked.orderBy(F.desc("score"), "phrase").limit(limit) if limit else ranked


def top_terms_per_kind(spark: SparkSession, root: str, k: int = 5) -> DataFrame:
    rows = indexed(spark, root).select("kind", F.explode(words(F.col("text"))).alias("term")).groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "term"))).filter(F.col("rank") <= k)
