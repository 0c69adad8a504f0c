"""Evaluation passages that leak into a corpus, by template canonicalisation.

1. Texts are reduced to words: tags and link targets off, entities decoded, compatibility forms and ligatures folded,
   invisible characters removed, case folded; everything but letters, marks and digits separates words.
2. Words become template tokens: numbers, units and names turn into typed placeholders; what they held are the window's
   slots. For exact leaks names are the words the passages write with a capital within a sentence, token for token.
3. Windows of ``size`` tokens of texts and passages are joined on the hash of their tokens. Equal slots make a leak.

For re-parameterised copies (``reparameterised``) a number with its separators is one token, so are adjacent words of a
name, and windows hold at least ``FIXED`` words that are no slots. A passage's names are its words with a capital within a
sentence that are rare among the passages of their language (nouns of a language that capitalises them recur); a text's
names are those, and words with a capital that no passage uses as a fixed word. Slots map one to one exactly where the
slots of both windows repeat in the same places, so this pattern is part of the hash that is joined: a consistent copy
meets its template's class in an equi-join, and pairs of windows are never compared.

Scale: window hashes are a rolling polynomial over token hashes (numpy, per Arrow batch). While the passages' hashes
number at most ``BOUND``, they travel with the tasks and only windows that meet one leave them; beyond that bound all
windows go to the join. Either way the join is on the hash, with the slots compared inside it.

Defined results: null, empty and short texts or passages hold no window; repeated rows and items leak alike; a
passage of fewer than ``size`` words can't be found; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.session import cut

#: Successive words that make a leak.
SIZE = 12
#: Window hashes of the passages that may travel with the tasks (8 bytes each), and names that may.
BOUND, NAMES = 1_000_000, 200_000

#: Units that count as slots.
UNITS = frozenset("kg g mg lb lbs oz t m cm mm km mi ft in l ml gal s sec min h hr hrs day days hour hours minute minutes second seconds week weeks month months year years percent euro euros dollar dollars pound pounds eur usd gbp".split())
_TAG_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|a|font|code|sub|sup|small|big|mark|tt|at)\b[^<>]*>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[a-z!?][^<>]*>", re.I | re.S)
_LINK = re.compile(r"\]\([^()\s]*\)")

#: Code points that print nothing, as ranges.
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))
_INVISIBLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in INVISIBLE) + "]")
_HYPHENS = "-" + chr(0x2010) + chr(0x2011)
_HYPHEN_BREAK = re.compile(rf"(?<=[^\W\d_])[{_HYPHENS}]\r?\n[ \t>]*(?=[^\W\d_])")
#: Letters and digits, with combining marks.
_WORD = re.compile(rf"[^\W_]+(?:[{chr(0x300)}-{chr(0x36F)}]+[^\W_]*)*")
_MIX = 0x9E3779B97F4A7C15


def plain(text: str) -> str:
    """The text without markup and invisible characters, in compatibility form; case is kept."""
    if "<" in text or "&" in text:
        text = html.unescape(_TAG.sub(" ", _TAG_INLINE.sub("", text)))
        if "<" in text:
            text = _TAG.sub(" ", _TAG_INLINE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _LINK.sub("] ", text) if "](" in text else text


def words(text: str) -> list[str]:
    bare = plain(text)
    if "-\n" in bare or "-\r" in bare or "\u2010" in bare:
        bare = _HYPHEN_BREAK.sub("", bare)
    return _WORD.findall(bare.casefold())


def names_of(passage: str) -> set[str]:
    """Words with a capital within a sentence, case-folded."""
    return {m.group(1).casefold() for m in re.finditer(r"(?<=[^\s.!?:;\"“„»«(])\s+([^\W\d_a-zß-ÿ][^\W\d_]+)", plain(passage))}


class Templates:
    """Template tokens and window hashes for one set of names."""

    def __init__(self, names: frozenset[str], size: int = SIZE):
        self.names, self.size, self.known = names, size, {}
        self.powers = np.array([pow(_MIX, k, 2**64) for k in range(size)], dtype=np.uint64)

    def token(self, word: str) -> tuple[int, bool]:
        """Hash of the word's template token, and whether it is a slot."""
        kind = "#number" if word[0].isdigit() and not word.isalpha() else "#name" if word in self.names else "#unit" if word in UNITS else None
        return xxhash.xxh64_intdigest(kind or word), kind is not None

    def hashes(self, found: list[str]) -> np.ndarray:
        """One hash per window; empty if the text is shorter."""
        n = len(found) - self.size + 1
        if n < 1:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        for w in found:
            if w not in known:
                known[w] = self.token(w)
        tokens = np.fromiter((known[w][0] for w in found), np.uint64, len(found))
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.size):
                out += tokens[k : k + n] * self.powers[k]
        return out

    def slots(self, window: list[str]) -> str:
        return "\u001f".join(w for w in window if self.known[w][1])


def _window_batches(key: str, text: str, names: frozenset[str] | None, size: int, wanted: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates = Templates(names or frozenset(), size)
    for batch in batches:
        at, keys, slots = [], [], []
        own = batch.column("names").to_pylist() if names is None else None
        for i, t in enumerate(batch.column(text).to_pylist()):
            found = words(t) if t else []
            if own is not None:
                templates.names = frozenset(own[i] or ())
            hashes = templates.hashes(found)
            if not len(hashes):
                continue
            if wanted is None:
                places = range(len(hashes))
            else:
                near = np.searchsorted(wanted, hashes)
                near[near == len(wanted)] = 0
                places = np.nonzero(wanted[near] == hashes)[0].tolist() if len(wanted) else []
            for p in places:
                at.append(i), keys.append(int(hashes[p].astype(np.int64))), slots.append(templates.slots(found[p : p + size]))
        rows = batch.select([key]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(keys, pa.int64()), pa.array(slots, pa.string())], names=[key, "window", "slots"])


def _word_batches(key: str, text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, found = [], []
        for i, t in enumerate(batch.column(text).to_pylist()):
            own = set(words(t)) if t else ()
            at += [i] * len(own)
            found += own
        rows = batch.select([key]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.string())], names=[key, "name"])


def windows(df: DataFrame, key: str, text: str, names: frozenset[str] | DataFrame, size: int = SIZE, wanted: np.ndarray | None = None) -> DataFrame:
    """key, window (hash), slots (one string); with ``wanted`` (sorted hashes) only windows among them. A table of names is joined."""
    rows, kind, known = df.select(key, text), dict(df.dtypes)[key], names
    if isinstance(names, DataFrame):
        spelt = rows.mapInArrow(lambda b: _word_batches(key, text, b), f"`{key}` {kind}, name string")
        rows, known = rows.join(spelt.join(names, "name").groupBy(key).agg(F.collect_set("name").alias("names")), key, "left"), None
    return rows.mapInArrow(lambda b: _window_batches(key, text, known, size, wanted, b), f"`{key}` {kind}, window long, slots string")


def _met(docs: DataFrame, items: DataFrame, size: int, bound: int) -> tuple[DataFrame, DataFrame]:
    """The windows of documents that may meet an item's, and the items' windows."""
    given = items.filter("item_id is not null and passage is not null").select("item_id", "passage")
    most = min(bound, NAMES)
    table = given.select("passage").mapInArrow(_name_batches, "name string").distinct()
    named = table.limit(most + 1).toArrow().column(0)
    # Beyond the bound the names stay a table, and the words of each text are joined with it.
    names = frozenset(named.to_pylist()) if len(named) <= most else table
    theirs = windows(given, "item_id", "passage", names, size).distinct()
    hashes = theirs.select("window").distinct().limit(bound + 1).toArrow().column(0)
    wanted = np.sort(hashes.to_numpy().astype(np.int64).astype(np.uint64)) if len(hashes) <= bound else None
    ours = windows(docs.filter("doc_id is not null and text is not null"), "doc_id", "text", names, size, wanted)
    return ours, theirs


def _name_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: set[str] = set()
        for t in batch.column("passage").to_pylist():
            found |= names_of(t or "")
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["name"])


def leaks(docs: DataFrame, items: DataFrame, size: int = SIZE, bound: int = BOUND) -> DataFrame:
    """doc_id, item_id: the text holds ``size`` successive words of the item's passage."""
    ours, theirs = _met(docs, items, size, bound)
    return ours.distinct().join(theirs, ["window", "slots"]).select("doc_id", "item_id").distinct()


#: Words of a window for re-parameterised copies that must not be slots; and the share of a language's passages above which a word with a capital is no name.
FIXED, COMMON_SHARE = 6, 0.1
_NUMBER = r"\d+(?:[.,'’]\d{3}(?!\d))*(?:[.,]\d+)?"
_TOKEN = re.compile(rf"(?P<n>{_NUMBER})|{_WORD.pattern}")


class Canonical:
    """Tokens of texts with typed slots, for one vocabulary: names, and fixed words of the passages."""

    def __init__(self, names: frozenset[str], fixed: frozenset[str], size: int, least: int):
        self.names, self.fixed, self.size, self.least = names, fixed, size, least
        self.powers = np.array([pow(_MIX, k, 2**64) for k in range(size)], dtype=np.uint64)

    def tokens(self, text: str, free: bool) -> tuple[list[str], list[str | None]]:
        """Template tokens, and what slots hold (None for fixed words). ``free``: words with a capital that aren't fixed are names."""
        bare = plain(text)
        if "-\n" in bare or "-\r" in bare or "\u2010" in bare:
            bare = _HYPHEN_BREAK.sub("", bare)
        free = free and not bare.isupper()
        tokens: list[str] = []
        values: list[str | None] = []
        end, named = -1, False
        for m in _TOKEN.finditer(bare):
            word = m.group()
            if m.group("n"):
                tokens.append("#number"), values.append(re.sub(r"\D", "", word))
                named = False
                continue
            low = word.casefold()
            if low in UNITS:
                tokens.append("#unit"), values.append(low)
                named = False
            elif low in self.names or free and word[0].isupper() and low not in self.fixed:
                if named and m.start() == end + 1 and bare[end] in " -":
                    values[-1] += " " + low
                else:
                    tokens.append("#name"), values.append(low)
                named, end = True, m.end()
            else:
                tokens.append(low), values.append(None)
                named = False
        return tokens, values

    def windows(self, text: str, free: bool, wanted: np.ndarray | None) -> Iterator[tuple[int, int, str]]:
        """(template hash, hash of template and pattern, slots) of each window with enough fixed words."""
        tokens, values = self.tokens(text, free)
        n = len(tokens) - self.size + 1
        if n < 1:
            return
        codes = np.fromiter((_code(t) for t in tokens), np.uint64, len(tokens))
        solid = np.concatenate([[0], np.cumsum([v is None for v in values])])
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.size):
                out += codes[k : k + n] * self.powers[k]
        good = solid[self.size :] - solid[:n] >= self.least
        if wanted is not None:
            near = np.searchsorted(wanted, out)
            near[near == len(wanted)] = 0
            good &= (wanted[near] == out) if len(wanted) else False
        for p in np.nonzero(good)[0].tolist():
            held = [v for v in values[p : p + self.size] if v is not None]
            first: dict[str, int] = {}
            pattern = ",".join(str(first.setdefault(v, len(first))) for v in held)
            template = int(out[p])
            yield template, xxhash.xxh64_intdigest(f"{template}|{pattern}") - 2**63, "\x1f".join(held)


@lru_cache(maxsize=1_000_000)
def _code(token: str) -> int:
    return xxhash.xxh64_intdigest(token)


def _canonical_batches(key: str, text: str, vocabulary: tuple[frozenset[str], frozenset[str]] | None, size: int, least: int, free: bool, wanted: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = Canonical(*(vocabulary or (frozenset(), frozenset())), size, least)
    for batch in batches:
        at, templates, keys, slots = [], [], [], []
        own = None if vocabulary is not None else [batch.column(c).to_pylist() for c in ("names", "fixed")]
        for i, t in enumerate(batch.column(text).to_pylist()):
            if own is not None:
                made.names, made.fixed = (frozenset(o[i] or ()) for o in own)
            for template, window, held in made.windows(t, free, wanted) if t else ():
                at.append(i), templates.append(template - 2**63), keys.append(window), slots.append(held)
        rows = batch.select([key]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(templates, pa.int64()), pa.array(keys, pa.int64()), pa.array(slots, pa.string())], names=[key, "template", "window", "slots"])


def _vocabulary_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each passage's words, and whether it writes them with a capital within a sentence."""
    for batch in batches:
        out: list[tuple[str, str, bool]] = []
        for lang, t in zip(batch.column("lang").to_pylist(), batch.column("passage").to_pylist(), strict=True):
            capital = names_of(t or "")
            out += [(lang or "", w, w in capital) for w in set(words(t or ""))]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_())], names=["lang", "word", "capital"])


def vocabulary(items: DataFrame, share: float = COMMON_SHARE) -> DataFrame:
    """word, is_name: the words of the passages; names are written with a capital within a sentence, and rare in some language that writes them so."""
    lang = F.col("lang") if "lang" in items.columns else F.lit("")
    given = items.select(F.coalesce(lang, F.lit("")).alias("lang"), "passage")
    sizes = given.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    found = given.mapInArrow(_vocabulary_batches, "lang string, word string, capital boolean").groupBy("lang", "word").agg(F.count_if("capital").alias("capital"), F.count(F.lit(1)).alias("n"))
    rare = F.col("n") <= F.greatest(F.lit(2), F.col("size") * share)
    return found.join(sizes, "lang").groupBy("word").agg(F.bool_or((F.col("capital") > 0) & rare).alias("is_name"))


def reparameterised(docs: DataFrame, items: DataFrame, size: int = SIZE, bound: int = BOUND, least: int = FIXED) -> DataFrame:
    """doc_id, item_id, n_items, n_windows: texts that hold passages with other numbers, names or units put in one to one.

    A row per text and class of passages: items that share a window's template (and pattern of slots) can't be told apart
    by a copy with other values, so a class is named by its smallest item and counted. ``n_windows`` counts the different
    windows met. Classes of which the text holds a window with the very slots of an item (a leak) are left out.
    """
    given = items.filter("item_id is not null and passage is not null")
    most = min(bound, NAMES)
    table = vocabulary(given)
    words_ = table.limit(most + 1).toArrow()
    known = None
    if words_.num_rows <= most:
        known = tuple(frozenset(w for w, n in zip(words_.column(0).to_pylist(), words_.column(1).to_pylist(), strict=True) if n == name) for name in (True, False))

    def made(df: DataFrame, key: str, text: str, free: bool, wanted: np.ndarray | None) -> DataFrame:
        rows, kind = df.select(key, text), dict(df.dtypes)[key]
        if known is None:  # beyond the bound the words of each text are joined with the vocabulary
            spelt = rows.mapInArrow(lambda b: _word_batches(key, text, b), f"`{key}` {kind}, name string").join(table.withColumnRenamed("word", "name"), "name")
            rows = rows.join(spelt.groupBy(key).agg(F.collect_set(F.when(F.col("is_name"), F.col("name"))).alias("names"), F.collect_set(F.when(~F.col("is_name"), F.col("name"))).alias("fixed")), key, "left")
        return rows.mapInArrow(lambda b: _canonical_batches(key, text, known, size, least, free, wanted, b), f"`{key}` {kind}, template long, window long, slots string")

    theirs = cut(made(given, "item_id", "passage", False, None).distinct())
    hashes = theirs.select("template").distinct().limit(bound + 1).toArrow().column(0)
    wanted = np.sort((hashes.to_numpy().astype(np.int64).astype(np.uint64)) + np.uint64(2**63)) if len(hashes) <= bound else None
    ours = made(docs.filter("doc_id is not null and text is not null"), "doc_id", "text", True, wanted).select("doc_id", "window", "slots").distinct()
    classes = theirs.groupBy("window").agg(F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("n_items"))
    exact = theirs.select("window", "slots", F.lit(True).alias("exact")).distinct()
    met = ours.join(classes, "window").join(exact, ["window", "slots"], "left")
    return met.groupBy("doc_id", "item_id").agg(F.max("n_items").alias("n_items"), F.count_distinct("window").alias("n_windows"), F.bool_or(F.coalesce("exact", F.lit(False))).alias("leaks")).filter("not leaks").drop("leaks")
