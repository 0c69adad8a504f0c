"""Column functions on texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Named entities that are decoded, in any case of letters; an unknown one becomes a blank.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à", "acirc": "â", "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú", "ucirc": "û", "icirc": "î", "ocirc": "ô", "ccedil": "ç", "ntilde": "ñ",
    "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·", "euro": "€", "pound": "£", "copy": "©", "reg": "®", "trade": "™",
}
_TOKEN = re.compile(r"(<div\b[^>]*>|</p\s*>|<br\s*/?>)|(<[^>]*>)|&(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]*));", re.I)


def _piece(m: re.Match) -> str:
    if m.group(1):
        return "\n"
    if m.group(2):
        return ""
    if m.group(5):
        return ENTITIES.get(m.group(5)) or ENTITIES.get(m.group(5).lower(), " ")
    code = int(m.group(3)) if m.group(3) else int(m.group(4), 16)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else " "


def plain_text(html: str) -> str:
    """HTML as text in one pass from the left: what decoding yields is not read again."""
    text = _TOKEN.sub(_piece, html)
    text = re.sub(r"[ \t ]+", " ", text)
    text = re.sub(r" ?\n ?", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@F.pandas_udf(T.StringType())
def html_to_text(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in html:
        yield part.map(plain_text, na_action="ignore")


def strip_tags(html: Column) -> Column:
    """Breaks as line feeds, other tags off; entities stay. For whole decoding see ``html_to_text``."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?i)<div\b[^>]*>|</p\s*>|<br\s*/?>", "\n"), r"<[^>]*>", ""))


def clip(text: Column, n: int) -> Column:
    """White space collapsed, cut at n code points with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def elide_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)https?://([^\s/<>\"]+)(/[^\s<>\"]*)?", "[link: $1]")


def words(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def topic_tokens(text: Column) -> Column:
    """Words of three letters or more, apostrophes and hyphens within, without a possessive s."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}][\p{L}\p{M}'’-]{2,}"), 0)
    return F.transform(found, lambda t: F.regexp_replace(t, "['’]s$", ""))


def ngrams(tokens: Column, most: int = 3, is_break=None) -> Column:
    """All 1- to ``most``-grams of each run of tokens that no break interrupts, with repeats.

    ``tokens`` should be a column that is already made: it is read once per n-gram.
    """

    def gram(n: int) -> Column:
        at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        slices = F.transform(at, lambda i: F.slice(tokens, i, n))
        whole = F.filter(slices, lambda s: ~F.exists(s, is_break)) if is_break is not None else slices
        return F.transform(whole, lambda s: F.array_join(s, " "))

    return F.concat(*[gram(n) for n in range(1, most + 1)])


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(name, r"[\s]+"), lambda w: w != ""), lambda w: F.upper(F.substring(w, 1, 1))), "")


def conversation_kind(conv_id: Column) -> Column:
    """The kind a conversation's id tells; the order of the tests matters."""
    return (
        F.when(conv_id.contains("@unq.gbl.spaces"), "1:1")
        .when(conv_id.contains("meeting_"), "meeting")
        .when(conv_id.contains("@thread.v2"), "group")
        .when(conv_id.contains("@thread.skype") | conv_id.contains("@thread.tacv2"), "channel")
        .otherwise("other")
    )


def handle(prefix: str, id_: Column, n: int = 6) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(id_.cast("string")), 1, n))
