"""A text as a person reads it, with the way back to the original.

Tags are off (blocks leave a line break, mentions leave marks), link targets (mailto:, tel:) are read as text, entities
and compatibility forms are decoded, and invisible characters are gone. Each character of the view knows its place in
the original, so that replacing a span leaves all other text and markup as it is.
"""

from __future__ import annotations

import html
import re
import unicodedata

from threadlake.llm.leaks import INVISIBLE

#: Marks around the text of a mention tag.
OPEN, CLOSE = "\x02", "\x03"

_PIECE = re.compile(r"<!--.*?-->|</?([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*)?)/?>|&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", re.S)
_HREF = re.compile(r"(?:href|data-[\w-]+|title)\s*=\s*(?:\"(?:mailto:|tel:)([^\"?]+)|'(?:mailto:|tel:)([^'?]+))", re.I)
#: Tags that may stand within a word; all others set a break.
_INLINE = frozenset("a abbr acronym b big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr".split())
_GONE = {c for a, b in INVISIBLE[:-1] for c in map(chr, range(a, b + 1))}
_DASHES = dict.fromkeys(map(chr, [*range(0x2010, 0x2016), 0x2212, 0xFE58, 0xFE63, 0xFF0D]), "-")

_SPECIAL = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in INVISIBLE[:-1]) + "".join(_DASHES) + "\xa0]")


def _as_read(text: str) -> bool:
    """Whether each character is read as itself."""
    return not _SPECIAL.search(text) and unicodedata.is_normalized("NFKC", text)


def _char(c: str) -> str:
    """What is read for one character; '' for none."""
    if c < "\x7f":
        return c
    if c in _GONE:
        return ""
    if c in _DASHES:
        return "-"
    if c == "\xa0":
        return " "
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 else " " if n.isspace() else c


class View:
    """``text`` is the view; ``starts`` and ``ends`` the places of its characters in the original, -1 where they have none; None where the two are the same."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, original: str):
        if "<" not in original and "&" not in original and (original.isascii() or _as_read(original)):
            self.text, self.starts, self.ends = original, None, None
            return
        out: list[str] = []
        starts: list[int] = []
        ends: list[int] = []

        def add(start: int, end: int) -> None:
            piece = original[start:end]
            if piece.isascii() or _as_read(piece):
                out.extend(piece)
                starts.extend(range(start, end))
                ends.extend(range(start + 1, end + 1))
                return
            for i in range(start, end):
                # A mark that combines with the letter before it is read with that letter.
                if out and starts[-1] >= 0 and unicodedata.combining(original[i]):
                    both = unicodedata.normalize("NFC", out[-1] + original[i])
                    if len(both) == 1:
                        out[-1], ends[-1] = both, i + 1
                        continue
                if c := _char(original[i]):
                    out.append(c)
                    starts.append(i)
                    ends.append(i + 1)

        def mark(c: str) -> None:
            out.append(c)
            starts.append(-1)
            ends.append(-1)

        at = 0
        for m in _PIECE.finditer(original):
            add(at, m.start())
            at = m.end()
            piece = m.group()
            if piece[0] == "&":
                decoded = html.unescape(piece)
                if decoded == piece:
                    add(m.start(), m.end())
                    continue
                for c in decoded:
                    if c := _char(c):
                        out.append(c)
                        starts.append(m.start())
                        ends.append(m.end())
            elif piece[1] != "!" and m.group(2).strip("/ ") and "=" not in m.group(2):  # no attributes: an address in angle brackets
                add(m.start(), m.end())
            elif piece[1] != "!":
                name = m.group(1).lower()
                if name == "at":
                    mark(CLOSE if piece[1] == "/" else OPEN)
                elif name not in _INLINE:
                    mark("\n")
                elif h := _HREF.search(piece):
                    g = 1 if h.group(1) is not None else 2
                    mark("\n")
                    add(m.start() + h.start(g), m.start() + h.end(g))
                    mark("\n")
        add(at, len(original))
        self.text, self.starts, self.ends = "".join(out), starts, ends

    def runs(self, start: int, end: int) -> list[tuple[int, int]]:
        """The stretches of the original that a span of the view covers; markup between them is left out."""
        if self.starts is None:
            return [(start, end)]
        found: list[tuple[int, int]] = []
        for a, b in zip(self.starts[start:end], self.ends[start:end], strict=True):
            if a < 0:
                continue
            if found and a <= found[-1][1]:
                found[-1] = (found[-1][0], max(found[-1][1], b))
            else:
                found.append((a, b))
        return found


def replace(original: str, view: View, spans: list[tuple[int, int, str]]) -> str:
    """The original with each span (start, end, type in the view) replaced by ``[TYPE]``; all else is unchanged."""
    cuts: list[tuple[int, int, str]] = []
    for start, end, kind in spans:
        runs = view.runs(start, end)
        for k, (a, b) in enumerate(_joined(original, runs)):
            cuts.append((a, b, f"[{kind.upper()}]" if k == 0 else ""))
    for a, b, text in sorted(cuts, reverse=True):
        original = original[:a] + text + original[b:]
    return original


def _joined(original: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs with only invisible characters between them are one."""
    out: list[tuple[int, int]] = []
    for a, b in runs:
        if out and all(c in _GONE for c in original[out[-1][1] : a]):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
