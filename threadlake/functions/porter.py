"""Porter's stemmer of 1980 and folding of diacritics."""

from __future__ import annotations

import re
import unicodedata


def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _forms(stem: str) -> str:
    """The stem as a string of c and v; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(stem):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _forms(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _forms(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _forms(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return len(word) > 2 and _forms(word)[-3:] == "cvc" and word[-1] not in "wxy"


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest(word: str, endings):
    return max((e for e in endings if word.endswith(e[0])), key=lambda e: len(e[0]), default=None)


def porter(word: str) -> str:
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _cvc(w)):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (hit := _longest(w, table)) and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    if hit := _longest(w, [(e,) for e in _STEP4]):
        stem = w[: -len(hit[0])]
        if _measure(stem) > 1 and (hit[0] != "ion" or stem[-1:] in ("s", "t")):
            w = stem
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if _double(w) and w.endswith("l") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
