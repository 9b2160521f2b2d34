"""English terms: lower case, possessives and stop words off, Porter's stems (the published algorithm).

Spark has no stemmer, so this is an Arrow function; stems of words are kept per worker in a bounded table.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The usual short list of English stop words of search engines, and Porter's suffix tables.
STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_KEPT: dict[str, str] = {}


def _shape(w: str) -> str:
    """c and v for consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w).endswith("cvc") and w[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _replace(w: str, table: list[tuple[str, str]]) -> str:
    for end, new in sorted(table, key=lambda t: -len(t[0])):
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + new if _measure(stem) > 0 else w
    return w


def porter(w: str) -> str:
    """The stem of a lower-case English word."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w[-1] == "l":
        w = w[:-1]
    return w


def terms_of(text: str | None) -> list[str]:
    out = []
    for w in _WORD.findall((text or "").lower()):
        w = re.sub(r"['’]s$", "", w)
        if w in STOP:
            continue
        s = _KEPT.get(w)
        if s is None:
            if len(_KEPT) > 200_000:
                _KEPT.clear()
            s = _KEPT[w] = porter(w)
        out.append(s)
    return out


def english_terms(text: Column) -> Column:
    """array<string> of a text's terms in order; null gives none."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(terms_of)

    return run(text)
