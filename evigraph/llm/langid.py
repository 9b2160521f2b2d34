"""Language of a text from its script and, for Latin script, its function words.

Stated codes are brought to two letters first (``de-DE``, ``zh_CN``, ``eng``); ``und``, null and
unknown codes count as missing. The text decides where it says something clearly.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import regex

#: Three-letter codes and function words that tell the Latin-script languages apart.
ISO3 = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru", "zho": "zh", "chi": "zh", "jpn": "ja", "hin": "hi", "tha": "th"}
KNOWN = {"en", "de", "fr", "es", "ru", "zh", "ja", "hi", "th"}
WORDS = {
    "en": "the and of were was with at for in to by is on from as without until".split(),
    "de": "der die das und wurde wurden mit bei für den im nicht zu laut vor von auf".split(),
    "fr": "le la les des du ont été et avec au dans une sont sur pour été à".split(),
    "es": "el los las se del en la y con fue según por una antes como veces".split(),
}
_BEYOND = re.compile(r"[Ѐ-ӿऀ-ॿ฀-๿぀-ヿ㐀-鿿豈-﫿]")
#: Rows of 32 code points: (first, end) of the blocks of each script.
_ROWS = {"kana": [(0x3040, 0x3100)], "zh": [(0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00)], "ru": [(0x400, 0x520)], "hi": [(0x900, 0x980)], "th": [(0xE00, 0xE80)], "latin": [(0x40, 0x80), (0xC0, 0x260)]}
#: Word -> the languages it tells of.
_TELLS = {w: tuple(l for l, ws in WORDS.items() if w in ws) for w in sorted({w for ws in WORDS.values() for w in ws})}


def _scripts(text: str) -> dict[str, int]:
    """Characters of each script."""
    rows = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") >> 5, minlength=0x800)
    return {k: int(sum(rows[a >> 5 : b >> 5].sum() for a, b in spans)) for k, spans in _ROWS.items()}


@lru_cache(maxsize=4096)
def canonical_lang(code: str | None) -> str | None:
    """Two-letter code of a stated language, or null."""
    if not code:
        return None
    c = regex.split(r"[-_\s]", code.strip().lower())[0]
    c = ISO3.get(c, c)
    return c if c in KNOWN else None


def detect(text: str | None, stated: str | None = None) -> str:
    """Two-letter language of a text; ``und`` where neither text nor statement says any."""
    said = canonical_lang(stated)
    if not text or not text.strip():
        return said or "und"
    other, best = {}, ""
    if not text.isascii() and _BEYOND.search(text):
        size = _scripts(text)
        east = size["kana"] + size["zh"]
        other = {"ja" if size["kana"] * 20 > east else "zh": east * 3, "ru": size["ru"], "hi": size["hi"], "th": size["th"]}
        best = max(other, key=other.__getitem__)
        if other[best] and other[best] * 2 >= size["latin"]:
            return best
    count = Counter(map(_TELLS.get, text.lower().split()))
    score = {l: sum([n for tells, n in count.items() if tells and l in tells]) for l in WORDS}
    top = sorted(score.items(), key=lambda x: -x[1])
    if top[0][1] >= 2 and top[0][1] > 1.5 * top[1][1]:
        return top[0][0]
    if said in WORDS or said and not other.get(best):
        return said
    return top[0][0] if top[0][1] else (best if other.get(best) else said or "und")
