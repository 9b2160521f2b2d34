"""Matching references to papers without a shared key.

1. Common words are those of many titles (document frequency over all papers); the others are
   rare. Their number is bounded by share, not by the data's size.
2. Blocking (titles of common words only by pairs of their three least frequent words): one-deletion variants of each rare title word, which any two spellings but for one
   slip share (words of 0.01 to 0.1 % of titles with each common word of the title instead); and
   the attributes identifier, and author with year where a reference names no title. One join on
   64-bit block keys gives the candidate pairs.
3. Features per pair: title words missing from the reference, words it has besides, rare word
   found, truncation, year distance, first author, venue. Words compare by edit distance and as
   abbreviations.
4. A logistic classifier is trained on weak labels: pairs that an identifier names, against
   other candidates of the same references (a bounded sample of ``sample_refs`` references, at most
   ``SAMPLE_PAIRS`` labels each, their features made on the executors).
   Half of the sample fits, the other half calibrates (Platt).
5. An agreeing identifier adds evidence (three units of log odds) to the choice; a contradicting one
   decides nothing. The best candidate whose score reaches ``threshold`` is the match. Its
   confidence is the calibrated probability by text, authors, year and venue alone, so a match that
   rests on its identifier can show one below ``threshold``.

Null fields and empty texts are missing evidence; a reference without any gets no row. Repeated
rows of a reference are harmless: its best candidate over all of them counts once. Empty tables
give no rows.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.session import checkpoint
from evigraph.sources import hash_sample

COMMON_SHARE, COMMON_LEAST = 0.001, 12
WARM_SHARE, WARM_LEAST = 0.0001, 64
SAMPLE_REFS, SAMPLE_PAIRS = 6_000, 64
#: Words that carry no content in a title or a citation.
STOP = set("a an the of and in on for with to from by at as or et al others amp beta b in".split())
ROMAN = frozenset("i ii iii iv v vi vii viii ix x".split())
_TAG = regex.compile(r"</?\w{1,6}>")
_TOKEN, _FOREIGN = re.compile(r"[^\W_]+"), re.compile(r"[^\W_\x00-\x7f]")
_BLANK = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))
_ACCENTS = regex.compile(r"\p{Mn}+")
_YEAR = regex.compile(r"(?<!\d)(?:19|20)\d\d(?!\d)")
_DOI, _ARXIV, _PMC = regex.compile(r"10\.\d{4,9}/\S+"), regex.compile(r"\d{4}\.\d{4,5}"), regex.compile(r"(?i)PMC\d+")
_CUT = regex.compile(r"…|\[\.\.\.\]|\.\.\.")
_TAIL_MARKS = set('.”"/<([')
NAMES = ["missing", "extra", "cover", "rare", "cut", "no_title", "year0", "year1", "year_off", "author", "authors", "venue", "bare_author_year", "bare_venue"]
#: Used only where the sample yields too few labels of either kind.
DEFAULT = np.array([-3.5, -3.5, 3.0, 2.0, -0.3, -3.0, 1.2, 0.4, -0.8, 1.0, 1.0, 0.3, 1.5, 2.5, -1.0])


def fold(text: str | None) -> str:
    """Lower case without markup, entities, accents and ligatures."""
    if not text:
        return ""
    if "<" in text or "&" in text:
        text = _TAG.sub("", html.unescape(text))
    if not text.isascii():
        text = text.replace("β", "beta").replace("Β", "beta").replace("ß", "ss")
        text = _ACCENTS.sub("", unicodedata.normalize("NFKD", text))
    return text.lower()


def words(text: str) -> list[str]:
    """The stretches of letters and digits of a text; in ASCII and marks, as most are, without a pattern."""
    if not text.isascii():
        if _FOREIGN.search(text):
            return _TOKEN.findall(text)
        text = text.encode("ascii", "replace").decode()
    return text.translate(_BLANK).split()


_BITS: dict[str, int] = {}


def _bits(word: str) -> int:
    """64-bit map of a word's letter pairs, to drop unlike words cheaply; kept in a bounded table."""
    out = _BITS.get(word)
    if out is None:
        p, out = f"^{word}$", 0
        for i in range(len(p) - 1):
            out |= 1 << (ord(p[i]) * 31 + ord(p[i + 1]) * 7) % 63
        if len(_BITS) > 300_000:
            _BITS.clear()
        _BITS[word] = out
    return out


def _deletions(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


class Poster:
    """Block keys of rare words: their one-deletion variants, so that words but for one slip share a key.

    Words of many titles that are not common yet (``warm``) would give large blocks; they are posted
    with each common word beside them in the title instead, a slip in them mended first.
    """

    def __init__(self, common: frozenset[str], warm: frozenset[str] = frozenset()):
        self.common, self.warm = common, warm
        self.slips: dict[str, list[str]] = {}
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        for w in sorted(common | warm):
            if len(w) > 4:
                for v in _deletions(w):
                    self.slips.setdefault(v, []).append(w)
                for n in range(len(w) - 1, len(w) + 2):
                    self.heads.add(w[: _spared(n)])
                    self.tails.add(w[-_spared(n) :])
        self.mended: dict[str, tuple[str, ...]] = {}
        self.readings: dict[str, tuple[bool, int, tuple[str, ...]]] = {}

    def mend(self, token: str) -> tuple[str, ...]:
        """The common and warm words that a token is but for one slip; none if it is one itself."""
        k = _spared(len(token))
        if len(token) < 4 or not (token[:k] in self.heads or token[-k:] in self.tails):
            return ()
        got = self.mended.get(token)
        if got is None:
            if len(self.mended) > 200_000:
                self.mended.clear()
            got = ()
            if token not in self.common and token not in self.warm and not token.isdigit():
                near = {w for v in _deletions(token) for w in self.slips.get(v, ())}
                got = tuple(w for w in sorted(near) if one_slip(w, token))
            self.mended[token] = got
        return got

    def reading(self, token: str) -> tuple[bool, int, tuple[str, ...]]:
        """(known, letters, warm) of a token: whether it is a common word, a slip mended; its length if it may be posted, else 0; the warm words it can be."""
        got = self.readings.get(token)
        if got is None:
            if len(self.readings) > 200_000:
                self.readings.clear()
            mended = self.mend(token)
            warm = (token,) if token in self.warm else tuple(w for w in mended if w in self.warm)
            common = token in self.common
            got = self.readings[token] = (common or any(w in self.common for w in mended), 0 if common or token.isdigit() else len(token), warm)
        return got

    def keys(self, tokens: list[str], near: bool, least: int, done: frozenset[str] = frozenset()) -> tuple[set[str], set[int]]:
        """(words, keys): the rare words of at least ``least`` letters but those ``done``, to be posted by their variants, and the keys of warm ones; with ``near`` only of those beside a common word (citations hold names, too)."""
        common, named, out = self.common, set(), set()
        get, reading = self.readings.get, self.reading
        read = [get(t) or reading(t) for t in tokens]
        read += [(False, 0, ())] * 2  # so that the first word and the last ones have neighbours
        context = None
        for i, (_, letters, forms) in enumerate(read):
            if letters < least:
                continue
            t = tokens[i]
            is_warm = t in self.warm
            if t in done and not is_warm or near and not (read[i - 1][0] or read[i + 1][0] or read[i + 2][0]):
                continue
            if not is_warm:
                named.add(t)
            for w in forms:
                if context is None:
                    context = {c for x in tokens for c in ((x,) if x in common else self.mend(x)) if c in common and c not in STOP}
                out.update(_key(f"w:{w}|{c}") for c in context or {""})
        return named, out

    def posts(self, token: str) -> bool:
        """Whether a title word is posted by itself."""
        return len(token) >= 5 and token not in self.common and not token.isdigit()

    def kind(self, tokens: list[str]) -> tuple[bool, bool]:
        """(plain, alone): whether a title has no word that is posted, and whether none of its posted words has a common one beside it."""
        rare = [i for i, t in enumerate(tokens) if self.posts(t)]
        known = [t in self.common for t in tokens]
        return bool(tokens) and not rare, bool(rare) and not any((i and known[i - 1]) or any(known[i + 1 : i + 3]) for i in rare)

    def plain_title(self, tokens: list[str], counts: dict[str, int]) -> set[int]:
        """Keys of a title without posted words: the pairs of its three least frequent words, so that one of them may be missing."""
        few = sorted({t for t in tokens if t not in STOP}, key=lambda t: (counts.get(t, 0), t))[:3]
        return {_key("p:" + "|".join(sorted(x))) for x in (combinations(few, 2) if len(few) > 1 else [tuple(few)])}

    def plain_reference(self, title: list[str], citation: list[str]) -> set[int]:
        """Keys that meet ``plain_title``: all pairs of words that can stand in such a title, slips mended."""
        out = set()
        for tokens in (title, citation):
            can = {w for t in tokens if t not in STOP for w in ((t,) if not self.posts(t) else self.mend(t)) if w not in STOP}
            out.update(_key("p:" + "|".join(x)) for x in combinations(sorted(can), 2))
            if len(can) == 1:
                out.add(_key("p:" + next(iter(can))))
        return out


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text, seed=77) - 2**63


def _spared(letters: int) -> int:
    """A slip leaves at least so many letters as they are at one end of a word of ``letters`` letters, slipped or not."""
    return max(1, (letters - 1) // 2)


#: A word's hash is the sum of its letters' numbers times powers of an odd base, so that all variants of
#: all words come from sums over the letters before and after the one left out.
_BASE = 0xD6E8FEB86659FD93
_INVERSE = np.uint64(pow(_BASE, -1, 2**64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered over all 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variant_keys(rare: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of keys of each word, all keys one word after the other): keys of the word and its one-deletion variants."""
    forms, of = [], []
    for i, w in enumerate(rare):
        forms.append(w)
        of.append(i)
        if "rn" in w:  # also read as m
            forms.append(w.replace("rn", "m"))
            of.append(i)
    letters = np.fromiter(map(len, forms), np.int64, len(forms))
    parts, counts = [], np.zeros(len(forms), np.int64)
    for n in np.unique(letters).tolist():
        at = np.flatnonzero(letters == n)
        codes = np.frombuffer("".join([forms[j] for j in at.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
        powers = np.cumprod(np.full(n, _BASE, np.uint64))
        before = np.zeros((len(at), n + 1), np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64) * _STEP) * powers, axis=1, out=before[:, 1:])
        whole = before[:, n:]
        cut = before[:, :n] + _INVERSE * (whole - before[:, 1:])
        keys = _mixed(np.hstack([whole + np.uint64(n), cut + np.uint64(n - 1)]))
        new = np.ones(keys.shape, bool)
        new[:, 2:] = codes[:, 1:] != codes[:, :-1]  # either of two equal letters leaves the same variant
        counts[at] = new.sum(1)
        parts.append((at, keys, new))
    starts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    for at, keys, new in parts:
        out[(starts[at][:, None] + np.cumsum(new, axis=1) - 1)[new]] = keys[new].view(np.int64)
    return np.bincount(of, counts, len(rare)).astype(np.int64), out


def posted_keys(posted: list[tuple[set[str], set[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each distinct key of each row's words and of its further keys."""
    at: dict[str, int] = {}
    which = np.array([at.setdefault(w, len(at)) for named, _ in posted for w in named], np.int64)
    sizes, keys = variant_keys(list(at))
    n = sizes[which]
    take = np.repeat((np.cumsum(sizes) - sizes)[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    row = np.repeat(np.repeat(np.arange(len(posted)), [len(named) for named, _ in posted]), n)
    row = np.concatenate([row, np.repeat(np.arange(len(posted)), [len(own) for _, own in posted])])
    key = np.concatenate([keys[take], np.array([k for _, own in posted for k in own], np.int64)])
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def identifiers(doi: str | None, arxiv: str | None, pmc: str | None, citation: str | None = None) -> list[str]:
    """Paper ids that the identifiers name."""
    out = []
    for d in (doi, citation):
        m = _DOI.search(d.lower()) if d else None
        if m:
            out.append("doi:" + m.group().rstrip(".,;:)]}"))
    if arxiv and (m := _ARXIV.search(arxiv)):
        out.append("arxiv:" + m.group())
    if pmc and (m := _PMC.search(pmc)):
        out.append("pmc:" + m.group().upper())
    return list(dict.fromkeys(out))


def _distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def one_slip(a: str, b: str) -> bool:
    """Equal but for one letter more, fewer or other, or two swapped."""
    n = min(len(a), len(b))
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < n and a[p] == b[p]:
        p += 1
    s = 0
    while s < n - p and a[-1 - s] == b[-1 - s]:
        s += 1
    x, y = len(a) - p - s, len(b) - p - s
    return max(x, y) <= 1 or (x == y == 2 and a[p] == b[p + 1] and a[p + 1] == b[p])


def same_word(a: str, b: str) -> bool:
    """Equal but for a slip, or one the other's abbreviation. Numbers and numerals must be equal."""
    if a == b:
        return True
    if a.isdigit() or b.isdigit() or a in ROMAN or b in ROMAN or a[0].isdigit() or b[0].isdigit():
        return False
    n = min(len(a), len(b))
    if n >= 3 and (a.startswith(b) or b.startswith(a)) and abs(len(a) - len(b)) > 2 and max(len(a), len(b)) >= 6:
        return True
    if n < 3 or (a[0] != b[0] and a[-2:] != b[-2:]) or abs(len(a) - len(b)) > 3:
        return False  # a slip spares a word's beginning or its end
    a, b = a.replace("rn", "m"), b.replace("rn", "m")
    return one_slip(a, b) or (n > 5 and _distance(a, b, 2) <= 2)


def _places(tokens: list[str]) -> dict[str, list[int]]:
    at: dict[str, list[int]] = {}
    for j, w in enumerate(tokens):
        at.setdefault(w, []).append(j)
    return at


def _compare(title: list[str], other: list[str], at: dict[str, list[int]], gaps: list[str] | None, cut: bool) -> tuple[int, int, float, set[int]]:
    """(missing, extra, cover, matched) of the title's content words in the other words, which are one title if no gaps between them are given; at: where each stands."""
    whole = gaps is None
    match: dict[int, int] = {}
    used: set[int] = set()
    content = [i for i, t in enumerate(title) if t not in STOP]
    for i in content:
        for j in at.get(title[i], ()):
            if j not in used:
                match[i] = j
                used.add(j)
                break
    if len(match) * 3 < len(content):
        return 5, 5, len(match) / max(1, len(content)), set(match)
    lo, hi = min(match.values()), max(match.values())
    for i in content:
        if i not in match:
            for j in range(0 if whole else max(0, lo - 4), len(other) if whole else min(len(other), hi + 5)):
                if j not in used and other[j] not in STOP and same_word(title[i], other[j]):
                    match[i] = j
                    used.add(j)
                    break
    lo, hi = min(match.values()), max(match.values())
    last = max(match)
    missing = sum(1 for i in content if i not in match and not (cut and i > last))
    end = len(other) if whole else hi + 1
    if gaps is not None:
        while end < len(other) and _TAIL_MARKS.isdisjoint(gaps[end]):
            end += 1
    extra = sum(1 for j in range(0 if whole else lo, end) if j not in used and other[j] not in STOP and not (cut and j > hi))
    return missing, extra, len(match) / max(1, len(content)), set(match)


def _within(title_text: str, title: list[str], text: str, other: list[str], gaps: list[str] | None) -> tuple | None:
    """The result of ``_compare`` where the whole title stands in the text word for word; None elsewhere."""
    at = text.find(title_text) if title else -1
    if at < 0:
        return None
    lo = text.count(" ", 0, at)
    end = hi = lo + len(title)
    if gaps is None:
        more = other[:lo] + other[hi:]
    else:
        while end < len(other) and _TAIL_MARKS.isdisjoint(gaps[end]):
            end += 1
        more = other[hi:end]
    return 0, sum(w not in STOP for w in more), 1.0, range(len(title)), False


def _acronym(venue: list[str]) -> str:
    return "".join(w[0] for w in venue if w not in STOP)


@lru_cache(4096)
def _venue(venue: str | None) -> tuple[str, list[str], list[str]]:
    """(initials, content words, their first three letters) of a venue; there are few of them."""
    v = words(fold(venue))
    content = [w for w in v if w not in STOP]
    return _acronym(v), content, [w[:3] for w in content]


def _named(content: list[str], heads: list[str], ref: Reference) -> bool:
    """Whether a venue's words, or their abbreviations, stand in a reference in their order."""
    at = 0
    for w, head in zip(content, heads):
        if len(head) < 3:
            return False
        while True:
            try:
                at = ref.heads.index(head, at) + 1
            except ValueError:
                return False
            if w.startswith(ref.words[at - 1][: max(3, len(ref.words[at - 1]) - 1)]):
                break
    return True


def is_bare(tokens: list[str], common: frozenset[str]) -> bool:
    return sum(t in common and t not in STOP for t in tokens) < 4


class Reference:
    """A reference's texts, prepared once for all its candidates."""

    def __init__(self, citation: str | None, title: str | None, year: int | None, common: frozenset[str]):
        r = fold(title)
        self.title = words(r) if r.strip() else None
        self.title_cut = bool(_CUT.search(r))
        self.folded = fold(citation)
        self.words = words(self.folded)
        self.year = year
        self.all = {*self.words, *(self.title or ())}
        self.common = common

    # what only promising candidates need

    @cached_property
    def gaps(self) -> list[str]:
        """What stands before each word; a mark in it may end the title."""
        return _TOKEN.split(self.folded)

    @cached_property
    def places(self) -> dict[str, list[int]]:
        return _places(self.words)

    @cached_property
    def title_places(self) -> dict[str, list[int]]:
        return _places(self.title or [])

    @cached_property
    def heads(self) -> list[str]:
        return [w[:3] for w in self.words]

    @cached_property
    def bare(self) -> bool:
        """Whether it names no title: none given, and hardly a common title word in the citation."""
        return not self.title and is_bare(self.words, self.common)

    @cached_property
    def cut(self) -> bool:
        return bool(_CUT.search(self.folded))

    @cached_property
    def years(self) -> list[int]:
        return [self.year] if self.year else [int(y) for y in _YEAR.findall(self.folded)]

    @cached_property
    def early(self) -> set[str]:
        return set(self.words[:14] + self.words[-14:])

    @cached_property
    def text(self) -> str:
        return f" {' '.join(self.words)} "

    @cached_property
    def title_text(self) -> str:
        return f" {' '.join(self.title)} " if self.title else ""

    @cached_property
    def odd(self) -> list[str]:
        """Its rare words; needed only where no rare word of a paper stands in it."""
        return [w for w in self.all if len(w) >= 4 and w not in self.common]


class Paper:
    """A paper's attributes, prepared once for all its candidates; most of them only when needed."""

    def __init__(self, title: str | None, year: int | None, venue: str | None, authors: str | None, common: frozenset[str]):
        self.words = words(fold(title))
        self.rare = [w for w in self.words if len(w) >= 5 and w not in common]
        self.year = year
        self._venue, self._authors = venue, authors

    @cached_property
    def text(self) -> str:
        return f" {' '.join(self.words)} "

    @cached_property
    def venue(self) -> tuple[str, list[str], list[str]]:
        return _venue(self._venue)

    @cached_property
    def authors(self) -> tuple[list[str], list[str]]:
        """Name words of the first author and of the others."""
        names = (self._authors or "").split(";")
        return [w for w in words(fold(names[0])) if len(w) >= 4], [w for w in words(fold(" ; ".join(names[1:]))) if len(w) >= 4]


def _like(a: str, bits_a: int, b: str, bits_b: int) -> bool:
    """Whether two rare words are one but for a slip, by their letter pairs first (a slip takes at most three)."""
    rn = "rn" in a or "rn" in b
    if (bits_a & ~bits_b).bit_count() > 3 and not rn:
        return False
    return one_slip(a, b) or (rn and one_slip(a.replace("rn", "m"), b.replace("rn", "m")))


def _slipped(rare: list[str], ref: Reference) -> bool:
    """Whether a rare word stands in the reference but for a slip; most words differ at both ends and are left at that."""
    for w in rare:
        n, rn = len(w), "rn" in w
        k = _spared(n)
        head, tail = w[:k], w[-k:]
        for x in ref.odd:
            if rn or "rn" in x or (-2 < len(x) - n < 2 and (x.startswith(head) or x.endswith(tail))):
                if _like(w, _bits(w), x, _bits(x)):
                    return True
    return False


#: Features of a pair without a rare word in common, where the reference names a title.
NOTHING = [5.0, 5.0] + [0.0] * 12


def features(paper: Paper, ref: Reference, common: frozenset[str]) -> list[float]:
    """One row of NAMES."""
    t, rare, p_year = paper.words, paper.rare, paper.year
    seen = not rare or not ref.all.isdisjoint(rare) or _slipped(rare, ref)
    if not seen and not ref.bare:
        return NOTHING
    first, others = paper.authors
    author, coauthor = not ref.early.isdisjoint(first), not ref.early.isdisjoint(others)
    rows = []
    if seen:
        if ref.title:
            rows.append(_within(paper.text, t, ref.title_text, ref.title, None) or _compare(t, ref.title, ref.title_places, None, ref.title_cut) + (ref.title_cut,))
        if ref.words and not (rows and rows[0][0] + rows[0][1] == 0 and not ref.title_cut):  # a full title decides alone
            rows.append(_within(paper.text, t, ref.text, ref.words, ref.gaps) or _compare(t, ref.words, ref.places, ref.gaps, ref.cut) + (ref.cut,))
    no_title = ref.bare and (not rows or max(r[2] for r in rows) < 0.4)
    best = max(rows, key=lambda r: (-(r[0] + r[1]), r[2], not r[4]), default=(5, 5, 0.0, set(), False))
    if len(rows) == 2 and not rows[0][4] and rows[0][2] >= 0.4 and rows[1][4]:
        best = rows[0]
    if no_title:  # nothing to compare: authors, year and venue decide
        best = (0, 0, 0.0, set(), False)
    found = not no_title and (not rare or any(t[i] in rare for i in best[3]))
    off = min((abs(y - p_year) for y in ref.years), default=None) if p_year else None
    initials, content, heads = paper.venue
    has_venue = bool(content and ref.words) and (initials in ref.early or _named(content, heads, ref))
    y0, y1 = off == 0, off == 1
    return [float(x) for x in (min(best[0], 5), min(best[1], 5), best[2], found, best[4], no_title, y0, y1, off is not None and off > 1, author, coauthor, has_venue, no_title and (author or coauthor) and y0, no_title and has_venue and y0)]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the constant."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - penalty * w
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(penalty), g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(x: np.ndarray, y: np.ndarray, fold_of: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights and Platt scaling (slope, constant): one half fits, the other calibrates."""
    a, b = fold_of == 0, fold_of == 1
    if min((y[a] == 1).sum(), (y[a] == 0).sum(), (y[b] == 1).sum(), (y[b] == 0).sum()) < 20:
        return DEFAULT, 1.0, 0.0
    w = fit(x[a], y[a])
    z = x[b] @ w[:-1] + w[-1]
    slope, constant = fit(z[:, None], y[b], ridge=1e-3)
    return (w, float(slope), float(constant)) if slope > 0 else (w, 1.0, 0.0)


def reference_keys(h: Poster, citation: str | None, title: str | None, year: int | None, doi: str | None, arxiv: str | None, pmc: str | None, plain: bool, alone: bool) -> tuple[set[str], set[int]]:
    """(rare words, further keys) of a reference; plain, alone: what some title needs, see ``Poster.kind``."""
    # a letter may be missing from a rare word of five
    named = words(fold(title)) if title else []
    rare, own = h.keys(named, False, 4)
    text = fold(citation)
    tokens = words(text)
    for mine, more in zip((rare, own), h.keys(tokens, not alone, 4, frozenset(named))):
        mine |= more
    if plain:
        own |= h.plain_reference(named, tokens)
    if not title and is_bare(tokens, h.common):
        for y in {year} if year else set(_YEAR.findall(text)):
            own.update(_key(f"{w}|{y}") for w in {*tokens[:14], *tokens[-14:]} if len(w) >= 4 and w not in h.common and not w.isdigit())
    if doi or arxiv or pmc or citation and "10." in citation:
        own.update(_key(p) for p in identifiers(doi, arxiv, pmc, citation if citation and "10." in citation else None))
    return rare, own


def match(papers: DataFrame, refs: DataFrame, authors: DataFrame | None = None, threshold: float = 0.5, sample_refs: int = SAMPLE_REFS) -> DataFrame:
    """(ref_row_id, paper_id, confidence): the cited paper of each reference that has one.

    papers: paper_id, title, pub_year, venue; refs: ref_row_id, raw_citation, title, pub_year, doi,
    arxiv_id, pmc_id; authors: paper_id, author_pos, author_name. Paper ids must be unique.
    """
    spark = papers.sparkSession
    titled = papers.select("paper_id", "title", F.col("pub_year").alias("p_year"), "venue").filter(F.col("paper_id").isNotNull())
    if authors is not None:
        named = authors.filter("author_name is not null").groupBy("paper_id").agg(F.array_sort(F.collect_set(F.struct("author_pos", F.replace("author_name", F.lit(";"), F.lit(" ")).alias("n")))).alias("a"))
        first = named.select("paper_id", F.array_join(F.transform("a", lambda x: x["n"]), ";").alias("author_names"))
        titled = titled.join(first, "paper_id", "left")
    else:
        titled = titled.withColumn("author_names", F.lit(None).cast("string"))
    titled = checkpoint(titled)  # read by five plans below
    # words of many titles: at most (words per title) / COMMON_SHARE of them exist
    plain = F.lower(F.regexp_replace(F.coalesce("title", F.lit("")), "[β]", "beta"))
    counts = titled.select(F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0)))).alias("w")).groupBy("w").count()
    n_papers = titled.count()
    many = {r["w"]: r["count"] for r in counts.filter(F.col("count") >= min(max(COMMON_LEAST, COMMON_SHARE * n_papers), max(WARM_LEAST, WARM_SHARE * n_papers))).collect()}
    common = frozenset(w for w, n in many.items() if n >= max(COMMON_LEAST, COMMON_SHARE * n_papers)) | STOP
    warm = frozenset(w for w, n in many.items() if n >= max(WARM_LEAST, WARM_SHARE * n_papers)) - common
    shared = spark.sparkContext.broadcast(common)
    shared_warm = spark.sparkContext.broadcast(warm)
    shared_counts = spark.sparkContext.broadcast({w: n for w, n in many.items() if w in common})

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Poster(shared.value, shared_warm.value)
        for b in batches:
            seen = [h.kind(words(fold(t))) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([any(k[i] for k in seen)], pa.bool_()) for i in range(2)], names=["plain", "alone"])

    # references post further keys where titles need them
    needs = titled.select("title").mapInArrow(kinds, "plain boolean, alone boolean").agg(F.bool_or("plain"), F.bool_or("alone")).first()
    plain, alone = bool(needs[0]), bool(needs[1])
    slim = refs.select("ref_row_id", "raw_citation", F.col("title").alias("r_title"), F.col("pub_year").alias("r_year"), "doi", "arxiv_id", "pmc_id").filter(F.col("ref_row_id").isNotNull())

    def keyed(posted: list[tuple[set[str], set[int]]], ids: pa.Array, name: str) -> pa.RecordBatch:
        rows, keys = posted_keys(posted)
        return pa.RecordBatch.from_arrays([pa.array(keys), ids.take(pa.array(rows))], names=["key", name])

    def paper_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Poster(shared.value, shared_warm.value)
        for b in batches:
            posted = []
            for pid, title, year, _, author in zip(*(c.to_pylist() for c in b.columns)):
                named = words(fold(title))
                rare, own = h.keys(named, False, 5)
                if plain and h.kind(named)[0]:
                    own |= h.plain_title(named, shared_counts.value)
                own.add(_key(pid))
                if author and year:
                    own.update(_key(f"{w}|{year}") for w in set(words(fold(author))) if len(w) >= 4)
                posted.append((rare, own))
            yield keyed(posted, b.column(0), "paper_id")

    def ref_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Poster(shared.value, shared_warm.value)
        for b in batches:
            posted = [reference_keys(h, *v, plain, alone) for v in zip(*(c.to_pylist() for c in b.columns[1:]))]
            yield keyed(posted, b.column(0), "ref_row_id")

    # pairs travel as numbers: 64-bit hashes of paper ids, resolved on both sides of the join
    p_keys = titled.mapInArrow(paper_keys, "key long, paper_id string").select("key", F.xxhash64("paper_id").alias("paper_no"))
    described = titled.withColumn("paper_no", F.xxhash64("paper_id"))

    def pairs_of(some: DataFrame, bounded: bool = False) -> DataFrame:
        """Candidate pairs with their texts; the references of the bounded sample are given to every task, so no paper moves for them."""
        posted = some.mapInArrow(ref_keys, "key long, ref_row_id long")
        if bounded:
            some, posted = F.broadcast(some), F.broadcast(posted)
        pairs = posted.join(p_keys, "key").select("ref_row_id", "paper_no").distinct()
        return pairs.join(described, "paper_no").drop("paper_no").join(some, "ref_row_id")

    order = ["ref_row_id", "paper_id", "title", "p_year", "venue", "author_names", "raw_citation", "r_title", "r_year", "doi", "arxiv_id", "pmc_id"]

    def rows_of(b: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*(c.to_pylist() for c in b.columns))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, xs, ys = [], [], []
            for v in rows_of(b):
                named = v[1] in identifiers(v[9], v[10], v[11])
                f = features(Paper(v[2], v[3], v[4], v[5], shared.value), Reference(v[6], v[7], v[8], shared.value), shared.value)
                if named and f[2] < 0.4 and not f[5]:
                    continue  # the identifier contradicts the text: no label
                if named and f[5] and not ((f[9] or f[10]) and (f[6] or f[7])):
                    continue
                if not named and f[0] + f[1] == 0 and f[5] == 0:
                    continue  # an identifier may be wrong
                rid.append(v[0])
                xs.append(f)
                ys.append(float(named and (bool(f[5]) or f[0] + f[1] < 4)))
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.float64())], names=["ref_row_id", "x", "y"])

    # features are made on the executors; at most SAMPLE_PAIRS labels of a sampled reference reach the driver
    sample = hash_sample(slim.filter("doi is not null or arxiv_id is not null or pmc_id is not null"), "ref_row_id", sample_refs)
    labelled = pairs_of(sample, True).select(*order).mapInArrow(label, "ref_row_id long, x array<double>, y double")
    few = Window.partitionBy("ref_row_id").orderBy(F.desc("y"), F.xxhash64("x"))
    got = labelled.withColumn("_n", F.row_number().over(few)).filter(F.col("_n") <= SAMPLE_PAIRS).select("ref_row_id", "x", "y").orderBy("ref_row_id", "x").collect()
    xs, ys, folds = [r["x"] for r in got], [r["y"] for r in got], [r["ref_row_id"] % 2 for r in got]
    model = train(np.array(xs), np.array(ys), np.array(folds)) if len(xs) > 80 else (DEFAULT, 1.0, 0.0)
    learned = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, slope, constant = learned.value
        weights = w.tolist()
        least = math.log(threshold / (1 - threshold))
        papers_seen: dict[str, Paper] = {}
        for b in batches:
            rid, pid, rank, conf = [], [], [], []
            last, ref, named = None, None, []
            for v in rows_of(b):
                if v[0] != last:
                    last, ref, named = v[0], Reference(v[6], v[7], v[8], shared.value), identifiers(v[9], v[10], v[11])
                p = papers_seen.get(v[1])
                if p is None:
                    if len(papers_seen) > 50_000:
                        papers_seen.clear()
                    p = papers_seen[v[1]] = Paper(v[2], v[3], v[4], v[5], shared.value)
                f = features(p, ref, shared.value)
                if f is NOTHING:  # far below any threshold
                    continue
                z = slope * (sum([a * b for a, b in zip(f, weights)]) + weights[-1]) + constant
                if v[1] in named and (f[2] >= 0.6 and f[0] + f[1] <= 2 or f[5] and (f[6] or f[7] or f[9] or f[10] or not (v[6] or "").strip())):
                    chosen = z + 3.0  # the choice weighs an agreeing identifier, the confidence does not
                else:
                    chosen = z
                if chosen < least:
                    continue
                rid.append(v[0])
                pid.append(v[1])
                rank.append(-chosen)
                conf.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(pid, pa.string()), pa.array(rank, pa.float64()), pa.array(conf, pa.float64())], names=["ref_row_id", "paper_id", "rank", "confidence"])

    scored = pairs_of(slim).select(*order).mapInArrow(score, "ref_row_id long, paper_id string, rank double, confidence double")
    best = scored.groupBy("ref_row_id").agg(F.min(F.struct("rank", "paper_id", "confidence")).alias("m"))
    return best.select("ref_row_id", F.col("m.paper_id").alias("paper_id"), F.round("m.confidence", 4).alias("confidence"))
