"""Passages decoded with the wrong character encoding, and their original text.

Every chain of UTF-8 misreadings (encode as the wrong encoding, decode as UTF-8), up to ``MAX_CHAIN``
steps, that applies to a passage gives a candidate, and so does every single confusion of two other
encodings; chains that hold such a confusion and another step are not tried. The description length of a candidate is its size
under zstandard with a dictionary of its language, plus a cost per step, plus a cost for each
character that the clean texts never use and each byte that could not be decoded. The shortest
wins; the passage stays unchanged unless a chain is shorter than no chain.

Dictionaries and alphabets are trained here, per language, on counts over all clean texts, whole: in how
many documents each character stands, how often each word. A dictionary holds the words worth most by
these counts, each within a stretch of text, until it is full; only words that have room in it reach the
driver. No count depends on how the table is split, so neither do the results.

A text with replacement characters or stray C1 controls has lost its original there; it counts as
found and its restorable passages are still restored. Null, empty and ASCII texts are never found.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.langid import detect
from evigraph.session import checkpoint, spread

MAX_CHAIN = 3
#: Bytes of a dictionary, and words of a language: more have no room in one.
DICTIONARY = 48_000
WORDS = DICTIONARY // 2
#: Longest stretch in a dictionary, longest word, characters of a piece of a longer one, words counted before a task hands them on.
STRETCH, WORD, PIECE, FLUSH = 160, 24, 4, 200_000
#: Encodings that texts get misread as, and the pairs of single- or double-byte encodings that get confused.
MISREAD = ["cp1252", "latin-1", "iso8859-15", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8-r", "cp866", "mac_cyrillic"]
CONFUSED = [(e, t) for e in ("cp1252", "latin-1", "iso8859-15", "mac_roman", "cp850", "cp437") for t in ("cp1251", "koi8-r", "cp866", "gb18030", "cp932", "euc_jp", "mac_cyrillic")]
CONFUSED += [("cp1251", "koi8-r"), ("cp1251", "cp866"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("koi8-r", "cp866"), ("cp866", "koi8-r"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic")]
LATIN_PAIRS = [("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("latin-1", "mac_roman"), ("latin-1", "cp850")]
MAX_MEMO = 100_000
STEP_UTF8, STEP_OTHER, STRANGE, LOST = 0.5, 6.0, 6.0, 3.0


def _table(name: str) -> dict[str, int]:
    """Character -> byte; bytes without a character stand for themselves, as C1 controls."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    return out


TABLES = {e: _table(e) for e in MISREAD}


def _class(table: dict[str, int], lo: int, hi: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in table.items() if lo <= b <= hi) + "]"


def _utf8_runs(table: dict[str, int]) -> re.Pattern:
    c = _class(table, 0x80, 0xBF)
    return re.compile(f"(?:{_class(table, 0xC2, 0xDF)}{c}|{_class(table, 0xE0, 0xEF)}{c}{{2}}|{_class(table, 0xF0, 0xF4)}{c}{{3}})+")


RUNS = {e: _utf8_runs(t) for e, t in TABLES.items()}
SPANS = {e: re.compile("[" + "".join(re.escape(c) for c in t) + "]+") for e, t in TABLES.items()}
_SEGMENT = re.compile(r"[^\n]*?(?:[.!?](?=\s)|\n|$)|[^\n]+", re.S)
_HIGH_RUN = re.compile(r"[^\x00-\x7f]{4,}|[^\x00-\x7f]{3}\S*\s+\S*[^\x00-\x7f]{3}")
_C1 = re.compile(r"[\x80-\x84\x86-\x9f]")
_NATIVE = {"ru": re.compile(r"[Ѐ-ӿ]"), "ja": re.compile(r"[぀-ヿ]"), "zh": re.compile(r"[一-鿿]"), "hi": re.compile(r"[ऀ-ॿ]"), "th": re.compile(r"[฀-๿]")}
LATIN = ("en", "de", "fr", "es")
FEW, UNSPACED = (*LATIN, "ru"), ("zh", "ja", "th")
_HIGH, _DIGIT = re.compile(r"[^\x00-\x7f]"), re.compile(r"\d")


def utf8_step(text: str, e: str) -> str:
    """Undo UTF-8 misread as ``e`` wherever it is valid."""
    table = TABLES[e]

    def back(m: re.Match) -> str:
        try:
            return bytes(table[c] for c in m.group()).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            return m.group()

    return RUNS[e].sub(back, text)


def other_step(text: str, e: str, t: str, whole: bool = True) -> tuple[str, int] | None:
    """(text, bytes lost) of ``t`` misread as ``e``; None if it cannot have been.

    With ``whole`` every character must come from ``e``; otherwise the stretches that do, and hold a
    run of high characters, are decoded, and what stands between them stays.
    """
    table = TABLES[e]
    lost = 0

    def decode(part: str) -> str:
        nonlocal lost
        out = bytes(table[c] for c in part).decode(t, errors="replace")
        lost += out.count("�")
        return out

    if all(c in table for c in text):
        out = decode(text)
    elif whole:
        return None
    else:
        out = SPANS[e].sub(lambda m: decode(m.group()) if _HIGH_RUN.search(m.group()) else m.group(), text)
    return (out, lost) if lost * 6 <= len(out) else None


class Model:
    """Description length under dictionaries by language."""

    def __init__(self, trained: dict[str, tuple[bytes, frozenset[str]]]):
        self.alphabets = {lang: a for lang, (_, a) in trained.items()}
        self.alphabet = frozenset().union(*self.alphabets.values()) if trained else frozenset()
        self.by = {}
        self.memo: dict[tuple[str, str], tuple[str, tuple]] = {}  # results of short passages, which recur; bounded
        for lang, (data, _) in trained.items():
            d = zstandard.ZstdCompressionDict(data, zstandard.DICT_TYPE_RAWCONTENT) if data else None
            params = zstandard.ZstdCompressionParameters.from_level(19, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.by[lang] = zstandard.ZstdCompressor(compression_params=params, dict_data=d) if d else zstandard.ZstdCompressor(compression_params=params)
        self.plain = zstandard.ZstdCompressor(level=19, write_content_size=False)

    def languages(self, text: str) -> list[str]:
        out = [l for l, r in _NATIVE.items() if r.search(text)] or list(LATIN)
        return [l for l in out if l in self.by]

    def length(self, text: str, lost: int = 0, most: float = float("inf")) -> float:
        """Description length; infinite, without compressing, where the costs besides the size reach ``most``."""
        strange = sum([1 for c in set(text) if c > "\x7f" and c not in self.alphabet])
        if STRANGE * strange + LOST * lost >= most:
            return float("inf")
        data = text.encode("utf-8", "surrogatepass")
        langs = self.languages(text)
        size = min([len(self.by[l].compress(data)) for l in langs]) if langs else len(self.plain.compress(data))
        return size + STRANGE * strange + LOST * lost


def chains(segment: str, known: frozenset[str] = frozenset()) -> Iterator[tuple[tuple, str, float, int]]:
    """(chain, text, cost, lost) of every chain of UTF-8 steps and every single other step that applies.

    Where all characters belong to the language's alphabet, no two Latin encodings were confused.
    """
    seen = {segment}
    frontier = [((), segment, 0.0)]
    for _ in range(MAX_CHAIN):
        nxt = []
        for chain, text, cost in frontier:
            for e in MISREAD:
                out = utf8_step(text, e)
                if out not in seen:
                    seen.add(out)
                    item = ((*chain, (e, "utf-8")), out, cost + STEP_UTF8)
                    nxt.append(item)
                    yield (*item, 0)
        frontier = nxt
    pairs = []
    if _HIGH_RUN.search(segment):
        able = {e for e in {e for e, _ in CONFUSED} if any(_HIGH_RUN.search(m.group()) for m in SPANS[e].finditer(segment))}
        pairs = [p for p in CONFUSED if p[0] in able]
    if not all(c in known for c in set(segment) if c > "\x7f"):
        pairs = [*pairs, *LATIN_PAIRS]
    for e, t in pairs:
        got = other_step(segment, e, t, (e, t) in LATIN_PAIRS)
        if got and got[0] not in seen:
            seen.add(got[0])
            yield ((e, t),), got[0], STEP_OTHER, got[1]


def restore_segment(segment: str, model: Model, known: frozenset[str] = frozenset()) -> tuple[str, tuple]:
    """(text, chain); the segment itself and () if nothing is shorter."""
    best, text, how = None, segment, ()
    for chain, out, cost, lost in chains(segment, known):
        if best is None:
            best = model.length(segment)
        n = model.length(out, lost, best - cost) + cost
        if n < best:
            best, text, how = n, out, chain
    return text, how


def restore(text: str | None, model: Model) -> tuple[str | None, list[str], bool]:
    """(text, chains used, whether some of the original is lost)."""
    if not text or text.isascii():
        return text, [], False
    lang = detect(text)
    known = model.alphabets.get(lang, frozenset())
    out, used = [], []
    for m in _SEGMENT.finditer(text):
        s = m.group()
        if s and not s.isascii():
            got = model.memo.get((lang, s))
            if got is None:
                got = restore_segment(s, model, known)
                if len(s) <= 400:
                    if len(model.memo) > MAX_MEMO:
                        model.memo.clear()
                    model.memo[lang, s] = got
            fixed, chain = got
            if chain:
                used.append(" > ".join(f"{e}:{t}" for e, t in chain))
            s = fixed
        out.append(s)
    lost = "�" in text or bool(_C1.search("".join(out)))
    return "".join(out), sorted(set(used)), lost


_CYRILLIC = re.compile(r"[А-Яа-яЁё]")
_NOT_RUSSIAN = re.compile(r"[Ѐ-ЏѐђѓєѕіїјљњћќѝўџѠ-ӿ─-▟√≈≤≥÷⌠⌡]|[а-яё][А-ЯЁ][А-ЯЁа-яё]|[Рр][°±µ·№»ѕј‚„…†‡€‰‹‘’“”•–—™›]")
_PAIR = re.compile(r"[^\x00-\x7f]{2,}")
_WORD_OF_ODD = re.compile(r"[\x80-\x84\x86-\x9f\xa1-\u02ff]{4,}")  # white space aside
WESTERN = ("cp1252", "latin-1", "iso8859-15", "mac_roman", "cp437", "cp850", "cp1250")


def clean(text: str) -> bool:
    """Whether a text shows no sign of a wrong encoding; for training only."""
    if text.isascii():
        return True
    if "�" in text or _C1.search(text):
        return False
    runs = " ".join(_PAIR.findall(text))
    if _WORD_OF_ODD.search(runs) or any(RUNS[e].search(runs) for e in WESTERN):
        return False
    return not (_CYRILLIC.search(text) and _NOT_RUSSIAN.search(text))


def characters(texts: Iterable[str]) -> Counter:
    """(language, character) -> texts that hold it; (language, '') -> texts."""
    out = Counter()
    for t in texts:
        lang = detect(t)
        out.update((lang, c) for c in {"", *_HIGH.findall(t)})
    return out


def alphabets(counts: Iterable[tuple[str, str, int]]) -> dict[str, frozenset[str]]:
    """Characters beyond ASCII that a language's texts use; of few letters only those that more than a few texts have."""
    by = defaultdict(dict)
    for lang, c, n in counts:
        by[lang][c] = n
    out = {}
    for lang, seen in by.items():
        docs = seen.pop("")
        least = docs * 0.02 if lang in FEW and docs >= 50 else 0
        out[lang] = frozenset(c for c, n in seen.items() if n > least)
    return out


def _words(lang: str, stretch: str) -> list[str]:
    """Words with digits alike; overlapping pieces where words are not spaced."""
    out = []
    for w in _DIGIT.sub("9", stretch).split():
        if len(w) <= (PIECE if lang in UNSPACED else WORD):
            out.append(w)
        else:
            out += [w[i : i + PIECE] for i in range(len(w) - PIECE + 1)]
    return out


def _places(word: str) -> list[tuple[str, str]]:
    """(two characters before and one after, character) of each non-ASCII character."""
    w = "  " + word
    return [(w[m.start() - 2 : m.start()] + "_" + w[m.end() : m.end() + 1], m.group()) for m in _HIGH.finditer(w)]


def words(texts: Iterable[str], known: dict[str, frozenset[str]]) -> Iterator[tuple[str, str, int, int, str]]:
    """(language, word, count, hash, stretch) over stretches of known characters; the stretch of least hash that holds the word.

    A word may come several times, to be added up.
    """
    found: dict[tuple[str, str], list] = {}

    def add(stretches: Counter) -> None:
        for (lang, s), n in stretches.items():
            if lang in FEW and not known[lang].issuperset(_HIGH.findall(s)):
                continue
            h = xxhash.xxh64_intdigest(s) >> 1
            for w in _words(lang, s):
                got = found.get((lang, w))
                if got is None:
                    found[lang, w] = [n, h, s]
                else:
                    got[0] += n
                    if (h, s) < (got[1], got[2]):
                        got[1:] = h, s

    def out() -> Iterator[tuple[str, str, int, int, str]]:
        yield from ((*k, *v) for k, v in found.items())
        found.clear()

    stretches = Counter()  # repeated ones are taken apart once
    for t in texts:
        lang = detect(t)
        for m in _SEGMENT.finditer(t):
            s = m.group()
            stretches.update((lang, s[i : i + STRETCH]) for i in range(0, len(s), STRETCH) if not s.isspace())
        if len(stretches) > FLUSH // 10:
            add(stretches)
            stretches = Counter()
        if len(found) > FLUSH:
            yield from out()
    add(stretches)
    yield from out()


def betraying(counts: dict[str, int]) -> list[str]:
    """Of the characters of one place, by count, those that stand where another one nearly always does: signs of a misread text."""
    total = sum(counts.values())
    return [c for c, k in counts.items() if k < 0.15 * total] if total >= 8 and max(counts.values()) >= 0.85 * total else []


def dictionary(lang: str, ranked: Iterable[tuple[str, str]], bad: set[tuple[str, str]]) -> bytes:
    """A dictionary of (word, stretch that holds it), worthiest first, which stand nearest to the text; a stretch with a betraying character gives way to the word alone."""
    kept, size, covered = [], 0, set()
    for w, s in ranked:
        if w in covered:
            continue
        if bad and any(p in bad for x in _words(lang, s) for p in _places(x)):
            if any(p in bad for p in _places(w)):
                continue
            s = w + " "
        data = s.encode()
        if size + len(data) > DICTIONARY:
            break
        kept.append(data)
        size += len(data)
        covered.update(_words(lang, s))
    return b"".join(reversed(kept))


def trained(texts: list[str]) -> dict[str, tuple[bytes, frozenset[str]]]:
    """Dictionary and alphabet by language of texts that show no sign of a wrong encoding; ``train`` without Spark."""
    known = alphabets((*k, n) for k, n in characters(texts).items())
    table: dict[str, dict[str, tuple]] = defaultdict(dict)
    for lang, w, n, h, s in words(texts, known):
        before = table[lang].get(w, (0, h, s))
        table[lang][w] = (before[0] + n, *min((h, s), before[1:]))
    out = {}
    for lang in known:
        place = defaultdict(Counter)
        for w, (n, _, _) in table[lang].items():
            for ctx, c in _places(w) if lang in LATIN else ():
                place[ctx][c] += n
        bad = {(ctx, c) for ctx, counts in place.items() for c in betraying(counts)}
        ranked = sorted(table[lang].items(), key=lambda x: (-x[1][0] * _worth(x[0]), x[0]))[:WORDS]
        out[lang] = (dictionary(lang, ((w, s) for w, (_, _, s) in ranked), bad), known[lang])
    return out


def _worth(word: str) -> int:
    """Bytes that one use of a dictionary's word saves, about."""
    return max(1, len(word.encode()) - 2)


def _rows(run: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over the rows of all batches of a task, as a function for ``mapInArrow``."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for row in run(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            got.append(row)
            if len(got) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), schema)], schema=schema)
                got = []
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), schema)], schema=schema)

    return over


def train(df: DataFrame, text_col: str = "text") -> dict[str, tuple[bytes, frozenset[str]]]:
    """Dictionary and alphabet by language, from counts over all clean texts."""
    texts = spread(df.select(text_col).filter(F.length(text_col) > 0))
    text, num = pa.string(), pa.int64()
    count = _rows(lambda rows: ((*k, n) for k, n in characters(t for (t,) in rows if clean(t)).items()), pa.schema([("lang", text), ("c", text), ("n", num)]))
    known = alphabets(map(tuple, texts.mapInArrow(count, "lang string, c string, n long").groupBy("lang", "c").agg(F.sum("n")).collect()))  # at most the characters there are
    shared = df.sparkSession.sparkContext.broadcast(known)
    count = _rows(lambda rows: words((t for (t,) in rows if clean(t)), shared.value), pa.schema([("lang", text), ("w", text), ("n", num), ("h", num), ("s", text)]))
    table = texts.mapInArrow(count, "lang string, w string, n long, h long, s string").groupBy("lang", "w").agg(F.sum("n").alias("n"), F.min(F.struct("h", "s"))["s"].alias("s"))
    table = checkpoint(table)
    worth = F.col("n") * F.greatest(F.lit(1), F.octet_length("w") - 2)
    top = table.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(worth.desc(), "w"))).filter(F.col("rank") <= WORDS).select("lang", "rank", "w", "s")
    latin = F.col("lang").isin(*LATIN)  # elsewhere every letter is beyond ASCII, so that a place of three says little
    at = _rows(lambda rows: ((lang, *p, n) for lang, w, n in rows for p in _places(w)), pa.schema([("lang", text), ("ctx", text), ("c", text), ("n", num)]))
    places = table.filter(latin).select("lang", "w", "n").mapInArrow(at, "lang string, ctx string, c string, n long").groupBy("lang", "ctx", "c").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang", "ctx")
    places = places.withColumns({"total": F.sum("n").over(w), "most": F.max("n").over(w)}).filter("total >= 8 and most >= 0.85D * total and n < 0.15D * total")
    at = _rows(lambda rows: ((lang, *p) for lang, s in rows for p in {p for w in _words(lang, s) for p in _places(w)}), pa.schema([("lang", text), ("ctx", text), ("c", text)]))
    asked = top.filter(latin).select("lang", F.explode(F.array("w", "s")).alias("s")).mapInArrow(at, "lang string, ctx string, c string").distinct()
    bad = defaultdict(set)
    for lang, ctx, c in places.join(asked, ["lang", "ctx", "c"], "left_semi").select("lang", "ctx", "c").collect():
        bad[lang].add((ctx, c))
    ranked = defaultdict(list)
    for lang, _, w, s in sorted(map(tuple, top.collect())):
        ranked[lang].append((w, s))
    return {lang: (dictionary(lang, ranked[lang], bad[lang]), known[lang]) for lang in known}


def find_garbled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, restored, chains, lossy) of the rows that hold a wrongly decoded passage; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(train(df, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for b in batches:
            at, texts, used, lossy = [], [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                fixed, how, lost = restore(t, model)
                if how or lost:
                    at.append(r)
                    texts.append(fixed)
                    used.append(how)
                    lossy.append(lost)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(texts, pa.string()), pa.array(used, pa.list_(pa.string())), pa.array(lossy, pa.bool_())], names=[id_col, "restored", "chains", "lossy"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"`{id_col}` {kind}, restored string, chains array<string>, lossy boolean")
