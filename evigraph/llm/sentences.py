"""Sentence units of texts in any script, with their places.

Terminators are the characters of the property Sentence_Terminal, the ellipsis and, in Devanagari,
the vertical bar; Thai, which has none, ends a sentence at white space between Thai letters. The standard
break rules are refined by:

* layout - an empty line always ends a unit; a single line break only around list items and
  headings, otherwise it can stand inside a sentence;
* quotes and brackets - marks inside a closed pair end nothing; at its end, what follows decides
  (a colon before the pair, a capital after it, a sentence in brackets of its own);
* abbreviations by language - some never end a sentence, some end it before a capital;
* numbers - decimals, ordinals, dates, section numbers, lot numbers, addresses;
* citation marks and note numbers written directly after the final mark belong to the unit;
* continuation - a question or exclamation before a lower-case word or a dash goes on, while
  names such as mRNA or pH may open a sentence.

Offsets count code points from 0, ends are exclusive, units have no white space at their ends.
Null, empty and blank texts have no units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.langid import detect

#: Abbreviations that never end a sentence, by language.
NEVER = {
    "en": "dr prof mr mrs ms st fig figs eq eqs ref refs sect sec suppl supp tab no nos vol vols pp p cf ca vs e.g i.e approx exp cat ch chap gen col lt gov sen rep dept viz incl eds",
    "de": "dr prof hr fr abb tab nr nrn vgl bzw ca kap abs gem max evtl ggf bspw sog z.b d.h u.a i.d.r v.a s ziff art st inkl zzgl geb str bd aufl hrsg",
    "fr": "m mm dr pr me fig figs tabl tab cf env ex p.ex p pp no art chap éd vol ph av apr réf",
    "es": "dr dra sr sra srta d dña fig figs tabl tab cap pág págs p.ej ej aprox núm n.º n ee art vol ed ref lic ing prof",
    "ru": "рис табл см напр ул д проф г.г стр с т.е т.д т.п акад доц им пл корп кв гл ср т",
    "hi": "डॉ प्रो श्री",
}
#: Abbreviations and units that end a sentence only before a capital.
MAYBE = {
    "en": "etc al a.m p.m inc ltd corp co ff s.d s.e.m ed u.s e.u ph.d min max hr hrs sp spp p.o i.v i.p s.c wt jr sr bio s.a",
    "de": "usw etc min h s std u.s.w ff co ltd inc corp v.chr al sek",
    "fr": "etc al co ltd inc corp s.a min h",
    "es": "etc ss uu al co ltd inc corp s.a min h vd ud",
    "ru": "др г след гг в вв мин с ч руб тыс млн inc ltd corp co s.a",
    "hi": "",
}
#: Capitalised words after 'a.m.'/'p.m.' and dates that go on, and words that open sentences.
DAYS = set("monday tuesday wednesday thursday friday saturday sunday januar februar märz april mai juni juli august september oktober november dezember january february march june july october december".split())
OPENERS = set("the a an we in on at as for all after before by with this these those it they two no to from was is if when while see each both cells data samples images animals values settings by unless briefly der die das den dem am im ein eine für laut zum zur vgl ca les le la l’étiquette au à il elle des une un el los las un una en como se según".split())
_ORDINAL_BEFORE = set("am die der das dem den des im vom zum beim bis ab jede jeder jedes seit".split())
_TERM = regex.compile(r"[\p{Sentence_Terminal}…．|]+")
#: Marks that can stand inside a sentence; every other terminator ends one wherever it stands.
_WEAK = ".!?…"
_PARA = regex.compile(r"[^\S\n\r]*(?:\r\n|\n|\r| )[^\S\n\r]*(?:\r\n|\n|\r| )\s*|\s* \s*|\s*\f\s*")
_LINE = regex.compile(r"[^\S\n\r]*(?:\r\n|\n|\r| )\s*")
_ITEM = regex.compile(r"(?:[•‣▪◦●○·*∙–—‐-]\s+|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)]\s+|[①-⑳]\s*)\S")
_OPEN_END = regex.compile(r"(?i:\b(?:nr|no|fig|figs|abb|tab|tabl|kap|vol|pp|p|cap|pág|núm|eq|ref|refs|sec|sect|ca|approx|env|aprox|рис|табл|стр|д)\.|\b[zdui]\.)$")
_NUMBERED = regex.compile(r"(?:\p{Lu}\p{L}*\p{Lu}\p{L}*|\b(?i:type|phase|class|grade|stage|table|part))$")
_DASH_ITEM = regex.compile(r"[–—‐-]\s")
_ENDS = regex.compile(r"[.!?…。！？｡．।॥|:：;][\"'”’»“)\]」』）]*(?:\[[^\]\n]{1,30}\]|\d{1,3}(?:,\s?\d{1,3})*)?$")
_CLOSE = regex.compile(r"(?:[\"”’'»)\]」』）】》〉]|“(?!\w)|[   ]»)+")
_MARK = regex.compile(r"(?:\[[^\]\n]{1,40}\]|[⁰¹²³⁴-⁹]+(?:[,⁻–][⁰¹²³⁴-⁹]+)*|\d{1,3}(?:[,–-]\d{1,3})*(?![\w.,%:]|\s?[×%]))")
_WORDBACK = regex.compile(r"[^\s(（\[«„“\"「,，;:、；：/]+$")
_LOWUP = regex.compile(r"[a-zα-ω]{1,3}[A-ZА-Я][\w-]*")
_CASELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Devanagari}\p{Thai}\p{Arabic}\p{Hebrew}]")
_THAI = regex.compile(r"(?<=[\p{Thai}])\s+(?=[\p{Thai}])")
_PAIRS = {"(": ")", "（": "）", "[": "]", "«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "《": "》", "【": "】"}
_PAIRED = re.compile("[" + re.escape("".join({*_PAIRS, *_PAIRS.values(), '"'})) + "]")
_DIGITS = regex.compile(r"\d+$")
_WIDTH, _HEADING = 48, 36

_rx = lru_cache(maxsize=256)(regex.compile)  # the library's own cache costs more than the searches here


def _lexicon(lang: str) -> tuple[frozenset, frozenset]:
    langs = [lang] if lang in NEVER else list(NEVER)
    if lang not in ("en", "ru", "hi"):
        langs = [*langs, "en"]
    never = frozenset(w for x in langs for w in NEVER[x].split())
    maybe = frozenset(w for x in langs for w in MAYBE[x].split())
    if lang in MAYBE:  # the text's own language decides where lists differ
        own_never, own_maybe = set(NEVER[lang].split()), set(MAYBE[lang].split())
        never, maybe = frozenset(own_never | (never - own_maybe)), frozenset(own_maybe | (maybe - own_never))
    return never, maybe - never


_LEX: dict[str, tuple[frozenset, frozenset]] = {}


def _pairs(s: str) -> dict[int, int]:
    """Closed quotes and brackets: opening -> closing position."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    straight = -1
    for m in _PAIRED.finditer(s):
        i, ch = m.start(), m.group()
        if ch == '"':
            if straight < 0:
                straight = i
            else:
                out[straight], straight = i, -1
        elif stack and ch == _PAIRS[stack[-1][0]] and not (ch == "“" and stack[-1][0] != "„"):
            out[stack.pop()[1]] = i
        elif ch in _PAIRS:
            stack.append((ch, i))
        elif ch in ")）]»”」』》】":
            for k in range(len(stack) - 1, -1, -1):
                if _PAIRS[stack[k][0]] == ch:
                    out[stack[k][1]] = i
                    del stack[k:]
                    break
    return out


def _ends(s: str, lang: str) -> list[int]:
    """Ends of the sentences of one block of running text."""
    never, maybe = _LEX.get(lang) or _LEX.setdefault(lang, _lexicon(lang))
    pairs = _pairs(s)
    inside: list[tuple[int, int]] = sorted(pairs.items())
    hindi = _rx(r"\p{Devanagari}").search(s) is not None
    out: list[int] = []
    n, at, closed = len(s), 0, 0
    for m in _TERM.finditer(s):
        i, j = m.span()
        if i < at:
            continue
        mark = m.group()
        if "|" in mark and not (hindi and set(mark) == {"|"} and i and (_rx(r"[\p{Devanagari}\]\")]").match(s[i - 1]))):
            continue
        c = _CLOSE.match(s, j)
        end = c.end() if c else j
        # a mark within a closed pair that does not reach the pair's end
        holder = None
        while closed < len(inside) and inside[closed][1] <= i:  # closed before this mark and all later ones
            closed += 1
        for a, b in inside[closed : closed + 1] or ():
            if a < i < b:
                holder = (a, b)
        for a, b in inside[closed + 1 :] if not holder and closed < len(inside) and inside[closed][0] < i else ():
            if a < i < b:
                holder = (a, b)
                break
            if a > i:
                break
        if holder and not (c and end > holder[1]):
            continue
        if c and not holder and c.group() in ('"', "'", "’") and end < n and s[end].isalnum():
            c, end = None, j  # an opening quote without white space before it
        nxt = s[end] if end < n else ""
        before = s[i - 1] if i else ""
        dot = mark == "."
        if not before or (mark == "." and (before.isspace() or before in "<>=≤≥~±(–-×" and s[j : j + 1].isdigit())):  # .5 mg
            continue
        cjk = bool(_CASELESS.match(before)) or mark[0] not in _WEAK and mark[0] != "|"
        # citation marks and note numbers directly after the final mark
        cite = _MARK.match(s, end) if nxt and (nxt == "[" or nxt.isdigit() or nxt in "⁰¹²³⁴⁵⁶⁷⁸⁹") else None
        word = _WORDBACK.search(s[max(at, i - 60) : i])
        w = word.group() if word else ""
        if not hindi and _CASELESS.search(w):
            w = _rx(r"[\p{Latin}\d.]*$").search(w).group()
        w = w[_rx(r"(?:\p{L}[’'])?").match(w).end() :] or w
        lw = w.lower().lstrip("([{\"'«“„")
        if cite and nxt.isdigit():
            ok = not mark[0] == "." or (not before.isdigit() and "/" not in w and lw not in never and lw not in maybe and not (len(w) == 1 and w.isupper()) and not _rx(r"\d").search(w.rstrip(")%]")[:1] or "") and not _rx(r"[a-z]\.[a-z]").search(lw))
            if cjk and mark[0] == ".":
                ok = False
            cite = cite if ok else None
        if cite:
            end = cite.end()
            nxt = s[end] if end < n else ""
        if nxt and not nxt.isspace():
            # a boundary without white space
            if nxt in ",;:)]}，；：、）」』”»—–-/%":
                continue
            if mark[0] not in _WEAK and mark[0] != "|":
                pass
            elif mark[0] == "…" and _CASELESS.match(nxt) or dot and _rx(r"\p{Thai}").match(before):
                continue
            elif _CASELESS.match(nxt):
                if not (cjk or before in ")]）】%\"”" or cite or mark[0] in "!?"):
                    continue
                if cjk and dot and before.isdigit():
                    continue
            elif mark[0] in "!?":
                if not (nxt.isupper() or nxt in "\"“«„¿¡(["):
                    continue
            elif mark[0] == "…" or len(mark) > 1:
                if not nxt.isupper():
                    continue
            elif cjk and dot:
                if not (nxt.isupper() or nxt in "“「（("):
                    continue
            elif cite or c:
                if not (nxt.isupper() or nxt in "\"“«„¿¡("):
                    continue
            else:
                follow = s[end : end + 24]
                plain = _rx(r"(?:\p{Ll}{2}|[)\]%]|°C|\d\p{Ll}|\s\p{Ll})$").search(s[max(0, i - 3) : i])
                starts = _rx(r"\p{Lu}(?:\p{Ll}|[’'-]?\p{Lu}?\p{Ll}|\s)|\p{Lu}{2,}\b(?!\.)|[\"“«„¿¡(]|\p{Lu}-").match(follow) or _LOWUP.match(follow)
                if not plain or not starts or lw in never or "/" in w or "." in lw or _rx(r"\p{Lu}\.").match(follow):
                    continue
                if lw in maybe and not _rx(r"\p{Lu}").match(follow):
                    continue
            if cjk and holder and c and s[holder[0]] not in "(（[" and not _colon(s, holder[0]):
                continue
            out.append(end)
            at = end
            continue
        k = end
        while k < n and s[k].isspace():
            k += 1
        rest = s[k : k + 40]
        if not rest:
            out.append(end)
            at = end
            continue
        first = rest[0]
        nw = _rx(r"[\w’'-]+").match(rest.lstrip("\"“«„¿¡(["))
        nw = nw.group() if nw else ""
        upper = first.isupper() or (first in "\"“«„‚¿¡([‘（「" and len(rest) > 1) or bool(_CASELESS.match(first))
        lowup = bool(_LOWUP.match(rest))
        if (c or mark[0] in "!?") and first in "–—-" and not _ITEM.match(rest):
            continue
        if first in "–—" and mark[0] in "!?":
            continue
        if first in ",;:)]»”":
            continue
        if mark[0] not in _WEAK:
            if holder and c and s[holder[0]] not in "(（[" and not _colon(s, holder[0]):
                continue
            out.append(end)
            at = end
            continue
        if mark[0] in "!?":
            if c and holder and _CASELESS.match(first) and s[holder[0]] not in "(（[":
                continue
            if not (upper or lowup or first.isdigit() or first in "•*"):
                continue
            if mark == "!" and c and holder and s[holder[0] + 1 : holder[1]] == "!":
                continue
            out.append(end)
            at = end
            continue
        if mark[0] == "…" or len(mark) > 1:
            if upper or lowup:
                out.append(end)
                at = end
            continue
        if c or cite:
            if c and holder and s[holder[0]] in "([（" and lw in never:
                continue
            if not cite and not (upper or lowup or first.isdigit() or first in "•*-–"):
                continue
            if cite and not (upper or lowup or first.isdigit() or first.islower() or first in "•*-–αβ"):
                continue
            out.append(end)
            at = end
            continue
        if _abbreviation(s, i, w, lw, rest, nw, (upper and first not in "([（" or _opens(s, k, pairs.get(k))) or lowup, lang, never, maybe):
            continue
        out.append(end)
        at = end
    for m in _THAI.finditer(s):
        if not any(a < m.start() < b for a, b in inside):
            out.append(m.start())
    return sorted(set(out))


def _opens(s: str, k: int, closing: int | None) -> bool:
    """Whether the bracket at k starts a sentence: it holds one of its own, or a capitalised word follows it."""
    if closing is None or s[k] not in "(（":
        return False
    if s[closing - 1] in ".!?。！？" and s[k + 1].isupper():
        return True
    after = s[closing + 1 : closing + 4].lstrip()
    return s[closing + 1 : closing + 2].isspace() and after[:1].isupper()


def _colon(s: str, opening: int) -> bool:
    """Whether a colon introduces the quote that opens here."""
    k = opening - 1
    while k >= 0 and s[k].isspace():
        k -= 1
    return k >= 0 and s[k] in ":："


def _abbreviation(s: str, i: int, w: str, lw: str, rest: str, nw: str, upper: bool, lang: str, never: frozenset, maybe: frozenset) -> bool:
    """Whether the full stop at i, before white space, belongs to the word before it."""
    core = lw.rstrip(")]")
    if not core:
        return False
    prior = s[max(0, i - len(w) - 12) : i - len(w)].rstrip()
    if core.isdigit() or _rx(r"[\d.,]+").fullmatch(core):
        line = max(s.rfind("\n", 0, i), s.rfind("\r", 0, i)) + 1
        if s[line : i - len(w)].strip() == "" and len(core) <= 3 and core.isdigit() and "." not in core:
            return line == 0  # a list number at the block's start
        if lang == "de":
            last = _rx(r"[\p{L}.]+$").search(prior)
            if nw.lower() in DAYS:
                return True
            if last and last.group().lower() in _ORDINAL_BEFORE and core.isdigit():
                return True
            return not upper
        return not (upper or rest[0].isdigit() or rest[0] in "•*–-") and not rest[0].islower()
    if core in ("°c", "c") and prior.endswith(("°", "0", "1", "2", "3", "4", "5", "6", "7", "8", "9")) or w.endswith("°C"):
        return False
    quantity = bool(_rx(r"[\d×]$").search(prior))
    if core in maybe:
        if lang == "ru" and core in ("г", "с", "в") and not quantity:
            return True
        if nw.lower() in DAYS and core in ("a.m", "p.m"):
            return True
        if core in ("u.s", "e.u", "ph.d") and nw.lower() not in OPENERS:
            return True
        return not upper
    if core in never:
        if core in ("no", "max", "art", "ch", "rep", "gen", "col") and not rest[0].isdigit() and upper and nw.lower() in OPENERS and not w[0].isupper():
            return False
        if core in ("s", "d", "m", "p", "с", "д", "t") and quantity:
            return not upper
        return True
    if len(core) == 1 and core.isalpha():
        if w[-1].isupper():  # an initial, unless a known word opens the next sentence
            if prior.endswith("°"):
                return False
            if core in "ivx" and upper and _NUMBERED.search(prior):
                return False
            return nw.lower() not in OPENERS or not upper or len(nw) < 2 and nw != "A"
        return not (upper and quantity)
    if _rx(r"(?:\p{L}{1,2}\.)+\p{L}{1,3}").fullmatch(core):  # dotted
        return not (upper and nw.lower() in OPENERS)
    return False


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans that no unit crosses: paragraphs, cut further around list items and headings."""
    spans, at = [], 0
    for m in _PARA.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    for a, b in spans:
        lines, p = [], a
        for m in _LINE.finditer(text, a, b):
            lines.append((p, m.start()))
            p = m.end()
        lines.append((p, b))
        lines = [(x, y) for x, y in lines if text[x:y].strip()]
        start = None
        item = False
        for k, (x, y) in enumerate(lines):
            line = text[x:y].strip()
            prev = text[lines[k - 1][0] : lines[k - 1][1]].rstrip() if k else ""
            clean = not k or (bool(_ENDS.search(prev)) and not _OPEN_END.search(prev)) or item
            now_item = bool(_ITEM.match(line)) and (clean and not (_DASH_ITEM.match(line) and prev[-1:] in ("”", "»", "“", '"')) or not _DASH_ITEM.match(line) and not line[0].isalnum() and line[0] != "(")
            broken = False
            if start is None:
                start = x
            elif now_item:
                broken = True
            elif item:
                broken = not (line[0].islower() and len(prev) >= _WIDTH)
            elif k and start == lines[k - 1][0] and not _ENDS.search(prev) and _heading(prev, line, text[y - 1 : y]):
                broken = True
            elif k and not _ENDS.search(line) and _ENDS.search(prev) and len(line) < _WIDTH and (k + 1 == len(lines) or _heading(line, text[lines[k + 1][0] : lines[k + 1][1]].strip(), "")):
                broken = True
            if broken:
                yield (start, lines[k - 1][1])
                start = x
            item = now_item or (item and not broken)
        if start is not None:
            yield (start, b)


def _heading(line: str, after: str, _: str) -> bool:
    if len(line) >= (_HEADING if not _CASELESS.search(line) else 20) or not after:
        return False
    if line[-1] in ",，、-–—(（" or _rx(r"[,;，；]").search(line):
        return False
    f = after.lstrip("\"“«„¿¡([「『（")[:1]
    return bool(f) and (f.isupper() or f.isdigit() and len(line) < 30 and not line[0].isdigit() or bool(_CASELESS.match(f)) or bool(_LOWUP.match(after)) or after[:1] in "•–-*")


def units(text: str | None, stated: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit in text order."""
    if not text or text.isspace():
        return []
    lang = detect(text, stated)
    out: list[tuple[int, int]] = []
    for a, b in _blocks(text):
        s = text[a:b]
        at = 0
        for e in [*_ends(s, lang), len(s)]:
            x, y = at, e
            while x < y and s[x].isspace():
                x += 1
            while y > x and s[y - 1].isspace():
                y -= 1
            if x < y:
                out.append((a + x, a + y))
            at = e
    return out


def sentence_units(df: DataFrame, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """(id, sentence_no, start_pos, end_pos): the units of each row's text; no shuffle.

    Repeated rows give repeated units; the stated language only helps where the text is mute.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, no, starts, ends = [], [], [], []
            for r, (text, lang) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                u = units(text, lang)
                rows += [r] * len(u)
                no += range(len(u))
                starts += [x for x, _ in u]
                ends += [y for _, y in u]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[id_col, "sentence_no", "start_pos", "end_pos"])

    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    return df.select(F.col(id_col), F.col(text_col).alias("_t"), lang.alias("_l")).filter("_t is not null").mapInArrow(run, f"`{id_col}` {kind}, sentence_no int, start_pos int, end_pos int")
