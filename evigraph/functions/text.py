"""Text shaping as column expressions: no shuffle, no Python.

White space is the explicit class ``WS`` on both engines, since dialects differ in what ``\\s`` covers.
Nulls: every function of a null text is null, list functions give an empty list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.functions.lexicon import ABBREVIATIONS, OVERLAP_STOP

WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"(?:\x{d}\x{a}|[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}])"
_ABBR = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{ABBREVIATIONS})\.$"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def fragments(text: Column) -> Column:
    """Pieces of each line between white space that follows . ! or ?, blank ones dropped."""
    lines = F.transform(F.split(text, LINE_END), strip)
    parts = F.flatten(F.transform(lines, lambda l: F.split(l, rf"(?<=[.!?]){WS}+")))
    return F.coalesce(F.filter(F.transform(parts, strip), lambda p: p != ""), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Rule sentences in order. A fragment after an abbreviation joins the sentence before, also across lines.

    Whether to join depends on the fragment before only, so positions of sentence starts are
    filtered and slices joined: linear, without a window or a fold.
    """
    f = fragments(text)

    def build(s: Column) -> Column:
        frags, n = s["f"], F.size(s["f"])
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~F.element_at(frags, F.greatest(i, F.lit(1))).rlike(_ABBR))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(
            F.transform(F.array(F.struct(frags.alias("f"), starts.alias("s"))), lambda x: F.transform(x["s"], lambda a, k: F.array_join(F.slice(x["f"], a + 1, F.coalesce(F.try_element_at(x["s"], k + 2), F.size(x["f"])) - a), " ")))[0]
        )

    return F.transform(F.array(F.struct(f.alias("f"))), build)[0]


def stamp(sents: Column) -> Column:
    """'[i] sentence' lines, ids dense from 0."""
    return F.array_join(F.transform(sents, lambda s, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), s)), "\n")


def parse_stamped(stamped: Column) -> Column:
    """array<struct<sentence_id, text>> of stamped text; a body runs to the next stamp."""
    heads = F.regexp_extract_all(stamped, F.lit(r"(?m)^\[([0-9]+)\] "), F.lit(1))
    bodies = F.slice(F.split(stamped, r"(?:^|\n)\[[0-9]+\] "), 2, F.size(heads) + 1)
    return F.zip_with(heads, bodies, lambda i, t: F.struct(i.cast("int").alias("sentence_id"), strip(t).alias("text")))


def normalize(c: Column) -> Column:
    """White space collapsed, lower case (sharp s folded)."""
    return F.replace(F.lower(strip(F.regexp_replace(c, rf"{WS}+", " "))), F.lit("ß"), F.lit("ss"))


def pack(sizes: Column, max_size: int, max_items: int | None = None) -> Column:
    """Greedy pack numbers of items in order: a new pack starts where the size or the item limit would pass."""

    def step(st: Column, n: Column) -> Column:
        full = (st["cur"] > 0) & (st["cur"] + n > max_size)
        if max_items:
            full = full | (st["items"] >= max_items)
        return F.struct(
            F.when(full, n).otherwise(st["cur"] + n).alias("cur"),
            F.when(full, F.lit(1)).otherwise(st["items"] + 1).alias("items"),
            F.when(full, st["no"] + 1).otherwise(st["no"]).alias("no"),
            F.concat(st["out"], F.array(F.when(full, st["no"] + 1).otherwise(st["no"]))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("items"), F.lit(0).alias("no"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, start, step, lambda st: st["out"])


def tokens(c: Column, least: int = 1) -> Column:
    """Distinct lower-case ASCII alphanumeric words of at least ``least`` letters."""
    t = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(t, lambda w: F.length(w) >= least) if least > 1 else t


def meaningful_tokens(c: Column) -> Column:
    return F.array_except(tokens(c, 4), F.array(*[F.lit(w) for w in OVERLAP_STOP]))


def meaningful_overlap(a: Column, b: Column) -> Column:
    """Two shared words or more, and a fifth of the smaller set."""
    x, y = meaningful_tokens(a), meaningful_tokens(b)
    shared = F.size(F.array_intersect(x, y))
    return (shared >= 2) & (shared / F.greatest(F.least(F.size(x), F.size(y)), F.lit(1)) >= 0.2)


def candidate_supports(raw: Column, cand_raw: Column, cand_resolved: Column) -> Column:
    return meaningful_overlap(raw, cand_raw) & ((cand_resolved == cand_raw) | meaningful_overlap(raw, cand_resolved))


def title_share(citation: Column, title: Column) -> Column:
    """Share of a title's words (4 letters or more) that the citation holds; 0 for an empty title."""
    t = tokens(title, 4)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(t, tokens(citation))).cast("double"), F.size(t)), F.lit(0.0))


def share_distinctive_token(a: Column, b: Column) -> Column:
    """Two common white-space words of more than five letters."""
    long = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), rf"{WS}+")), lambda w: F.length(w) > 5)
    return F.size(F.array_intersect(long(a), long(b))) >= 2


def author_year(ident: Column, author: Column, year: Column) -> Column:
    """The author's last word and the year both occur in the identifier."""
    last = F.element_at(F.split(F.trim(F.substring_index(F.lower(author), ",", 1)), " "), -1)
    return (last != "") & F.contains(F.lower(ident), last) & F.contains(ident, year.cast("string"))


def fold_print(c: Column) -> Column:
    """HTML-escaped text with typographic characters folded for print."""
    t = F.translate(c, "\u00b5\u03bc\u00d7\u2212\u2013\u2014\u2018\u2019\u201c\u201d", "uux---''\"\"")
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(raw), F.lit(escaped))
    return t
