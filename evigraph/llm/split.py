"""Splitting long texts at natural boundaries with a fixed overlap.

Each cut position has a strength (paragraph 5, line 4, sentence end 3, clause 2, white space or
full-width mark 1, none 0). A sparse table over the strengths answers range-maximum queries in
constant time, ties going right. From a piece's start the strongest cut within the permissible
window of lengths is taken; the next piece starts ``overlap`` code points before it.

``cut_kind`` asks the same kind of table for the strongest mark in every window: a text with a stretch of more than ``limit`` code points holding neither white
space nor a sentence mark cannot be cut naturally everywhere ('forced'); any other is 'natural'.
Nulls and texts within the limit give no pieces in ``split_long``; lengths are code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4_000, 200
#: Fixed value: the marks at which a text may end besides white space.
MARKS = ".!?。！？｡．।"
_SENTENCE_END = regex.compile(r"[.!?。！？｡．।…][\"'”’»)\]」』）]*(?=\s|\p{Lo}|$)")
_CLAUSE = regex.compile(r"[;:,；：，、–—](?=\s|\p{Lo})")
_SPACE = regex.compile(r"\s+")
_BREAK = regex.compile(rf"[\s{regex.escape(MARKS)}]+")


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each position 0..len(text)."""
    s = np.zeros(len(text) + 1, np.int8)
    for i, ch in enumerate(text):
        if ch in MARKS:
            s[i + 1] = 1
    for m in _CLAUSE.finditer(text):
        s[m.end()] = 2
    for m in _SENTENCE_END.finditer(text):
        s[m.end()] = max(s[m.end()], 3 if m.end() == len(text) or not text[m.end() : m.end() + 1].isalnum() or ord(text[m.end() - 1]) > 0x2FF else 1)
    for m in _SPACE.finditer(text):
        n = m.group().count("\n")
        v = 5 if n > 1 else 4 if n else int(s[m.start()] or 1)
        s[m.start()] = max(s[m.start()], v)
        s[m.end()] = max(s[m.end()], v)
    s[len(text)] = 6
    return s


class RangeMax:
    """Sparse table: position of the maximum in [lo, hi], the rightmost among equals."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.key = values.astype(np.int64) * (n + 1) + np.arange(n)  # larger position wins ties
        self.rows = [self.key]
        w = 1
        while 2 * w <= n:
            prev = self.rows[-1]
            self.rows.append(np.maximum(prev[: n - 2 * w + 1], prev[w : n - w + 1]))
            w *= 2
        self.n = n

    def at(self, lo: int, hi: int) -> int:
        k = (hi - lo + 1).bit_length() - 1
        best = max(int(self.rows[k][lo]), int(self.rows[k][hi - (1 << k) + 1]))
        return best % (self.n + 1)


def window_max(values: np.ndarray, width: int) -> np.ndarray:
    """Maximum of every window of ``width`` values: the one level of the sparse table that serves this width."""
    w, level = 1, values
    while 2 * w <= width:
        level = np.maximum(level[: len(level) - w], level[w:])
        w *= 2
    k = len(values) - width + 1
    return np.maximum(level[:k], level[width - w : width - w + k])


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: float = 0.5) -> list[tuple[int, int, int]]:
    """(start, end, strength of the end) of each piece; at most ``limit`` long, ``overlap`` shared.

    A cut is sought from ``least`` x limit on; a window without any cut takes the earlier part
    down to overlap + 1, and only then an arbitrary place.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    n = len(text)
    if n <= limit:
        return [(0, n, 6)] if n else []
    s = strengths(text)
    table = RangeMax(s)
    out, start = [], 0
    while True:
        if n - start <= limit:
            out.append((start, n, 6))
            return out
        hi = start + limit
        lo = min(hi, start + max(overlap + 1, int(limit * least)))
        end = table.at(lo, hi)
        if s[end] == 0 and lo > start + overlap + 1:
            early = table.at(start + overlap + 1, lo)
            end = early if s[early] else hi
        elif s[end] == 0:
            end = hi
        out.append((start, end, int(s[end])))
        start = end - overlap


def cut_kind(text: str, limit: int = LIMIT) -> str:
    """'forced' if some window of limit + 1 code points holds neither white space nor a sentence mark."""
    if len(text) <= limit:
        return "natural"
    breaks = np.zeros(len(text), np.int8)
    for m in _BREAK.finditer(text):
        breaks[m.start() : m.end()] = 1
    return "natural" if window_max(breaks, limit + 1).all() else "forced"


def split_long(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece_no, start_pos, end_pos, strength, piece, cut_kind) of every text longer than ``limit``."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column(0), b.column(1).to_pylist()):
                cuts = pieces(text, limit, overlap)
                k = len(cuts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.as_py()] * k, b.schema[0].type), pa.array(range(k), pa.int32()), pa.array([c[0] for c in cuts], pa.int32()), pa.array([c[1] for c in cuts], pa.int32()), pa.array([c[2] for c in cuts], pa.int32()), pa.array([text[c[0] : c[1]] for c in cuts], pa.string()), pa.array([cut_kind(text, limit)] * k, pa.string())],
                    names=[id_col, "piece_no", "start_pos", "end_pos", "strength", "piece", "cut_kind"],
                )

    long = df.select(id_col, F.col(text_col).alias("_t")).filter(F.length("_t") > limit)
    return long.mapInArrow(run, f"`{id_col}` {kind}, piece_no int, start_pos int, end_pos int, strength int, piece string, cut_kind string")
