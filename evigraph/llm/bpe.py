"""Corpus encoding with a public byte-level BPE vocabulary (no training).

The merges are compiled, on demand, into a deterministic transducer over bytes. Facts used:
a token sequence is the BPE encoding of its bytes exactly if each token encodes to itself and
each neighbouring pair encodes to itself; so every prefix of the input has one encoding, and
the encoding of a longer prefix is that of some earlier prefix plus one token.

A state holds the *open* prefixes: for each, the vocabulary-trie node that the bytes since it
spell, and the tokens of its encoding that are not common to all open prefixes. Reading a
byte moves the nodes, adds the one new prefix, drops dead ones and emits the tokens that all
open prefixes now share. The lookahead is bounded by the longest token. States and moves are
interned when first met (lazy determinisation) and forgotten when there are too many, which
changes no result.

Whether two tokens may stand side by side is read off their edges: the parts that end the left
one and begin the right one while their bytes are merged, each with the rank of the merge that
absorbs it. Merge ranks never fall while a text is merged, so the pair stays apart unless two
parts that stand at the boundary together form a token of lower rank.

Text is first split by the vocabulary's published pattern; the transducer runs on each piece,
and results per piece are kept in a bounded table. A space after a non-space always starts a
piece, so texts are cut there first and the results of short stretches are kept, too. Decoding
is a stream over token bytes through an incremental UTF-8 state machine.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.session import spread

#: Fixed value: the split pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same language with the frequent alternatives first: no letter or digit can start a contraction, so the order is free.
_FAST = r" ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
_WIDE = re.compile(r"\s ")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
#: Bounds on the tables of one worker; beyond them they are emptied and filled anew.
MAX_STATES, MAX_PIECES = 200_000, 400_000


def default_vocabulary() -> str:
    """Path of the 50k byte-level vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Transducer:
    """Lazily determinised BPE transducer of one vocabulary."""

    def __init__(self, path: str | None = None):
        with open(path or default_vocabulary(), "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes = {i: t for t, i in self.ids.items()}
        # trie: (node, byte) -> child in one table of numbers, which the collector need not walk; the token
        # that ends at a node; whether a node has children
        self.kids: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.inner = bytearray(1)
        for token, i in self.ids.items():
            n = 0
            for b in token:
                m = self.kids.get(n << 8 | b)
                if m is None:
                    m = self.kids[n << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(0)
                    self.inner[n] = 1
                n = m
            self.ends[n] = i
        self.longest = max(map(len, self.ids))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.split = regex.compile(_FAST).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.stretches: dict[str, tuple[int, ...]] = {}
        self.edges: dict[int, tuple[list, list]] = {}
        self._clear()

    def _clear(self) -> None:
        # a state: (last token before all open prefixes, ((node, tokens since), ...)), oldest first
        start = (-1, ((0, ()),))
        self.number, self.states, self.moves = {start: 0}, [start], {}

    def merged(self, text: bytes) -> list[int]:
        """BPE by definition: join the pair of lowest rank until none is left. For short input."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def _edges(self, token: int) -> tuple[list, list]:
        """(parts at the left edge, parts at the right edge) of a token while it is merged, each with the rank that absorbs it."""
        got = self.edges.get(token)
        if got is None:
            text, ids = self.bytes[token], self.ids
            parts = [text[i : i + 1] for i in range(len(text))]
            left, right = [], []
            while len(parts) > 1:
                rank, at = min((ids.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if not at:
                    left.append((parts[0], rank))
                if at == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            left.append((text, 1 << 61))
            right.append((text, 1 << 61))
            got = self.edges[token] = (left, right)
        return got

    def _fits(self, a: int, b: int) -> bool:
        """Whether b may follow a (a = -1: whether b may stand first)."""
        ok = self.alone.get(b)
        if ok is None:
            ok = self.alone[b] = self.merged(self.bytes[b]) == [b]
        if a < 0 or not ok:
            return ok
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MAX_PIECES:
                self.pairs.clear()
            known, ids = True, self.ids
            x, y, i, j = self._edges(a)[1], self._edges(b)[0], 0, 0
            while known and (i < len(x) and j < len(y)):
                (p, until), (q, till) = x[i], y[j]
                rank = ids.get(p + q)
                if rank is not None and rank < until and rank <= till:  # of equal ranks the leftmost is merged first
                    known = False
                elif until <= till:
                    i += 1
                else:
                    j += 1
            self.pairs[a, b] = known
        return known

    def _move(self, s: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, open_ = self.states[s]
        kids, ends, inner, pairs = self.kids.get, self.ends, self.inner, self.pairs
        out, new = [], None
        for node, since in open_:
            n = kids(node << 8 | byte)
            if n is None:
                continue
            if new is None and (t := ends[n]) >= 0:
                before = since[-1] if since else last
                fits = pairs.get((before, t))
                if fits or fits is None and self._fits(before, t):
                    new = (*since, t)
            if inner[n]:
                out.append((n, since))
        out.append((0, new))  # single bytes are tokens, so the new prefix always has an encoding
        first, k = out[0][1], 0
        if first:
            shortest = min([len(x) for _, x in out])
            while k < shortest and all([x[k] == first[k] for _, x in out]):
                k += 1
        state = (first[k - 1], tuple([(n, x[k:]) for n, x in out])) if k else (last, tuple(out))
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
        move = self.moves[s << 8 | byte] = (to, first[:k])
        return move

    def run(self, text: bytes) -> tuple[int, ...]:
        """Encode the bytes of one piece."""
        out: list[int] = []
        if len(self.states) > MAX_STATES:
            self._clear()
        s, moves = 0, self.moves
        for b in text:
            m = moves.get(s << 8 | b)
            if m is None:
                if len(self.states) > 4 * MAX_STATES:  # one huge piece: keep only where we are
                    here = self.states[s]
                    self._clear()
                    moves, s = self.moves, self.number.setdefault(here, len(self.states))
                    if s == len(self.states):
                        self.states.append(here)
                m = self._move(s, b)
            s = m[0]
            if m[1]:
                out.extend(m[1])
        return (*out, *self.states[s][1][-1][1])

    def _piece(self, p: str) -> tuple[int, ...]:
        if len(self.pieces) > MAX_PIECES:
            self.pieces.clear()
        data = p.encode("utf-8", "surrogatepass")
        whole = self.ids.get(data)
        got = (whole,) if whole is not None and self._fits(-1, whole) else self.run(data)
        if len(p) <= 64:
            self.pieces[p] = got
        return got

    def _stretch(self, text: str) -> tuple[int, ...]:
        """Ids of a text that starts and ends at piece boundaries."""
        if len(self.stretches) > MAX_PIECES:
            self.stretches.clear()
        get, out = self.pieces.get, []
        for p in self.split(text):
            out.extend(get(p) or self._piece(p))
        got = tuple(out)
        if len(text) <= 64:
            self.stretches[text] = got
        return got

    def _cut(self, text: str) -> list[str]:
        """The text cut before each space that follows a non-space."""
        if _WIDE.search(text) is None:
            first, *rest = text.split(" ")
            return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
        return _BEFORE_SPACE.split(text)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty or null text gives an empty list."""
        out: list[int] = []
        if text:
            get, extend, stretch = self.stretches.get, out.extend, self._stretch
            for p in self._cut(text):
                extend(get(p) or stretch(p))
        return out

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        if not text:
            return 0
        get, stretch = self.stretches.get, self._stretch
        return sum([len(get(p) or stretch(p)) for p in self._cut(text)])

    def decode(self, ids: Iterable[int]) -> str:
        """Text of a stream of ids; malformed bytes give U+FFFD. Unknown ids are an error."""
        return "".join(Utf8().feed(b"".join(self.bytes[i] for i in ids), last=True))


class Utf8:
    """Incremental UTF-8 decoder: bytes still needed, code point so far, lowest valid value."""

    def __init__(self) -> None:
        self.need, self.code, self.low = 0, 0, 0

    def feed(self, data: bytes, last: bool = False) -> list[str]:
        out: list[str] = []
        for b in data:
            if self.need:
                if b & 0xC0 == 0x80:
                    self.code, self.need = self.code << 6 | b & 0x3F, self.need - 1
                    if not self.need:
                        c = self.code
                        out.append(chr(c) if self.low <= c <= 0x10FFFF and not 0xD800 <= c < 0xE000 else "�")
                    continue
                out.append("�")
                self.need = 0
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b < 0xF5:
                self.need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                self.code, self.low = b & (0x3F >> self.need), (0x80, 0x800, 0x10000)[self.need - 1]
            else:
                out.append("�")
        if last and self.need:
            out.append("�")
            self.need = 0
        return out


_LOADED: dict[str, Transducer] = {}


def transducer(path: str | None = None) -> Transducer:
    """One transducer per vocabulary and Python worker."""
    path = path or default_vocabulary()
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row, without special tokens; no shuffle.

    Null and empty texts give an empty list; repeated rows stay repeated; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for batch in batches:
            lists = [t.encode(x) for x in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, lists), np.int32, len(lists))
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, text) of rows of ids; a null list gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for batch in batches:
            texts = [None if x is None else t.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")
