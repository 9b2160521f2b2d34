"""Inverted packs: exact BM25 of many queries without a row per posting.

Documents are gathered in packs, each an inverted file of its own; queries travel in blocks, and every
block meets every pack, as in ``knn_corpus``. A query reads its terms' lists from the greatest possible
gain to the least. Once no document unseen so far can reach the k-th score, the remaining lists are only
looked up for documents that still can: the result is that of the full sum. A task holds one pack and
one block.

Both sides are written by ``checkpoint`` since a cross join reads them again and again.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.session import checkpoint

PACK, PACK_TERMS, BLOCK, SCOPE_END = 65_536, 8_000_000, 8_192, "\x1f"
#: Scores are compared after rounding to six places; a document within this of the k-th score stays.
SLACK = 2e-6


def _encoded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(lengths, codes, vocabulary) of lists of terms."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    return lengths, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist()


def _inverted(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary, starts, document, tf, lengths): the documents of each term, ascending."""
    lengths, codes, words = _encoded(lists)
    n = max(1, len(lengths))
    pairs, tf = np.unique(codes * n + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
    return words, np.searchsorted(pairs // n, np.arange(len(words) + 1)), pairs % n, tf, lengths


def _count_batch(words: list[str], df: np.ndarray, n: int, dl: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([*words, None], pa.string()), pa.array([*df.tolist(), n], pa.int64()), pa.array([0] * len(words) + [dl], pa.int64())], names=["term", "df", "dl"])


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl"))


def term_counts(terms: DataFrame) -> DataFrame:
    """(term, df, dl) of a column of term lists; the row without a term has the number of documents and their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, starts, _, _, lengths = _inverted(b.column(0))
            yield _count_batch(words, np.diff(starts), len(lengths), int(lengths.sum()))

    return _summed(terms.mapInArrow(run, "term string, df long, dl long"))


def weights(counts: DataFrame) -> DataFrame:
    """(term, idf, avgdl) from ``term_counts``."""
    stats = counts.filter("term is null").select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    return counts.filter("term is not null").join(F.broadcast(stats)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")  # stats is one row


class _Pack:
    """A pack as read: an inverted file with the share of each posting in its document's score."""

    def __init__(self, data: bytes, avgdl: float, k1: float, b: float):
        self.ids, own, self.words, _, self.starts, self.doc, tf, dl = pickle.loads(zlib.decompress(data))
        self.n = len(dl)
        self.part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[self.doc] / avgdl))
        some = np.flatnonzero(np.diff(self.starts))
        self.peak = np.zeros(len(self.words))
        if len(some):
            self.peak[some] = np.maximum.reduceat(self.part, self.starts[some])
        self.code = {self.words[i]: i for i in some.tolist()}
        self.score = np.zeros(self.n)
        self.own: dict = {}
        if own is not None:
            for i, x in enumerate(own):
                self.own.setdefault(x, []).append(i)

    def span(self, c: int) -> slice:
        return slice(self.starts[c], self.starts[c + 1])

    def add(self, docs: np.ndarray, values: np.ndarray, c: int, idf: float) -> np.ndarray:
        """Adds a term's part to the values of ascending ``docs``; which of them hold it."""
        s = self.span(c)
        here = self.doc[s]
        at = np.minimum(np.searchsorted(here, docs), len(here) - 1)
        hit = here[at] == docs
        values[hit] += idf * self.part[s][at[hit]]
        return hit

    def top(self, terms: list[str], idf: list[float], k: int, own: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the k best rounded scores, ties to the smaller id, and their scores."""
        have = sorted(((w * self.peak[c], c, w) for t, w in zip(terms, idf) if (c := self.code.get(t)) is not None), reverse=True)
        rest = np.r_[np.cumsum([h[0] for h in have][::-1])[::-1], 0.0]
        score = self.score
        score.fill(0)
        stop, docs, least = len(have), None, 0.0
        for j, (_, c, w) in enumerate(have):
            s = self.span(c)
            if j and s.stop - s.start > 256:
                score[own] = 0
                docs = np.flatnonzero(score)
                if len(docs) >= k and (least := np.partition(score[docs], len(docs) - k)[len(docs) - k]) - SLACK > rest[j]:
                    stop = j
                    break
            score[self.doc[s]] += w * self.part[s]
        if stop == len(have):
            score[own] = 0
            docs = np.flatnonzero(score)
        values = score[docs]
        for j in range(stop, len(have)):
            can = values + rest[j] >= least - SLACK
            docs, values = docs[can], values[can]
            self.add(docs, values, have[j][1], have[j][2])
            least = max(least, np.partition(values, len(values) - k)[len(values) - k])
        return _first(docs, values, k)

    def sharing(self, terms: list[str], idf: list[float], k: int, need: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``top``, of documents with ``need`` of the terms or more.

        Such a document holds one of any ``len - need + 1`` terms; the rarest are those that are read.
        """
        have = sorted((self.starts[c + 1] - self.starts[c], c, w) for t, w in zip(terms, idf) if (c := self.code.get(t)) is not None)
        read = have[: len(have) - max(1, need) + 1] if len(have) >= need else []
        if not read:
            return np.zeros(0, np.int64), np.zeros(0)
        docs = np.unique(np.concatenate([self.doc[self.span(c)] for _, c, _ in read]))
        values, matched = np.zeros(len(docs)), np.zeros(len(docs), np.int64)
        for j, (_, c, w) in enumerate(have):
            if j:
                can = matched + len(have) - j >= need
                docs, values, matched = docs[can], values[can], matched[can]
            matched += self.add(docs, values, c, w)
        can = matched >= need
        return _first(docs[can], values[can], k)


def _first(docs: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    rounded = np.round(values, 6)
    if len(docs) > k:
        can = rounded >= np.partition(rounded, len(docs) - k)[len(docs) - k]
        docs, values, rounded = docs[can], values[can], rounded[can]
    order = np.lexsort((docs, -rounded))[:k]
    return docs[order], values[order]


def inverted_packs(docs: DataFrame, id_cols: list[str], terms: Column, scope: list[str] = (), own: str | None = None, keep: Column | None = None) -> DataFrame:
    """(pack): inverted files of documents. Those that ``keep`` leaves out are counted but never found."""
    t = F.transform(terms, lambda x: F.concat(*[F.col(c).cast("string") for c in scope], F.lit(SCOPE_END), x)) if scope else terms
    rows = docs.select(*id_cols, t.alias("_t"), (F.col(own).cast("string") if own else F.lit(None).cast("string")).alias("_own"), (F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)).alias("_keep"))
    has_own = own is not None

    def pack(held: list[pa.RecordBatch]) -> bytes:
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in id_cols])).combine_chunks()
        words, starts, doc, tf, dl = _inverted(table["_t"].combine_chunks())
        df, kept = np.diff(starts), table["_keep"].to_numpy()
        if not kept.all():
            here = kept[doc]
            starts, doc, tf = np.r_[0, np.cumsum(here)][starts], doc[here], tf[here]
        ids = [table[c].combine_chunks() for c in id_cols]
        return zlib.compress(pickle.dumps((ids, table["_own"].to_pylist() if has_own else None, words, df, starts, doc.astype(np.int32), tf.astype(np.int32), dl.astype(np.int32))), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            n += len(b.column("_t").flatten())
            if size >= PACK or n >= PACK_TERMS:
                yield pa.RecordBatch.from_arrays([pa.array([pack(held)], pa.binary())], names=["pack"])
                held, size, n = [], 0, 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([pack(held)], pa.binary())], names=["pack"])

    return checkpoint(rows.mapInArrow(run, "pack binary"))


def pack_counts(packs: DataFrame) -> DataFrame:
    """``term_counts`` of packed documents; terms count over all scopes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                _, _, words, df, _, _, _, dl = pickle.loads(zlib.decompress(data.as_py()))
                yield _count_batch([w.rpartition(SCOPE_END)[2] for w in words], df, len(dl), int(dl.sum()))

    return _summed(packs.mapInArrow(run, "term string, df long, dl long"))


def search(packs: DataFrame, docs: DataFrame, id_cols: list[str], queries: DataFrame, query_id: str, terms: Column, top_k: int, k1: float, b: float, scope: list[str] = (), own: str | None = None, share: float | None = None) -> DataFrame:
    """(query, ids..., score), unrounded: of each pack its ``top_k`` documents of each query.

    ``own``: documents whose own value is the query's are not its results. ``share``: only documents that
    hold so much of the query's words (rounded down).
    """
    q = queries.select(query_id, F.concat(F.lit(""), *[F.col(c).cast("string") for c in scope]).alias("_scope"), (F.col(own).cast("string") if own else F.lit(None).cast("string")).alias("_own"), F.array_distinct(terms).alias("_d"))
    q = q.select(query_id, "_scope", "_own", F.floor(F.size("_d") * (share or 0.0)).cast("int").alias("need"), F.explode("_d").alias("term"))
    q = q.join(weights(pack_counts(packs)), "term").groupBy(query_id, "_scope", "_own", "need").agg(F.min("avgdl").alias("avgdl"), F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("_q"))
    rows = q.select(query_id, "_scope", "_own", "need", "avgdl", F.col("_q.term").alias("terms"), F.col("_q.idf").alias("idf"))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(0, x.num_rows, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps([c.to_pylist() for c in x.slice(i, BLOCK).columns]), 1)], pa.binary())], names=["block"])

    blocks = checkpoint(rows.mapInArrow(block, "block binary"))
    scoped = bool(scope)

    def found(p: _Pack, data: bytes) -> list:
        queries_, docs_, scores = [], [], []
        memo: dict = {}
        for qid, sc, mine, need, _, ts, ws in zip(*pickle.loads(zlib.decompress(data))):
            hidden = p.own.get(mine, []) if mine is not None else []
            key = (sc, tuple(ts), need, mine if hidden else None)
            if key not in memo:
                ts = [f"{sc}{SCOPE_END}{t}" for t in ts] if scoped else ts
                memo[key] = p.sharing(ts, ws, top_k, need) if share is not None else p.top(ts, ws, top_k, hidden)
            d, s = memo[key]
            queries_ += [qid] * len(d)
            docs_.append(d)
            scores.append(s)
        d = np.concatenate([np.zeros(0, np.int64), *docs_])
        at = pa.array(d, pa.int64())
        return [queries_, *[c.take(at) for c in p.ids], np.concatenate([np.zeros(0), *scores])]

    kinds = {query_id: queries.schema[query_id].dataType.simpleString()} | {c: docs.schema[c].dataType.simpleString() for c in id_cols}
    names = [query_id, *id_cols, "score"]
    kind = _arrow_type(kinds[query_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, p = None, None
        for x in batches:
            for i in range(x.num_rows):
                data, blk = x.column(0)[i].as_py(), x.column(1)[i].as_py()
                if data != last:
                    avgdl = pickle.loads(zlib.decompress(blk))[4][0]
                    last, p = data, _Pack(data, avgdl, k1, b)
                qs, *rest = found(p, blk)
                for a in range(0, len(qs), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(qs[a : a + 100_000], kind), *[pa.array(r[a : a + 100_000]) if isinstance(r, np.ndarray) else r.slice(a, 100_000) for r in rest]], names=names)

    met = packs.join(blocks.hint("shuffle_replicate_nl"))  # blocks of queries against packs of documents
    return met.select("pack", "block").mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", score double")


def _arrow_type(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]
