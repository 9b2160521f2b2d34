"""Batched retrieval: BM25 postings, exact cosine, rank fusion.

Many queries run in one plan. Statistics (document frequency, lengths) always cover the whole index,
before any filter on a paper or type. Ties go to the smaller id.

Scale: corpus-wide BM25 runs over inverted packs (``operators.postings``), paper-scoped BM25 makes
postings of the asked papers only. Paper-scoped vector search joins on the paper, so its work is bounded by the scope; corpus-wide
search runs stated queries against all rows in blocks (one matrix product per batch).

The default analyzer keeps lower-case words as they are; ``functions.stem.english_terms`` stems them.

Nulls: a null text has no terms; rows without a vector, or with one of another size or all zero,
are not searched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators import postings as inverted

K1, B, RRF_K = 1.2, 0.75, 60


def terms(text: Column) -> Column:
    """Lower-case ASCII alphanumeric words in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def postings(docs: DataFrame, id_cols: list[str], text_col: str, analyze: Callable[[Column], Column] = terms) -> DataFrame:
    """(ids..., term, tf, dl) of every document; ``analyze`` makes terms of a text."""
    t = docs.select(*id_cols, analyze(F.col(text_col)).alias("_t"))
    return t.select(*id_cols, F.size("_t").alias("dl"), F.explode("_t").alias("term")).groupBy(*id_cols, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, id_cols: list[str], text_col: str, queries: DataFrame, query_id: str, query_col: str, top_k: int, scope: list[str] | None = None, counts: DataFrame | None = None, analyze: Callable[[Column], Column] = terms, own: str | None = None, keep: Column | None = None) -> DataFrame:
    """(query, ids..., score, rank0): best documents of each query; ``scope`` columns must be equal on both sides.

    A scope that is one of the ids (a paper) is joined, and only its documents get postings; the
    other searches go over inverted packs. ``counts``: ``term_counts`` of all documents, if at hand.
    Packs only: ``own`` (a column of both sides) keeps documents of the query's own value out, and
    documents without ``keep`` count for the statistics only.
    """
    scope = scope or []
    keys = [c for c in id_cols if c not in scope]
    if scope and set(scope) <= set(id_cols) and own is None and keep is None:
        counts = inverted.term_counts(docs.select(analyze(F.col(text_col)).alias("_t"))) if counts is None else counts
        q = queries.select(query_id, *scope, F.explode(F.array_distinct(analyze(F.col(query_col)))).alias("term"))
        post = postings(docs.join(queries.select(*scope).distinct(), scope, "left_semi"), id_cols, text_col, analyze)
        hit = q.join(inverted.weights(counts), "term").join(post, ["term", *scope])
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        scored = hit.groupBy(query_id, *scope, *keys).agg(F.sum(part).alias("score"))
        return ranked(scored.withColumn("score", F.round("score", 6)), [query_id, *scope], keys, top_k)
    packs = inverted.inverted_packs(docs, id_cols, analyze(F.col(text_col)), scope, own, keep)
    found = inverted.search(packs, docs, id_cols, queries, query_id, analyze(F.col(query_col)), top_k, K1, B, scope, own)
    return ranked(found.withColumn("score", F.round("score", 6)), [query_id], id_cols, top_k)


def ranked(scored: DataFrame, by: list[str], ids: list[str], top_k: int | None) -> DataFrame:
    """Adds rank0 by falling score, ties by ids, and keeps the first ``top_k``."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), *ids)
    out = scored.withColumn("rank0", F.row_number().over(w) - 1)
    return out.filter(F.col("rank0") < top_k) if top_k else out


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def knn_scoped(vectors: DataFrame, id_col: str, vector_col: str, queries: DataFrame, query_id: str, query_vector: str, scope: list[str], top_k: int) -> DataFrame:
    """Best vectors of each query among those of equal scope columns (an equi-join)."""
    q = queries.select(query_id, *scope, F.col(query_vector).alias("_q"))
    j = vectors.select(id_col, *scope, F.col(vector_col).alias("_v")).join(q, scope).filter(F.size("_v") == F.size("_q"))
    s = j.select(query_id, *scope, id_col, F.round(cosine(F.col("_v"), F.col("_q")), 6).alias("score")).filter("score is not null")
    return ranked(s, [query_id], [id_col], top_k)


def knn_corpus(vectors: DataFrame, id_col: str, vector_col: str, queries: DataFrame, query_id: str, query_vector: str, top_k: int, dim: int, labels: tuple[str, str] | None = None, query_block: int = 4_096) -> DataFrame:
    """Best vectors of each stated query in the whole table, exact.

    Queries travel in blocks of ``query_block`` rows packed into one row each; every batch of
    vectors meets every block, keeps its own best ``top_k`` per query, and a final rank merges
    them. ``labels`` = (column of vectors, column of queries): only rows of the query's label count.
    """
    lab = [F.col(labels[0]).cast("string").alias("_l")] if labels else [F.lit("").alias("_l")]
    qlab = [F.col(labels[1]).cast("string").alias("_l")] if labels else [F.lit("").alias("_l")]
    good = lambda c: (F.size(c) == dim) & F.exists(c, lambda x: x != 0)
    q = queries.filter(good(query_vector)).select(F.col(query_id).cast("long").alias("q"), *qlab, F.col(query_vector).alias("v"))
    blocks = q.withColumn("blk", F.floor(F.monotonically_increasing_id() / query_block)).groupBy("blk").agg(F.collect_list(F.struct("q", "_l", "v")).alias("block"))
    rows = vectors.filter(good(vector_col)).select(F.col(id_col).cast("long").alias("id"), *lab, F.col(vector_col).alias("v"))
    # packs of at most query_block rows: a partition's rows are numbered on from partition number * 2^33
    packed = rows.withColumn("pk", F.floor(F.monotonically_increasing_id() / query_block)).groupBy("pk").agg(F.collect_list(F.struct("id", "_l", "v")).alias("pack"))
    met = packed.join(blocks)  # blocks of stated queries against packs of rows, not rows against rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                pack, block = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                x = np.array([r["v"] for r in pack], np.float64)
                y = np.array([r["v"] for r in block], np.float64)
                s = np.round((y / np.linalg.norm(y, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T, 6)
                ids = np.array([r["id"] for r in pack])
                if labels:
                    s = np.where(np.array([r["_l"] for r in block])[:, None] == np.array([r["_l"] for r in pack])[None, :], s, -9.0)
                s = np.where(np.array([r["q"] for r in block])[:, None] == ids[None, :], -9.0, s)
                qs, xs, cs = [], [], []
                for row, r in enumerate(block):
                    best = np.lexsort((ids, -s[row]))[:top_k]
                    best = best[s[row][best] > -9]
                    qs += [r["q"]] * len(best)
                    xs += ids[best].tolist()
                    cs += s[row][best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(xs, pa.int64()), pa.array(cs, pa.float64())], names=["q", "id", "score"])

    found = met.select("pack", "block").mapInArrow(run, "q long, id long, score double")
    return ranked(found, ["q"], ["id"], top_k).select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank0")


def fuse(rankings: list[DataFrame], by: list[str], ids: list[str], top_k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum of 1/(61 + rank0); ties keep the first-seen order (arm, then rank)."""
    arms = None
    for n, r in enumerate(rankings):
        a = r.select(*by, *ids, F.lit(n).alias("arm"), "rank0")
        arms = a if arms is None else arms.unionByName(a)
    g = arms.groupBy(*by, *ids).agg(F.sum(1.0 / (RRF_K + 1 + F.col("rank0"))).alias("score"), F.min(F.struct("arm", "rank0")).alias("seen"))
    w = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), "seen.arm", "seen.rank0", *ids)
    out = g.withColumn("rank0", F.row_number().over(w) - 1)
    return (out.filter(F.col("rank0") < top_k) if top_k else out).drop("seen")


def hash_vectors(df: DataFrame, id_col: str, text_col: str, dim: int = 384) -> DataFrame:
    """(id, vector): deterministic pseudo-embedding from SHA-256 bytes tiled to ``dim``, unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                raw = np.frombuffer(hashlib.sha256((t or "").encode()).digest(), np.uint8).astype(np.float64)
                v = (np.resize(raw, dim) - 128) / 128
                out.append((v / (np.linalg.norm(v) or 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=[id_col, "vector"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, vector array<float>")


def paper_packs(papers: DataFrame) -> list[DataFrame]:
    """Inverted packs of titles and of abstracts, for ``best_paper``."""
    return [inverted.inverted_packs(papers, ["paper_id"], terms(F.col(field))) for field in ("title", "abstract")]


def best_paper(papers: DataFrame, queries: DataFrame, query_id: str, query_col: str, share: float = 0.6, packs: list[DataFrame] | None = None) -> DataFrame:
    """(query, paper_id, score): best paper of a citation text over title (weight 4) and abstract.

    At least ``share`` of the query's words (rounded down) must occur in one of the two fields.
    ``packs``: ``paper_packs`` of the papers, if at hand.
    """
    arms = []
    for packed, weight in zip(packs or paper_packs(papers), (4.0, 1.0)):
        found = inverted.search(packed, papers, ["paper_id"], queries, query_id, terms(F.col(query_col)), 1, K1, B, share=share)
        arms.append(found.withColumn("score", F.round(F.col("score") * weight, 6)))  # the best of a field is enough: fields are not added up
    return ranked(arms[0].unionByName(arms[1]), [query_id], ["paper_id"], 1).drop("rank0")
