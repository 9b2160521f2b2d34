"""Mixing sources to target shares of all tokens.

A document with a known source belongs to it; for one without, a classifier trained on the
labelled ones predicts a posterior over sources. Nonnegative rates per document, at most the
allowed repeats, are fitted so that the expected tokens of each source match its share of the
total: least squares by projected gradient steps, each one aggregation of per-source sums.
Documents of equal membership share a rate, so labelled ones are summed per source first.

Rates become whole numbers of copies by error diffusion within (source, bucket), long documents
first, so that the tokens meet the fitted ones closely; hot sources have many buckets.

Sources without usable documents cannot have a share: the others keep their proportions, and the
report shows 0; a source with classified documents only counts as empty, since a posterior alone is no
proof that it can carry a share. Sources without a target get no copies. Null and empty texts have no tokens and
get no copies. Without ``total`` the mixture is the largest at which no source exceeds its repeats.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.token_budget import PART, canonical_source, document_tokens
from evigraph.session import checkpoint, spread
from evigraph.sources import hash_sample

FEATURES, SAMPLE_DOCS, STEPS, TOLERANCE, BUCKET = 4096, 5_000, 40, 1e-6, 4_000


def _features(text: str) -> Counter:
    return Counter(xxhash.xxh32_intdigest(w) % FEATURES for w in text.lower().split())


class Classifier:
    """Multinomial naive Bayes over hashed words, tempered so that long texts do not saturate."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.labels = sorted({s for s, _ in rows})
        at = {s: i for i, s in enumerate(self.labels)}
        counts = np.full((len(self.labels), FEATURES), 0.5)
        prior = np.zeros(len(self.labels))
        for s, t in rows:
            prior[at[s]] += 1
            for f, n in _features(t).items():
                counts[at[s], f] += np.log1p(n)
        self.weights = np.log(counts / counts.sum(1, keepdims=True))
        self.prior = np.log((prior + 0.5) / (prior + 0.5).sum())

    def posterior(self, text: str) -> np.ndarray:
        f = _features(text)
        z = self.prior.copy()
        if f:
            idx = np.fromiter(f.keys(), int)
            n = np.log1p(np.fromiter(f.values(), float))
            z = z + (self.weights[:, idx] @ n) / np.sqrt(n.sum())
        p = np.exp(z - z.max())
        return p / p.sum()


def predicted(df: DataFrame, labelled: DataFrame, names: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, p array<double>) over ``names``: posterior of each row's source, the classifier fitted on a bounded sample."""
    rows = [(r[0], r[1]) for r in hash_sample(labelled, id_col, SAMPLE_DOCS).filter(F.length(text_col) > 0).select("source", text_col).collect()]
    shared = df.sparkSession.sparkContext.broadcast(Classifier(rows) if rows else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                p = dict(zip(model.labels, model.posterior(t or ""))) if model else {}
                out.append([float(p.get(n, 0.0)) for n in names])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=[id_col, "p"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, p array<double>")


def fit_rates(units: DataFrame, want: np.ndarray, expected: np.ndarray, steps: int = STEPS) -> list[list[float]]:
    """The gradient steps (per-source moves) after which expected totals meet ``want``; units: tokens, p, cap."""
    history = [[float(x) for x in np.divide(want, expected, out=np.zeros_like(want), where=expected > 0)]]
    for _ in range(steps):
        got = units.select(F.posexplode(F.transform("p", lambda x: x * F.col("tokens") * rate(history))).alias("s", "v")).groupBy("s").agg(F.sum("v").alias("v")).collect()
        have = np.zeros(len(want))
        for r in got:
            have[r["s"]] = r["v"]
        off = want - have
        if np.abs(off).max() <= TOLERANCE * max(1.0, want.sum()):
            break
        move = np.divide(off, expected, out=np.zeros_like(off), where=expected > 0)
        if np.abs(move).max() < 1e-9:
            break
        history.append([float(x) for x in move])
    return history


def rate(history: list[list[float]]) -> F.Column:
    """A unit's rate: each step moves it along its memberships, then projects onto [0, cap]."""
    steps = F.array(*[F.array(*[F.lit(x) for x in h]) for h in history])
    return F.aggregate(
        steps,
        F.lit(0.0),
        lambda r, g: F.greatest(F.lit(0.0), F.least(F.col("cap"), r + F.aggregate(F.zip_with("p", g, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y))),
    )


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies) of every document with at least one copy."""
    goals = targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats").dropDuplicates(["source"]).orderBy("source").collect()  # a short list by nature
    names = [g["source"] for g in goals]
    docs = documents.select("doc_id", "text", canonical_source(F.col("source")).alias("source"))
    # repeated rows are dropped after counting, when texts are gone; only long texts, which are counted in parts, before
    long = F.coalesce(F.length("text"), F.lit(0)) > PART
    once = spread(docs.filter(~long)).unionByName(docs.filter(long).dropDuplicates(["doc_id"]))
    counted = checkpoint(document_tokens(once, "doc_id", "text", ("source",), vocabulary=vocabulary).filter("n_tokens > 0").dropDuplicates(["doc_id"]))
    hot = F.array(*[F.when(F.col("source") == n, 1.0).otherwise(0.0) for n in names]) if names else F.array().cast("array<double>")
    known = counted.filter(F.col("source") != "unknown").withColumn("p", hot).filter(F.exists("p", lambda x: x > 0))
    lost = counted.filter(F.col("source") == "unknown").select("doc_id", "n_tokens")
    guess = predicted(docs.filter(F.col("source") == "unknown"), docs.filter(F.col("source") != "unknown"), names, "doc_id", "text").dropDuplicates(["doc_id"])
    soft = checkpoint(lost.join(guess, "doc_id").withColumn("source", F.lit("unknown")).select("doc_id", "source", "n_tokens", "p"))
    caps = F.array(*[F.lit(float(g["max_repeats"])) for g in goals]) if names else F.array().cast("array<double>")
    # a document of uncertain source may be repeated as often as its least generous likely source allows
    own_cap = F.array_min(F.zip_with("p", caps, lambda a, c: F.when(a > 0.05, c).otherwise(F.lit(float("inf")))))
    units = known.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("tokens")).unionByName(soft.select("p", F.col("n_tokens").cast("double").alias("tokens")))
    units = checkpoint(units.withColumn("cap", F.when(own_cap < float("inf"), own_cap).otherwise(0.0)))
    expected = np.zeros(len(names))
    for r in units.select(F.posexplode(F.transform("p", lambda x: x * F.col("tokens"))).alias("s", "v")).groupBy("s").agg(F.sum("v").alias("e")).collect():
        expected[r["s"]] = r["e"]
    sure = np.zeros(len(names))
    for r in known.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect():
        sure[names.index(r["source"])] = r["t"]
    share = np.array([g["target_share"] or 0.0 for g in goals]) * (sure > 0)
    if not share.sum():
        return counted.limit(0).select("doc_id", "source", "n_tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
    share /= share.sum()
    size = float(total) if total else float(min(sure[i] * goals[i]["max_repeats"] / share[i] for i in range(len(names)) if share[i] > 0))
    history = fit_rates(units, share * size, np.where(share > 0, expected, 0.0))
    rated = known.select("doc_id", "source", "n_tokens", "p").unionByName(soft).withColumn("cap", F.when(own_cap < float("inf"), own_cap).otherwise(0.0)).withColumn("rate", rate(history)).filter("rate > 0")
    # hot sources are rounded in many buckets, by hash
    sizes = {r["source"]: r["n"] for r in rated.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = F.lit(1)
    for s, n in sizes.items():
        if n > BUCKET:
            buckets = F.when(F.col("source") == s, F.lit(n // BUCKET + 1)).otherwise(buckets)
    r = rated.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), buckets))
    kind = documents.schema["doc_id"].dataType.simpleString()
    r = r.select("source", "bucket", "doc_id", "n_tokens", "rate", "cap").repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.col("n_tokens").desc(), F.xxhash64("doc_id"))
    return r.mapInArrow(_round, f"doc_id {kind}, source string, n_tokens long, rate double, copies int")


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole copies by error diffusion, long documents first: each group's tokens end near the fitted ones."""
    group, owed = None, 0.0
    for b in batches:
        source, bucket, _, tokens, rates, caps = (c.to_pylist() for c in b.columns)
        copies = []
        for s, k, n, r, c in zip(source, bucket, tokens, rates, caps):
            if (s, k) != group:
                group, owed = (s, k), 0.0
            base = min(int(r + 1e-9), int(c))
            owed += (r - base) * n
            more = int(owed >= n / 2 and base < int(c) and r - base > 1e-9)
            owed -= more * n
            copies.append(base + more)
        keep = [i for i, x in enumerate(copies) if x]
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(2).take(at), b.column(0).take(at), b.column(3).take(at), pa.array([round(rates[i], 6) for i in keep], pa.float64()), pa.array([copies[i] for i in keep], pa.int32())], names=["doc_id", "source", "n_tokens", "rate", "copies"])


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, n_docs, n_copies, n_tokens, most_copies) of every target and of what else got in."""
    t = targets.select(canonical_source(F.col("source")).alias("source"), "target_share").dropDuplicates(["source"])
    by = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    whole = by.agg(F.sum("n_tokens").alias("_all"))
    out = t.join(by, "source", "full_outer").join(F.broadcast(whole))  # one row
    return out.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.round(F.coalesce(F.try_divide(F.col("n_tokens"), F.col("_all")), F.lit(0.0)), 6).alias("reached_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_copies", "n_tokens", "most_copies")])

