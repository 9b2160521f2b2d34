"""Resolving under-described claims through cited papers, many at once.

The walk commits to the first reference that describes the method or refers on; references
before it leave their steps in the chain, later ones are not tried. Depth is bounded, so cycles end.
Each round is one batch of joins over the frontier; lineage is cut by checkpoint, and the only
thing the driver learns is whether the frontier is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import ids, text
from evigraph.operators import citations, context, postings, retrieve
from evigraph.session import checkpoint, shuffled_joins

MAX_DEPTH, LOCATE_K, RADIUS = 5, 8, 2
STEP = "array<struct<depth:int,source_paper_id:string,sentence_ids:array<int>,extracted_text:string>>"


def locate(asks: DataFrame, key: list[str], sentences: DataFrame, counts: DataFrame | None = None, strip_stamps: bool = False, vectors: DataFrame | None = None, ask_vectors: DataFrame | None = None) -> DataFrame:
    """(key, paper_id, sentence_ids, passage, full, shortcut, refs) of each (key, paper_id, ask) by the best passage.

    Sentence ranking is BM25, fused with cosine where both vector tables are given.
    """
    q = asks.withColumn("_k", F.to_json(F.struct(*key)))
    arms = [retrieve.bm25(sentences, ["paper_id", "sentence_id"], "text", q, "_k", "ask", LOCATE_K, ["paper_id"], counts)]
    if vectors is not None and ask_vectors is not None:
        v = q.join(ask_vectors, key).select("_k", "paper_id", "vector")
        arms.append(retrieve.knn_scoped(vectors, "sentence_id", "vector", v, "_k", "vector", ["paper_id"], LOCATE_K))
    hits = retrieve.fuse(arms, ["_k", "paper_id"], ["sentence_id"], LOCATE_K)
    a = hits.groupBy("_k", "paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank0", "sentence_id"))), lambda x: x["sentence_id"]).alias("anchors"))
    p = context.passages(a, ["_k"], sentences, RADIUS)
    out = q.select("_k", "paper_id", *key).join(p, ["_k", "paper_id"], "left").drop("_k")
    d = context.decide(F.coalesce("passage", F.lit("")), strip_stamps)
    return out.select(*key, "paper_id", F.coalesce("sentence_ids", F.array().cast("array<int>")).alias("sentence_ids"), F.coalesce("passage", F.lit("")).alias("passage"), d["full"].alias("full"), d["shortcut"].alias("shortcut"), d["refs"].alias("refs"))


def walk(claims: DataFrame, refs: DataFrame, papers: DataFrame, sentences: DataFrame, by_citation: bool = True, max_depth: int = MAX_DEPTH, strip_stamps: bool = False) -> DataFrame:
    """(claim_id, status, reason, resolved_text, confidence, chain) of claims (claim_id, paper_id, raw_text, cited_ref_ids)."""
    with shuffled_joins(claims.sparkSession):
        return _walked(claims, refs, papers, sentences, by_citation, max_depth, strip_stamps)


def _walked(claims: DataFrame, refs: DataFrame, papers: DataFrame, sentences: DataFrame, by_citation: bool, max_depth: int, strip_stamps: bool) -> DataFrame:
    table = checkpoint(citations.reference_table(refs))
    papers = checkpoint(citations.paper_table(papers))  # read by every round; texts stay behind
    packs = retrieve.paper_packs(papers.filter("has_methods")) if by_citation else None
    sentences = checkpoint(sentences)
    counts = checkpoint(postings.term_counts(sentences.select(retrieve.terms(F.col("text")).alias("_t"))))
    front = claims.select("claim_id", F.col("paper_id").alias("at"), "raw_text", F.coalesce("cited_ref_ids", F.array().cast("array<string>")).alias("refs"), F.array().cast(STEP).alias("chain"))
    front = checkpoint(front)
    done = None
    targets = None

    def add(rows: DataFrame) -> None:
        nonlocal done
        rows = rows.select("claim_id", "status", "reason", "resolved_text", "confidence", "chain")
        done = rows if done is None else done.unionByName(rows)

    def gap(rows: DataFrame, reason: Column) -> DataFrame:
        return rows.select("claim_id", F.lit("terminal_gap").alias("status"), reason.alias("reason"), F.lit(None).cast("string").alias("resolved_text"), F.lit(0.0).alias("confidence"), "chain")

    for depth in range(max_depth + 1):
        if depth == max_depth:
            add(gap(front, F.lit("depth_exceeded")))
            break
        add(gap(front.filter(F.size("refs") == 0), F.lit("no_reference")))
        go = front.filter(F.size("refs") > 0)
        tried = go.select("claim_id", "at", "raw_text", F.posexplode("refs").alias("pos", "_id")).withColumn("ref_key", ids.ref_key(F.col("_id")))
        tried = tried.join(table.select(F.col("paper_id").alias("at"), "ref_key", "ref_row_id"), ["at", "ref_key"])
        needed = table.join(tried.select("ref_row_id").distinct(), "ref_row_id", "left_semi")
        targets = citations.fetch_targets(needed, papers, by_citation, packs)
        tried = checkpoint(tried.join(targets, "ref_row_id").select("claim_id", "pos", "raw_text", "target", "reason"))
        asks = tried.filter("target is not null").select("claim_id", "pos", F.col("target").alias("paper_id"), F.col("raw_text").alias("ask"))
        got = locate(asks, ["claim_id", "pos"], sentences, counts, strip_stamps)
        seen = tried.select("claim_id", "pos", "reason").join(got, ["claim_id", "pos"], "left")
        ends = F.coalesce(F.col("full") | (F.col("shortcut") & (F.size("refs") > 0)), F.lit(False))
        per = seen.groupBy("claim_id").agg(
            F.array_sort(F.collect_list(F.struct("pos", F.col("paper_id").alias("paper"), "sentence_ids", "passage", "full", "refs", ends.alias("ends"), "reason"))).alias("all"),
            F.min(F.when(ends, F.col("pos"))).alias("stop"),
        )
        s = checkpoint(go.join(per, "claim_id", "left"))
        used = F.filter(F.coalesce("all", F.array().cast("array<struct<pos:int,paper:string,sentence_ids:array<int>,passage:string,full:boolean,refs:array<string>,ends:boolean,reason:string>>")), lambda x: x["paper"].isNotNull() & (F.col("stop").isNull() | (x["pos"] <= F.col("stop"))))
        steps = F.transform(used, lambda x: F.struct(F.lit(depth).alias("depth"), x["paper"].alias("source_paper_id"), x["sentence_ids"].alias("sentence_ids"), x["passage"].alias("extracted_text")))
        failed = F.filter(F.coalesce("all", F.array().cast("array<struct<pos:int,paper:string,sentence_ids:array<int>,passage:string,full:boolean,refs:array<string>,ends:boolean,reason:string>>")), lambda x: x["paper"].isNull())
        s = s.withColumns({"chain": F.concat("chain", steps), "last": F.try_element_at(used, F.lit(-1)), "fail": F.try_element_at(failed, F.lit(-1))["reason"], "n_used": F.size(used)})
        add(s.filter("stop is not null and last.full").select("claim_id", F.lit("resolved").alias("status"), F.lit(None).cast("string").alias("reason"), F.col("last.passage").alias("resolved_text"), F.round(ids.chain_confidence(F.lit(depth)), 6).alias("confidence"), "chain"))
        add(gap(s.filter("stop is null"), F.when(F.col("n_used") > 0, "no_match_in_cited").otherwise(F.coalesce("fail", F.lit("reference_unresolved")))))
        front = s.filter("stop is not null and not last.full").select("claim_id", F.col("last.paper").alias("at"), F.coalesce(F.nullif("last.passage", F.lit("")), "raw_text").alias("raw_text"), F.col("last.refs").alias("refs"), "chain")
        front = checkpoint(front)
        if front.isEmpty():
            break
    return done


def infer(claims: DataFrame, corpus: DataFrame, exclude_prefix: str = "fixture:") -> DataFrame:
    """(claim_id, status, reason, resolved_text, confidence, source_paper_id) of partial and standard claims from other papers' resolved claims of the same type.

    The best 3 (partial) or 5 (standard) come first, the support test after; the best supported one counts.
    """
    with shuffled_joins(claims.sparkSession):
        return _inferred(claims, corpus, exclude_prefix)


def _inferred(claims: DataFrame, corpus: DataFrame, exclude_prefix: str) -> DataFrame:
    docs = corpus.filter((F.col("resolution_status") == "resolved") & (F.coalesce("resolved_text", F.lit("")) != "") & ~F.col("paper_id").startswith(exclude_prefix)).select(F.col("claim_id").alias("cand_id"), F.col("paper_id").alias("cand_paper"), "type", F.col("raw_text").alias("cand_raw"), F.col("resolved_text").alias("cand_text"))
    asks = claims.filter(F.col("specificity").isin("partially_described", "standard_unspecified"))
    best = retrieve.bm25(docs.withColumn("paper_id", F.col("cand_paper")), ["cand_id"], "cand_raw", asks.select("claim_id", "paper_id", "type", "raw_text"), "claim_id", "raw_text", 5, ["type"], own="paper_id")
    j = best.join(asks.select("claim_id", "specificity", "raw_text"), "claim_id").join(docs.drop("type"), "cand_id")
    j = j.filter((F.col("specificity") == "standard_unspecified") | (F.col("rank0") < 3)).filter(text.candidate_supports(F.col("raw_text"), F.col("cand_raw"), F.col("cand_text")))
    top = checkpoint(j.groupBy("claim_id").agg(F.min(F.struct("rank0", "cand_paper", "cand_text")).alias("m")))
    marker = F.when(F.col("specificity") == "partially_described", F.concat(F.lit("[Corpus inference: "), F.col("m.cand_paper"), F.lit("]"))).otherwise(F.concat(F.lit("[Inferred 'standard' from corpus: "), F.col("m.cand_paper"), F.lit("]")))
    return asks.join(top, "claim_id", "left").select(
        "claim_id",
        F.when(F.col("m").isNotNull(), "inferred").otherwise("terminal_gap").alias("status"),
        F.when(F.col("m").isNull(), "no_match_in_cited").alias("reason"),
        F.when(F.col("m").isNotNull(), F.concat("raw_text", F.lit("\n\n"), marker, F.lit("\n"), F.col("m.cand_text"))).alias("resolved_text"),
        F.when(F.col("m").isNull(), 0.0).when(F.col("specificity") == "partially_described", 0.5).otherwise(0.4).alias("confidence"),
        F.col("m.cand_paper").alias("source_paper_id"),
    )


def resolve(claims: DataFrame, refs: DataFrame, papers: DataFrame, sentences: DataFrame, by_citation: bool = True, strip_stamps: bool = False) -> DataFrame:
    """All claims with status, reason, text, confidence and chain.

    Shortcuts walk; partial and standard claims walk if they cite, then fall back on the corpus.
    A partial claim keeps the walk's reason where the corpus fails, a standard one the corpus's.
    """
    with shuffled_joins(claims.sparkSession):
        return _resolved(claims, refs, papers, sentences, by_citation, strip_stamps)


def _resolved(claims: DataFrame, refs: DataFrame, papers: DataFrame, sentences: DataFrame, by_citation: bool, strip_stamps: bool) -> DataFrame:
    claims = checkpoint(claims)
    open_ = claims.filter("specificity <> 'fully_described'")
    walking = open_.filter((F.col("specificity") == "shortcut_citation") | (F.size("cited_ref_ids") > 0))
    w = checkpoint(walk(walking.select("claim_id", "paper_id", "raw_text", "cited_ref_ids"), refs, papers, sentences, by_citation, MAX_DEPTH, strip_stamps))
    failed = open_.join(w.filter("status = 'resolved'").select("claim_id"), "claim_id", "left_anti")
    c = infer(failed, claims)
    j = claims.select("claim_id", "paper_id", "raw_sentence_id", "raw_text", "type", "specificity", "cited_ref_ids").join(w, "claim_id", "left").join(c.select(F.col("claim_id"), F.col("status").alias("c_status"), F.col("reason").alias("c_reason"), F.col("resolved_text").alias("c_text"), F.col("confidence").alias("c_conf"), F.col("source_paper_id").alias("c_source")), "claim_id", "left")
    full, walked, inferred = F.col("specificity") == "fully_described", F.col("status") == "resolved", F.col("c_status") == "inferred"
    inferred_chain = F.array(F.struct(F.lit(0).alias("depth"), F.col("c_source").alias("source_paper_id"), F.array().cast("array<int>").alias("sentence_ids"), F.col("c_text").alias("extracted_text")))
    return j.select(
        "claim_id", "paper_id", "raw_sentence_id", "raw_text", "type", "specificity", "cited_ref_ids",
        F.when(full | walked, "resolved").when(inferred, "inferred").otherwise("terminal_gap").alias("resolution_status"),
        F.when(full | walked | inferred, F.lit(None).cast("string")).when(F.col("specificity") == "standard_unspecified", F.col("c_reason")).otherwise(F.coalesce("reason", "c_reason")).alias("terminal_gap_reason"),
        F.when(full, F.col("raw_text")).when(walked, F.col("resolved_text")).when(inferred, F.col("c_text")).alias("resolved_text"),
        F.when(full, 0.0).when(walked, F.col("confidence")).when(inferred, F.col("c_conf")).otherwise(0.0).alias("confidence"),
        F.when(full, F.array().cast(STEP)).when(walked, F.col("chain")).when(inferred, inferred_chain.cast(STEP)).otherwise(F.coalesce("chain", F.array().cast(STEP))).alias("resolution_chain"),
    )
