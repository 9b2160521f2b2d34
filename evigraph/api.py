"""The engine's calls for users and agents: search, reconstruct, read. All take and give DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators import claims, resolve, retrieve, score

PLAN = ("ingest papers", "split and number sentences", "extract claims by rules", "resolve claims through citations", "infer the rest from the corpus", "score, assemble and report gaps")


def plan() -> tuple[str, ...]:
    """The stages of a reconstruction."""
    return PLAN


def search_claims(queries: DataFrame, corpus: DataFrame, query_id: str, query_col: str, top_k: int = 10, equal: dict[str, str] | None = None, exclude_prefix: str | None = None) -> DataFrame:
    """Best claims of the corpus for each query, after filters on their columns; statistics cover the whole corpus."""
    keep = F.lit(True)
    for c, v in (equal or {}).items():
        keep = keep & (F.col(c) == v)
    if exclude_prefix:
        keep = keep & ~F.col("paper_id").startswith(exclude_prefix)
    return retrieve.bm25(corpus, ["paper_id", "raw_sentence_id"], "raw_text", queries, query_id, query_col, top_k, keep=keep)


def search_evidence(queries: DataFrame, corpus: DataFrame, query_id: str, query_col: str, top_k: int = 5) -> DataFrame:
    """Hits with their text - the resolved one where there is one; ``top_k`` between 1 and 20."""
    hits = search_claims(queries, corpus, query_id, query_col, min(20, max(1, top_k)))
    text = F.coalesce(F.nullif("resolved_text", F.lit("")), "raw_text").alias("text")
    return hits.join(corpus.select("paper_id", "raw_sentence_id", text), ["paper_id", "raw_sentence_id"])


def reconstruct(papers: DataFrame, refs: DataFrame, by_citation: bool = True) -> dict[str, DataFrame]:
    """Claims, sections, gaps, scores and rejects of all papers at once."""
    sents = claims.sentence_rows(papers)
    raw = claims.rule_claims(sents)
    done = resolve.resolve(raw, refs, papers, sents, by_citation)
    backed = done.withColumn("backed", score.evidence(F.col("specificity"), F.col("resolution_status"), F.col("resolution_chain")))
    return {"claims": done, "sections": score.assemble(done), "gaps": score.gaps(done), "scores": score.coverage(backed, "paper_id"), "rejects": claims.papers_without_claims(papers, raw)}


def read(claims_: DataFrame, section: str | None = None, offset: int = 0, limit: int = 25) -> DataFrame:
    """A page of claims in section order; an unknown section means all."""
    c = claims_.withColumn("section", score.section_of(F.col("type")))
    if section in set(score.SECTION_OF_TYPE.values()):
        c = c.filter(F.col("section") == section)
    return score.page(c.withColumn("_s", score.section_rank(F.col("section"))), ["_s", "section", "paper_id", "raw_sentence_id"], offset, limit).drop("_s")


def manifest(claims_: DataFrame) -> DataFrame:
    """(paper_id, sections map<name, n>, n_gaps) of resolved claims."""
    gap = F.col("resolution_status") == "terminal_gap"
    c = claims_.withColumn("section", score.section_of(F.col("type")))
    n = c.groupBy("paper_id", "section").agg(F.count_if(~gap).alias("n"), F.count_if(gap).alias("g"))
    return n.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("n") > 0, F.struct("section", "n")))).alias("sections"), F.sum("g").alias("n_gaps"))


def select_suite(papers: DataFrame, allowed: DataFrame) -> DataFrame:
    """(paper_id, present): the papers of an allow-list, and which of its ids are missing."""
    a = allowed.select("paper_id").filter("paper_id is not null").distinct()
    return a.join(papers.select("paper_id").distinct().withColumn("_in", F.lit(True)), "paper_id", "left").select("paper_id", F.coalesce("_in", F.lit(False)).alias("present"))


def evaluation_rows(claims_: DataFrame) -> DataFrame:
    """(paper_id, score, n_sections, n_gaps, ok): one row per paper with a claim."""
    gap = F.col("resolution_status") == "terminal_gap"
    c = claims_.withColumns({"section": score.section_of(F.col("type")), "backed": score.evidence(F.col("specificity"), F.col("resolution_status"))})
    g = c.groupBy("paper_id").agg(F.round(100 * F.sum("backed") / F.count(F.lit(1)), 6).alias("score"), F.count_distinct(F.when(~gap, F.col("section"))).alias("n_sections"), F.count_if(gap).alias("n_gaps"))
    return g.withColumn("ok", F.col("n_sections") > 0)
