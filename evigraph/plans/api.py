"""Queries through the user-facing calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph import api
from evigraph.operators import nested, score
from evigraph.plans.resolution import REFS_SQL, refs
from evigraph.plans.retrieval import REF_QUERIES, bm25_sql, ref_queries
from evigraph.plans.text import PAPER_CLAIMS, paper_claims, papers
from evigraph.sources import read_table


def _gapped(spark: SparkSession, d: str) -> DataFrame:
    return paper_claims(spark, d).withColumn("resolution_status", F.when(F.col("specificity") == "fully_described", "resolved").otherwise("terminal_gap"))


def evidence_search(spark: SparkSession, d: str) -> DataFrame:
    """Five best claims of the corpus for each query citation."""
    return api.search_evidence(ref_queries(spark, d).drop("paper_id"), paper_claims(spark, d), "ref_row_id", "q", 5)


def filtered_claim_search(spark: SparkSession, d: str) -> DataFrame:
    """Three best resolved procedure claims for each query citation, papers from PDFs left out."""
    return api.search_claims(ref_queries(spark, d).drop("paper_id"), paper_claims(spark, d), "ref_row_id", "q", 3, {"type": "procedure", "resolution_status": "resolved"}, "pdf:")


_ALL = bm25_sql(PAPER_CLAIMS, "paper_id, raw_sentence_id", "raw_text", REF_QUERIES, "ref_row_id", "1000000000")
FILTERED_SQL = f"""
SELECT ref_row_id, paper_id, raw_sentence_id, score, row_number() OVER (PARTITION BY ref_row_id ORDER BY score DESC, paper_id, raw_sentence_id) - 1 AS rank0
FROM ({_ALL.replace('*, row_number()', 'ref_row_id, paper_id, raw_sentence_id, score, row_number()')}) JOIN ({PAPER_CLAIMS}) c USING (paper_id, raw_sentence_id)
WHERE c.type = 'procedure' AND c.specificity = 'fully_described' AND NOT starts_with(paper_id, 'pdf:') QUALIFY row_number() OVER (PARTITION BY ref_row_id ORDER BY score DESC, paper_id, raw_sentence_id) <= 3"""


def section_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = api.manifest(_gapped(spark, d))
    flat = F.array_sort(F.transform(F.map_entries("sections"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return m.select("paper_id", F.array_join(flat, ",").alias("sections"), "n_gaps")


_SEC = "CASE type WHEN 'reagent' THEN 'reagents' WHEN 'dataset' THEN 'datasets' WHEN 'parameter' THEN 'procedure' ELSE type END"
MANIFEST_SQL = f"""
SELECT paper_id, coalesce(string_agg(section || '=' || n, ',' ORDER BY section || '=' || n) FILTER (n > 0), '') AS sections, sum(g)::BIGINT AS n_gaps FROM (
  SELECT paper_id, {_SEC} AS section, count(*) FILTER (specificity = 'fully_described') AS n, count(*) FILTER (specificity <> 'fully_described') AS g FROM ({PAPER_CLAIMS}) GROUP BY ALL) GROUP BY 1"""


def suite_selection(spark: SparkSession, d: str) -> DataFrame:
    """The works that references name by DOI as an allow-list."""
    return api.select_suite(papers(spark, d), refs(spark, d).select(F.concat(F.lit("doi:"), "doi").alias("paper_id")))


def evaluation_rows(spark: SparkSession, d: str) -> DataFrame:
    return api.evaluation_rows(_gapped(spark, d))


def print_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources of each protocol record in the order they are printed."""
    n = nested.nest_holders(read_table(spark, d, "protocol_records"))
    own = n.select("record_id", F.col("paper_id").alias("source_paper_id"), F.lit(True).alias("is_own"))
    u = score.source_usage(nested.sentence_links(n), n.select("record_id", "paper_id")).join(own, ["record_id", "source_paper_id"], "left").na.fill(False, ["is_own"])
    return score.print_numbers(u).select("record_id", "source_paper_id", "number", "n_sentences")


def queries() -> dict:
    return {f.__name__: f for f in (evidence_search, filtered_claim_search, section_manifest, suite_selection, evaluation_rows, print_sources)}


def oracle_sql() -> dict:
    return {
        "evidence_search": f"SELECT h.*, c.raw_text AS text FROM ({bm25_sql(PAPER_CLAIMS, 'paper_id, raw_sentence_id', 'raw_text', REF_QUERIES, 'ref_row_id', '5')}) h JOIN ({PAPER_CLAIMS}) c USING (paper_id, raw_sentence_id)",
        "filtered_claim_search": FILTERED_SQL,
        "section_manifest": MANIFEST_SQL,
        "suite_selection": f"SELECT paper_id, paper_id IN (SELECT paper_id FROM papers) AS present FROM (SELECT DISTINCT 'doi:' || doi AS paper_id FROM ({REFS_SQL}) WHERE doi IS NOT NULL)",
        "evaluation_rows": f"SELECT paper_id, round(100 * sum((specificity = 'fully_described')::INT) / count(*), 6) AS score, count(DISTINCT CASE WHEN specificity = 'fully_described' THEN {_SEC} END) AS n_sections, count(*) FILTER (specificity <> 'fully_described') AS n_gaps, bool_or(specificity = 'fully_described') AS ok FROM ({PAPER_CLAIMS}) GROUP BY 1",
    }
