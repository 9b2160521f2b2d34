"""Queries on citations, resolution, scores, assembly and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import analytics, citations, nested, resolve, score, store
from evigraph.plans.text import PAPER_CLAIMS, PAPERS_SQL, UUID_SQL, WS, norm_sql, paper_claims, paper_sentences, papers
from evigraph.session import checkpoint
from evigraph.sources import latest_rows, read_table

REFS_SQL = "SELECT DISTINCT ON (ref_row_id) * FROM paper_refs"
KEY_SQL = rf"regexp_replace(lower(trim({{0}})), '^[\[\]#]+|[\[\]#]+$', '', 'g')"


def refs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "paper_refs").dropDuplicates(["ref_row_id"])


def ref_join(spark: SparkSession, d: str) -> DataFrame:
    """References that each claim's bracketed ids name in its own paper's list."""
    j = citations.cited_references(paper_claims(spark, d), refs(spark, d))
    return j.groupBy("paper_id", "ref_key").agg(F.count(F.lit(1)).alias("n_citations"), F.max("ref_row_id").alias("ref_row_id"))


REF_JOIN_SQL = f"""
WITH t AS (SELECT paper_id, {KEY_SQL.format('ref_id')} AS ref_key, ref_row_id FROM ({REFS_SQL}) WHERE {KEY_SQL.format('ref_id')} <> '' QUALIFY row_number() OVER (PARTITION BY paper_id, {KEY_SQL.format('ref_id')} ORDER BY ref_pos DESC, ref_row_id DESC) = 1),
c AS (SELECT paper_id, {KEY_SQL.format('id')} AS ref_key FROM (SELECT paper_id, unnest(cited_ref_ids) AS id FROM ({PAPER_CLAIMS})))
SELECT paper_id, ref_key, count(*) AS n_citations, max(ref_row_id) AS ref_row_id FROM c JOIN t USING (paper_id, ref_key) GROUP BY ALL"""


def fetch_priority(spark: SparkSession, d: str) -> DataFrame:
    """Where each reference's identifiers lead, or why they do not."""
    return citations.fetch_targets(refs(spark, d), papers(spark, d, "title", "abstract", "methods_text"), by_citation=False).select("ref_row_id", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("via", F.lit("")).alias("via"), F.coalesce("reason", F.lit("")).alias("reason"))


HAS_METHODS = rf"regexp_replace(coalesce(methods_text, ''), '{WS}', '', 'g') <> ''"
FETCH_SQL = rf"""
WITH i AS (SELECT ref_row_id, 0 AS rk, 'doi:' || lower(regexp_replace(regexp_extract(doi, '(10\.[0-9]{{4,9}}/[^\s?#]+)', 1), '[.,;:)\]}}]+$', '')) AS t FROM ({REFS_SQL})
  UNION ALL SELECT ref_row_id, 1, 'arxiv:' || regexp_extract(arxiv_id, '([0-9]{{4}}\.[0-9]{{4,5}})', 1) FROM ({REFS_SQL})
  UNION ALL SELECT ref_row_id, 2, 'pmc:' || upper(regexp_extract(pmc_id, '(?i)(PMC[0-9]+)', 1)) FROM ({REFS_SQL})),
f AS (SELECT ref_row_id, rk, t, {HAS_METHODS} AS ok FROM i JOIN ({PAPERS_SQL}) p ON p.paper_id = i.t),
g AS (SELECT ref_row_id, min(rk * 1000) FILTER (ok) AS m, arg_min(t, rk) FILTER (ok) AS t FROM f GROUP BY 1)
SELECT ref_row_id, coalesce(t, '') AS target, CASE WHEN m IS NULL THEN '' ELSE ['doi', 'arxiv', 'pmc'][(m // 1000 + 1)::INT] END AS via,
  CASE WHEN m IS NOT NULL THEN '' WHEN g.ref_row_id IS NOT NULL THEN 'source_unavailable' ELSE 'reference_unresolved' END AS reason
FROM (SELECT DISTINCT ref_row_id FROM paper_refs) LEFT JOIN g USING (ref_row_id)"""


def acquisition_decision(spark: SparkSession, d: str) -> DataFrame:
    """What to do for each paper that references name, at a fixed time with a time to live of a year."""
    wanted = refs(spark, d).select(F.concat(F.lit("doi:"), F.lower("doi")).alias("paper_id")).filter("paper_id is not null").unionByName(papers(spark, d).select("paper_id"))
    stored = latest_rows(read_table(spark, d, "papers").select("paper_id", "methods_text", "ingested_at"), "paper_id", "ingested_at")
    return citations.acquisition(wanted, stored, F.to_timestamp(F.lit("2025-01-01 00:00:00")), 365 * 86_400)


ACQ_SQL = f"""
SELECT paper_id, CASE WHEN {HAS_METHODS} THEN 'hit' WHEN epoch_us(TIMESTAMP '2025-01-01') - epoch_us(ingested_at) >= 0 AND epoch_us(TIMESTAMP '2025-01-01') - epoch_us(ingested_at) < 31536000000000 THEN 'fresh_negative' ELSE 'fetch' END AS decision
FROM (SELECT 'doi:' || lower(doi) AS paper_id FROM paper_refs WHERE doi IS NOT NULL UNION SELECT paper_id FROM papers) LEFT JOIN ({PAPERS_SQL}) USING (paper_id)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    t = citations.fetch_targets(refs(spark, d), papers(spark, d, "title", "abstract", "methods_text"), by_citation=False).filter("target is not null")
    return refs(spark, d).select("ref_row_id", F.col("paper_id").alias("src")).join(t.select("ref_row_id", F.col("target").alias("dst")), "ref_row_id").select("src", "dst")


def citation_reachability(spark: SparkSession, d: str) -> DataFrame:
    """Papers reached over identifier citations within five steps."""
    return citations.reachable(_edges(spark, d), 5)


REACH_SQL = f"""
WITH RECURSIVE e AS (SELECT DISTINCT paper_id AS src, target AS dst FROM ({FETCH_SQL}) JOIN ({REFS_SQL}) USING (ref_row_id) WHERE target <> '' AND target <> paper_id),
w AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT w.src, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.dst WHERE w.depth < 5 AND w.src <> e.dst)
SELECT src, dst, min(depth) AS depth FROM w GROUP BY ALL"""


def corpus_inference(spark: SparkSession, d: str) -> DataFrame:
    """Partial and standard claims filled from other papers' resolved claims."""
    c = checkpoint(paper_claims(spark, d))
    i = resolve.infer(c, c)
    return i.select("claim_id", "status", F.coalesce("source_paper_id", F.lit("")).alias("source_paper_id"), "confidence")


def _inference_sql() -> str:
    from evigraph.plans.retrieval import _MEAN, bm25_sql

    cid = f"(SELECT *, {UUID_SQL} AS claim_id FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(paper_id || '|' || raw_sentence_id || '|' || type || '|' || {norm_sql('raw_text')})) AS h FROM ({PAPER_CLAIMS})))"
    docs = f"SELECT type, claim_id AS cand_id, raw_text FROM {cid} WHERE specificity = 'fully_described'"
    asks = f"SELECT claim_id, type, raw_text AS q FROM {cid} WHERE specificity IN ('partially_described', 'standard_unspecified')"
    full = bm25_sql(docs, "type, cand_id", "raw_text", asks, "claim_id", "1000000000", "type")
    over = f"len(list_intersect({_MEAN.format('a.raw_text')}, {_MEAN.format('b.raw_text')}))"
    return f"""
WITH c AS MATERIALIZED (SELECT * FROM {cid}), s AS ({full}),
k AS (SELECT s.claim_id, s.cand_id, row_number() OVER (PARTITION BY s.claim_id ORDER BY s.score DESC, s.cand_id) - 1 AS rk FROM s JOIN c a ON a.claim_id = s.claim_id JOIN c b ON b.claim_id = s.cand_id WHERE a.paper_id <> b.paper_id QUALIFY rk < 5),
f AS (SELECT k.claim_id, k.rk, b.paper_id AS src FROM k JOIN c a ON a.claim_id = k.claim_id JOIN c b ON b.claim_id = k.cand_id WHERE (a.specificity = 'standard_unspecified' OR rk < 3)
  AND {over} >= 2 AND {over} / greatest(least(len({_MEAN.format('a.raw_text')}), len({_MEAN.format('b.raw_text')})), 1) >= 0.2),
t AS (SELECT claim_id, arg_min(src, rk) AS src FROM f GROUP BY 1)
SELECT c.claim_id, CASE WHEN src IS NULL THEN 'terminal_gap' ELSE 'inferred' END AS status, coalesce(src, '') AS source_paper_id, CASE WHEN src IS NULL THEN 0.0::DOUBLE WHEN specificity = 'partially_described' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS confidence
FROM c LEFT JOIN t USING (claim_id) WHERE specificity IN ('partially_described', 'standard_unspecified')"""


def chain_walk(spark: SparkSession, d: str) -> DataFrame:
    """Shortcut claims followed through cited papers to the passage that describes the method."""
    c = paper_claims(spark, d).filter("specificity = 'shortcut_citation'")
    w = resolve.walk(c.select("claim_id", "paper_id", "raw_text", "cited_ref_ids"), refs(spark, d), papers(spark, d, "title", "abstract", "methods_text"), paper_sentences(spark, d))
    return w.select("claim_id", "status", F.coalesce("reason", F.lit("")).alias("reason"), F.size("chain").alias("n_steps"), "confidence")


def resolved(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(paper_claims(spark, d), refs(spark, d), papers(spark, d, "title", "abstract", "methods_text"), paper_sentences(spark, d))


def resolve_claims(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline from papers to resolved claims."""
    r = resolved(spark, d)
    return r.select("claim_id", "paper_id", "raw_sentence_id", "specificity", "resolution_status", F.coalesce("terminal_gap_reason", F.lit("")).alias("reason"), "confidence", F.size("resolution_chain").alias("n_steps"))


def protocol_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage per paper and type after resolution."""
    r = resolved(spark, d)
    r = r.withColumn("backed", score.evidence(F.col("specificity"), F.col("resolution_status"), F.col("resolution_chain")))
    return score.coverage(r, "paper_id").filter("paper_id is not null")


def _backed(spark: SparkSession, d: str) -> DataFrame:
    src = papers(spark, d, "source").select("paper_id", F.coalesce(F.regexp_replace(F.lower(F.trim("source")), r"[\s\-_]+", "_"), F.lit("unknown")).alias("source"))
    return paper_claims(spark, d).join(src, "paper_id").withColumn("backed", score.evidence(F.col("specificity"), F.col("resolution_status")))


BACKED = rf"SELECT c.*, coalesce(regexp_replace(lower(trim(p.source)), '[\s\-_]+', '_', 'g'), 'unknown') AS source, (specificity = 'fully_described')::INT AS backed FROM ({PAPER_CLAIMS}) c JOIN ({PAPERS_SQL}) p USING (paper_id)"


def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: papers to sentences to typed claims to coverage by source and type."""
    return score.coverage(_backed(spark, d), "source").select("source", F.coalesce("type", F.lit("all")).alias("type"), "n_claims", "n_backed", "coverage")


WEIGHTS = [("reagent", 2.0), ("equipment", 1.0), ("sample_prep", 1.5), ("procedure", 3.0), ("analysis", 1.0)]


def weighted_coverage(spark: SparkSession, d: str) -> DataFrame:
    return score.weighted_coverage(_backed(spark, d), spark.createDataFrame(WEIGHTS, "type string, weight double"), "source")


def section_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Claims in sections; claims that name a temperature are proposed for a section of their own first."""
    c = paper_claims(spark, d).withColumn("resolution_status", F.when(F.col("specificity") == "shortcut_citation", "terminal_gap").otherwise(F.col("resolution_status")))
    c = checkpoint(c.select("paper_id", "claim_id", "raw_sentence_id", "type", "resolution_status", F.contains("raw_text", F.lit("°C")).alias("hot")))
    p = c.filter("hot").select("paper_id", "claim_id", F.lit("temperatures").alias("section"), F.lit(0).alias("s_no"), F.col("raw_sentence_id").alias("i_no"))
    return score.assemble(c, p).join(c.select("claim_id", "raw_sentence_id").distinct(), "claim_id").select("paper_id", "section", "pos", "raw_sentence_id")


SECTION_SQL = f"""
SELECT paper_id, section, row_number() OVER (PARTITION BY paper_id, section ORDER BY raw_sentence_id) - 1 AS pos, raw_sentence_id FROM (
  SELECT paper_id, raw_sentence_id, CASE WHEN contains(raw_text, '°C') THEN 'temperatures' ELSE CASE type WHEN 'reagent' THEN 'reagents' WHEN 'dataset' THEN 'datasets' WHEN 'parameter' THEN 'procedure' ELSE type END END AS section
  FROM ({PAPER_CLAIMS}) WHERE specificity <> 'shortcut_citation')"""


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    """Claims that stay open without any resolution: shortcuts without a reference, and the rest."""
    c = paper_claims(spark, d).filter("specificity <> 'fully_described'")
    return score.gaps(c.withColumns({"resolution_status": F.lit("terminal_gap"), "terminal_gap_reason": F.when(F.size("cited_ref_ids") == 0, "no_reference").when(F.col("specificity") == "shortcut_citation", "reference_unresolved")}))


def gap_report(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d)


def _gap_sql(cols: str) -> str:
    act = "CASE reason WHEN 'no_reference' THEN 'The source gives no traceable reference; contact the authors for procedural detail.' WHEN 'reference_unresolved' THEN 'Resolve the bibliography entry to a DOI or stable paper identifier.' ELSE 'Inspect the source document and extraction manually.' END"
    return f"""SELECT {cols} FROM (SELECT *, {UUID_SQL} AS claim_id, {act} AS suggested_action FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(paper_id || '|' || raw_sentence_id || '|' || type || '|' || {norm_sql('raw_text')})) AS h,
  CASE WHEN len(cited_ref_ids) = 0 THEN 'no_reference' WHEN specificity = 'shortcut_citation' THEN 'reference_unresolved' ELSE 'parsing_failed' END AS reason FROM ({PAPER_CLAIMS}) WHERE specificity <> 'fully_described'))"""


def gaps_csv(spark: SparkSession, d: str) -> DataFrame:
    return score.gap_csv(_gaps(spark, d))


def _cell(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, '[",\\r\\n]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""


CSV_SQL = _gap_sql("paper_id, " + " || ',' || ".join(_cell(c) for c in ("claim_id", "reason", "raw_text", "suggested_action")) + " AS line")


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    c = paper_claims(spark, d).filter("specificity = 'fully_described'").withColumn("resolution_chain", F.array().cast(resolve.STEP))
    return score.markdown(c).select("paper_id", "section", F.md5("body").alias("body_md5"))


MD_SQL = f"""
SELECT paper_id, section, md5('## ' || CASE section WHEN 'sample_prep' THEN 'Sample Prep' ELSE upper(section[1]) || section[2:] END || chr(10) || chr(10) || string_agg('- ' || raw_text, chr(10) ORDER BY raw_sentence_id)) AS body_md5 FROM (
  SELECT *, CASE type WHEN 'reagent' THEN 'reagents' WHEN 'dataset' THEN 'datasets' WHEN 'parameter' THEN 'procedure' ELSE type END AS section FROM ({PAPER_CLAIMS}) WHERE specificity = 'fully_described') GROUP BY paper_id, section"""


def page_slice(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 25 claims in (paper, sentence) order: paging is the feature."""
    return score.page(paper_claims(spark, d).select("paper_id", "raw_sentence_id", "type"), ["paper_id", "raw_sentence_id"], 25, 100)


def training_export(spark: SparkSession, d: str) -> DataFrame:
    c = paper_claims(spark, d).withColumn("resolution_chain", F.array().cast(resolve.STEP))
    return score.training_examples(c)


def claim_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Stored claims of all papers, replaced by marked claims of the German ones."""
    c = paper_claims(spark, d).select("claim_id", "paper_id", "raw_sentence_id", "raw_text")
    de = papers(spark, d, "lang").filter("lang = 'de'")
    fresh = c.join(de, "paper_id", "left_semi").withColumn("raw_text", F.concat(F.lit("de: "), "raw_text"))
    return store.upsert(c, fresh, "claim_id").select("paper_id", "raw_sentence_id", "raw_text")


UPSERT_SQL = f"SELECT paper_id, raw_sentence_id, CASE WHEN lang = 'de' THEN 'de: ' || raw_text ELSE raw_text END AS raw_text FROM ({PAPER_CLAIMS}) JOIN (SELECT paper_id, lang FROM ({PAPERS_SQL})) USING (paper_id)"


def claim_delete(spark: SparkSession, d: str) -> DataFrame:
    """Claims without those of papers that carry the newest ingest version."""
    gone = papers(spark, d, "ingest_version").filter("ingest_version = '4'")
    return store.delete_papers(paper_claims(spark, d).select("paper_id", "raw_sentence_id"), gone)


def _nested(spark: SparkSession, d: str) -> DataFrame:
    return nested.nest_holders(read_table(spark, d, "protocol_records"))


def source_usage(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that each source gives to each protocol record."""
    n = _nested(spark, d)
    u = score.source_usage(nested.sentence_links(n), n.select("record_id", "paper_id"))
    return u.select("record_id", "source_paper_id", "n_sentences", F.array_join(F.transform("sentence_ids", lambda x: x.cast("string")), ",").alias("ids"))


def pathway_summary(spark: SparkSession, d: str) -> DataFrame:
    n = _nested(spark, d)
    return analytics.pathway(nested.holder_rows(n), nested.step_rows(n))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Three runs a paper: as extracted; without claims that hold no digit; with bracketed claims read as full."""
    c = checkpoint(paper_claims(spark, d).select("paper_id", "raw_text", "type", "specificity", "resolution_status", F.col("raw_sentence_id").alias("pos")))
    b = c.filter(F.col("raw_text").rlike("[0-9]"))
    e = c.withColumn("specificity", F.when(F.contains("raw_text", F.lit("(")), "fully_described").otherwise(F.col("specificity")))
    return c.withColumn("run", F.lit(0)).unionByName(b.withColumn("run", F.lit(1))).unionByName(e.withColumn("run", F.lit(2)))


def variability_pairs(spark: SparkSession, d: str) -> DataFrame:
    return analytics.run_pairs(_runs(spark, d))


def variability_report(spark: SparkSession, d: str) -> DataFrame:
    return analytics.variability(_runs(spark, d))


_ST = "CASE WHEN specificity = 'fully_described' THEN 'resolved' ELSE 'unresolved' END"
RUNS_SQL = f"""c AS MATERIALIZED (SELECT paper_id, raw_text, type, specificity, {_ST} AS status, raw_sentence_id AS pos, {norm_sql('raw_text')} AS t FROM ({PAPER_CLAIMS})),
r AS (SELECT *, 0 AS run FROM c UNION ALL SELECT *, 1 FROM c WHERE regexp_matches(raw_text, '[0-9]') UNION ALL SELECT paper_id, raw_text, type, CASE WHEN contains(raw_text, '(') THEN 'fully_described' ELSE specificity END, status, pos, t, 2 FROM c),
g AS (SELECT DISTINCT paper_id, run, t || '|' || type || '|' || specificity || '|' || status AS sig FROM r), n AS (SELECT paper_id, run, count(*) AS n FROM g GROUP BY ALL),
m AS (SELECT a.paper_id, a.run AS l, b.run AS r, count(*) AS sh FROM g a JOIN g b ON a.paper_id = b.paper_id AND a.sig = b.sig AND a.run < b.run GROUP BY ALL),
x AS (SELECT paper_id, run, t, arg_max(type || '|' || specificity || '|' || status, pos) AS lab FROM r GROUP BY ALL),
y AS (SELECT a.paper_id, a.run AS l, b.run AS r, avg((a.lab = b.lab)::INT::DOUBLE) AS ag FROM x a JOIN x b ON a.paper_id = b.paper_id AND a.t = b.t AND a.run < b.run GROUP BY ALL),
p AS (SELECT a.paper_id, a.run AS left_run, b.run AS right_run, round(coalesce(sh, 0)::DOUBLE / (a.n + b.n - coalesce(sh, 0)), 6) AS jaccard, round(coalesce(ag, 0), 6) AS agreement
  FROM n a JOIN n b ON a.paper_id = b.paper_id AND a.run < b.run LEFT JOIN m ON m.paper_id = a.paper_id AND m.l = a.run AND m.r = b.run LEFT JOIN y ON y.paper_id = a.paper_id AND y.l = a.run AND y.r = b.run)"""
REPORT_SQL = f"""WITH {RUNS_SQL}, k AS (SELECT paper_id, run, count(*) AS n FROM r GROUP BY ALL),
s AS (SELECT paper_id, count(*) AS n_runs, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, round(CASE WHEN count(*) > 1 THEN stddev_pop(n) / avg(n) ELSE 0 END, 6) AS cv FROM k GROUP BY 1),
q AS (SELECT paper_id, round(avg(jaccard), 6) AS jaccard_mean, min(jaccard) AS jaccard_min, round(avg(agreement), 6) AS agreement_mean, min(agreement) AS agreement_min FROM p GROUP BY 1)
SELECT s.*, coalesce(jaccard_mean, 1) AS jaccard_mean, coalesce(jaccard_min, 1) AS jaccard_min, coalesce(agreement_mean, 1) AS agreement_mean, coalesce(agreement_min, 1) AS agreement_min FROM s LEFT JOIN q USING (paper_id)"""


def specificity_counts(spark: SparkSession, d: str) -> DataFrame:
    return analytics.counts_by(paper_claims(spark, d), "paper_id", "specificity")


def mode_list(spark: SparkSession, d: str) -> DataFrame:
    """Sources of each publication year's papers, as distinct sorted lists."""
    return analytics.modes(papers(spark, d, "pub_year", "source").filter("pub_year is not null"), "pub_year", "source")


def queries() -> dict:
    fs = (ref_join, fetch_priority, acquisition_decision, citation_reachability, corpus_inference, chain_walk, resolve_claims, protocol_coverage, evidence_coverage, weighted_coverage, section_assembly, gap_report, gaps_csv, markdown_sections, page_slice, training_export, claim_upsert, claim_delete, source_usage, pathway_summary, variability_pairs, variability_report, specificity_counts, mode_list)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict:
    w = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS)
    return {
        "ref_join": REF_JOIN_SQL,
        "fetch_priority": FETCH_SQL,
        "acquisition_decision": ACQ_SQL,
        "citation_reachability": REACH_SQL,
        "corpus_inference": _inference_sql(),
        "evidence_coverage": f"SELECT source, coalesce(type, 'all') AS type, count(*) AS n_claims, sum(backed)::BIGINT AS n_backed, round(100 * sum(backed) / count(*), 6) AS coverage FROM ({BACKED}) GROUP BY GROUPING SETS ((source), (source, type))",
        "weighted_coverage": f"SELECT source, round(100 * sum(w * backed) / sum(w), 6) AS weighted FROM (SELECT *, (CASE type {w} ELSE 1 END)::DOUBLE AS w FROM ({BACKED})) GROUP BY 1",
        "section_assembly": SECTION_SQL,
        "gap_report": _gap_sql("paper_id, claim_id, raw_text, type, specificity, reason, suggested_action"),
        "gaps_csv": CSV_SQL,
        "markdown_sections": MD_SQL,
        "page_slice": f"SELECT paper_id, raw_sentence_id, type FROM ({PAPER_CLAIMS}) ORDER BY encode(paper_id), raw_sentence_id LIMIT 25 OFFSET 25",
        "training_export": f"SELECT paper_id, raw_sentence_id AS sentence_id, raw_text AS text, type, specificity, raw_text AS resolved_text, 0 AS n_evidence FROM ({PAPER_CLAIMS}) WHERE specificity = 'fully_described'",
        "claim_upsert": UPSERT_SQL,
        "claim_delete": f"SELECT paper_id, raw_sentence_id FROM ({PAPER_CLAIMS}) WHERE paper_id NOT IN (SELECT paper_id FROM ({PAPERS_SQL}) WHERE ingest_version = '4')",
        "variability_pairs": f"WITH {RUNS_SQL} SELECT * FROM p",
        "variability_report": REPORT_SQL,
        "specificity_counts": f"SELECT paper_id, specificity, count(*) AS n FROM ({PAPER_CLAIMS}) GROUP BY ALL",
        "mode_list": f"SELECT pub_year, string_agg(DISTINCT m, ',' ORDER BY m) AS modes FROM (SELECT pub_year, coalesce(nullif(trim(source), ''), 'unknown') AS m FROM ({PAPERS_SQL}) WHERE pub_year IS NOT NULL) GROUP BY 1",
    }


