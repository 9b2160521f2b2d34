"""Queries on text shaping and claim rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import ids, text
from evigraph.functions.lexicon import ABBREVIATIONS, DEFAULT
from evigraph.operators import claims as C
from evigraph.sources import latest_rows, read_table

WS = text.WS
PAPERS_SQL = "SELECT * FROM papers QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at DESC NULLS LAST) = 1"


def sentences_sql(source: str, key: str, col: str) -> str:
    """CTE body: (key, sentence_id, text) by the rule splitter."""
    return rf"""
SELECT {key}, unnest(range(len(s))) AS sentence_id, unnest(s) AS text FROM (
  SELECT {key}, list_transform(range(len(st)), lambda k: array_to_string(list_slice(f, st[k+1] + 1, coalesce(st[k+2], len(f))), ' ')) AS s FROM (
    SELECT {key}, f, list_filter(range(len(f)), lambda i: i = 0 OR NOT regexp_matches(f[i], '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{ABBREVIATIONS})\.$')) AS st FROM (
      SELECT {key}, list_filter(list_transform(flatten(list_transform(string_split_regex({col}, '{text.LINE_END}'),
        lambda l: string_split(regexp_replace(regexp_replace(l, '^{WS}+|{WS}+$', '', 'g'), '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)))),
        lambda p: regexp_replace(p, '^{WS}+|{WS}+$', '', 'g')), lambda p: p <> '') AS f
      FROM ({source}) WHERE {col} IS NOT NULL)))"""


PAPER_SENTENCES = sentences_sql(PAPERS_SQL, "paper_id", "methods_text")


def _q(s: str) -> str:
    return s.replace("'", "''")


def claims_sql(sentences: str, key: str = "paper_id") -> str:
    lex = DEFAULT
    kinds = " ".join(f"WHEN regexp_matches(low, '{_q(C._hints(w))}'){f' OR regexp_matches(low, {chr(39)}{_q(lex.concentration)}{chr(39)})' if k == 'reagent' else ''} THEN '{k}'" for k, w in lex.types)
    return rf"""
SELECT {key}, sentence_id AS raw_sentence_id, text AS raw_text,
  CASE WHEN regexp_matches(text, '(?i){_q(C._any(lex.shortcut))}') THEN 'shortcut_citation' WHEN regexp_matches(text, '(?i){_q(C._any(lex.standard))}') THEN 'standard_unspecified'
       WHEN regexp_matches(low, '{_q(C._hints(lex.partial))}') THEN 'partially_described' ELSE 'fully_described' END AS specificity,
  CASE {kinds} ELSE 'procedure' END AS type,
  regexp_extract_all(text, '(?i){lex.ref_id}', 1) AS cited_ref_ids
FROM (SELECT *, lower(text) AS low FROM ({sentences})) WHERE len(regexp_extract_all(text, '[A-Za-z]+')) >= 3"""


PAPER_CLAIMS = claims_sql(PAPER_SENTENCES)


def norm_sql(x: str) -> str:
    """SQL of the normal form of an expression."""
    return rf"replace(lower(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g')), 'ß', 'ss')"




def papers(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest_rows(read_table(spark, d, "papers").select("paper_id", "ingested_at", *cols), "paper_id", "ingested_at").drop("ingested_at")


def paper_sentences(spark: SparkSession, d: str) -> DataFrame:
    return C.sentence_rows(papers(spark, d, "methods_text"))


def paper_claims(spark: SparkSession, d: str) -> DataFrame:
    return C.rule_claims(paper_sentences(spark, d))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return paper_sentences(spark, d)


def document_sentences(spark: SparkSession, d: str) -> DataFrame:
    return C.sentence_rows(read_table(spark, d, "documents"), "doc_id", "text")


def sentence_stamp(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d, "methods_text").filter("methods_text is not null").select("paper_id", F.md5(text.stamp(text.sentences(F.col("methods_text")))).alias("stamped_md5"))


def stamp_round_trip(spark: SparkSession, d: str) -> DataFrame:
    s = papers(spark, d, "methods_text").filter("methods_text is not null").select("paper_id", text.sentences(F.col("methods_text")).alias("s"))
    p = s.select("paper_id", F.posexplode(text.parse_stamped(text.stamp(F.col("s")))).alias("i", "x"))
    return p.select("paper_id", F.col("x.sentence_id").alias("sentence_id"), F.col("x.text").alias("text"))


def chunk_packing(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each methods text packed greedily to 500 characters; a line is never cut."""
    p = papers(spark, d, "methods_text").filter("methods_text is not null").select("paper_id", F.split("methods_text", r"\n").alias("l"))
    p = p.withColumn("no", text.pack(F.transform("l", lambda x: F.length(x) + 1), 500))
    e = p.select("paper_id", F.explode(F.arrays_zip("no", "l")).alias("z"))
    return e.groupBy("paper_id", F.col("z.no").alias("chunk_no")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("z.l") + 1).alias("n_chars"))


def batch_packing(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each paper in batches of at most 25 and 2,000 characters."""
    s = papers(spark, d, "methods_text").select("paper_id", text.sentences(F.col("methods_text")).alias("s"))
    s = s.withColumn("no", text.pack(F.transform("s", lambda x: F.length(x)), 2_000, 25))
    e = s.select("paper_id", F.explode(F.arrays_zip("no", "s")).alias("z"))
    return e.groupBy("paper_id", F.col("z.no").alias("batch_no")).agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.length("z.s")).alias("n_chars"))


def _packing_sql(items: str, size: str, most: int, many: int, no: str, n: str) -> str:
    return f"""
WITH RECURSIVE it AS ({items}), w AS (
  SELECT paper_id, i, {size} AS z, {size} AS cur, 1 AS cnt, 0 AS no FROM it WHERE i = 1
  UNION ALL
  SELECT it.paper_id, it.i, it.z0, CASE WHEN (w.cur > 0 AND w.cur + it.z0 > {most}) OR w.cnt >= {many} THEN it.z0 ELSE w.cur + it.z0 END,
    CASE WHEN (w.cur > 0 AND w.cur + it.z0 > {most}) OR w.cnt >= {many} THEN 1 ELSE w.cnt + 1 END,
    CASE WHEN (w.cur > 0 AND w.cur + it.z0 > {most}) OR w.cnt >= {many} THEN w.no + 1 ELSE w.no END
  FROM w JOIN (SELECT *, {size} AS z0 FROM it) it ON it.paper_id = w.paper_id AND it.i = w.i + 1)
SELECT paper_id, no AS {no}, count(*) AS {n}, sum(z)::BIGINT AS n_chars FROM w GROUP BY ALL"""


CHUNK_SQL = _packing_sql(f"SELECT paper_id, unnest(string_split(methods_text, chr(10))) AS x, unnest(range(1, len(string_split(methods_text, chr(10))) + 1)) AS i FROM ({PAPERS_SQL}) WHERE methods_text IS NOT NULL", "length(x) + 1", 500, 1_000_000_000, "chunk_no", "n_lines")
BATCH_SQL = _packing_sql(f"SELECT paper_id, text AS x, sentence_id + 1 AS i FROM ({PAPER_SENTENCES})", "length(x)", 2_000, 25, "batch_no", "n_items")


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "paper_refs").dropDuplicates(["ref_row_id"])
    return r.select("ref_row_id", text.normalize(F.col("raw_citation")).alias("normal"))


def rule_claims(spark: SparkSession, d: str) -> DataFrame:
    return paper_claims(spark, d).select("paper_id", "raw_sentence_id", "raw_text", "type", "specificity", F.array_join("cited_ref_ids", ",").alias("refs"), "resolution_status")


def claim_ids(spark: SparkSession, d: str) -> DataFrame:
    return paper_claims(spark, d).select("paper_id", "raw_sentence_id", "claim_id", F.sha2("raw_text", 256).alias("text_hash"))


def extraction_mode(spark: SparkSession, d: str) -> DataFrame:
    return C.extraction_mode(paper_sentences(spark, d))


def rejected_papers(spark: SparkSession, d: str) -> DataFrame:
    return C.papers_without_claims(papers(spark, d, "methods_text"), paper_claims(spark, d))


def provenance_filter(spark: SparkSession, d: str) -> DataFrame:
    """Claims attributed to the sentence after their own are kept only where that sentence holds their text, too."""
    c = paper_claims(spark, d)
    both = c.select("paper_id", "raw_sentence_id", F.upper("raw_text").alias("raw_text")).unionByName(c.select("paper_id", (F.col("raw_sentence_id") + 1).alias("raw_sentence_id"), "raw_text"))
    return C.provenance(both, paper_sentences(spark, d)).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_kept"))


def cached_set_valid(spark: SparkSession, d: str) -> DataFrame:
    """Claim sets of papers whose text is unchanged and whose claims are all resolved."""
    p = papers(spark, d, "methods_text").select("paper_id", F.sha2("methods_text", 256).alias("methods_hash"))
    c = paper_claims(spark, d).join(p, "paper_id").withColumn("source_methods_hash", F.col("methods_hash")).drop("methods_hash")
    return C.valid_cached_sets(c, C.VERSION, p)


def identifier_route(spark: SparkSession, d: str) -> DataFrame:
    """Where each reference's identifiers and each paper's id and address lead."""
    r = read_table(spark, d, "paper_refs").select(F.explode(F.array(*[F.col(c) for c in ("doi", "arxiv_id", "pmc_id", "raw_citation")])).alias("ident"))
    p = read_table(spark, d, "papers").select(F.explode(F.array("paper_id", "open_access_url")).alias("ident"))
    x = r.unionByName(p).filter("ident is not null").distinct().withColumn("r", ids.route(F.col("ident")))
    return x.select("ident", F.col("r.scheme").alias("scheme"), F.coalesce("r.id", F.lit("")).alias("id"))


ROUTE_SQL = rf"""
WITH x AS (SELECT DISTINCT ident, regexp_replace(ident, '^{WS}+|{WS}+$', '', 'g') AS t FROM (
  SELECT unnest([doi, arxiv_id, pmc_id, raw_citation]) AS ident FROM paper_refs UNION ALL SELECT unnest([paper_id, open_access_url]) FROM papers) WHERE ident IS NOT NULL),
y AS (SELECT *, regexp_extract(t, '([0-9]{{4}}\.[0-9]{{4,5}})', 1) AS a, upper(regexp_extract(t, '(?i)(PMC[0-9]+)', 1)) AS p,
  lower(regexp_replace(regexp_extract(t, '(10\.[0-9]{{4,9}}/[^\s?#]+)', 1), '[.,;:)\]}}]+$', '')) AS o FROM x)
SELECT ident, CASE WHEN a <> '' THEN 'arxiv' WHEN p <> '' OR starts_with(t, 'pmc:') THEN 'pmc' WHEN o <> '' THEN 'doi' WHEN regexp_matches(lower(t), '^https?://|\.pdf$') OR starts_with(lower(t), 'pdf:') THEN 'pdf' ELSE 'none' END AS scheme,
  CASE WHEN a <> '' THEN a WHEN p <> '' THEN p WHEN starts_with(t, 'pmc:') THEN upper(substr(t, 5)) WHEN o <> '' THEN o WHEN regexp_matches(lower(t), '^https?://|\.pdf$') OR starts_with(lower(t), 'pdf:') THEN t ELSE '' END AS id FROM y"""


def fetch_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """References that are one fetch."""
    r = read_table(spark, d, "paper_refs").dropDuplicates(["ref_row_id"])
    k = ids.fetch_key(*[F.col(c) for c in ("doi", "arxiv_id", "pmc_id", "title", "raw_citation")])
    return r.groupBy(k.alias("fetch_key")).agg(F.count(F.lit(1)).alias("n_refs"), F.min("ref_row_id").alias("first_ref"))


FETCH_SQL = f"""
SELECT coalesce('doi:' || lower(trim(nullif(doi, ''))), 'arxiv:' || lower(trim(nullif(arxiv_id, ''))), 'pmc:' || lower(trim(nullif(pmc_id, ''))), 'citation:' || {norm_sql("coalesce(nullif(title, ''), raw_citation, '')")}) AS fetch_key,
  count(*) AS n_refs, min(ref_row_id) AS first_ref FROM (SELECT * FROM paper_refs QUALIFY row_number() OVER (PARTITION BY ref_row_id ORDER BY paper_id) = 1) GROUP BY 1"""
UUID_SQL = "lower(substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab', (('0x'||substr(h,17,1))::INT % 4)::INT + 1, 1)||substr(h,18,3)||'-'||substr(h,21,12))"
CLAIM_IDS_SQL = f"""
SELECT paper_id, raw_sentence_id, {UUID_SQL} AS claim_id, sha256(raw_text) AS text_hash FROM (
  SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(paper_id || '|' || raw_sentence_id || '|' || type || '|' || {norm_sql('raw_text')})) AS h FROM ({PAPER_CLAIMS}))"""


def queries() -> dict:
    return {f.__name__: f for f in (sentence_split, document_sentences, sentence_stamp, stamp_round_trip, chunk_packing, batch_packing, normalize_text, rule_claims, claim_ids, extraction_mode, rejected_papers, provenance_filter, cached_set_valid, identifier_route, fetch_dedupe)}


def oracle_sql() -> dict:
    return {
        "sentence_split": PAPER_SENTENCES,
        "document_sentences": sentences_sql("SELECT doc_id, text AS body FROM documents", "doc_id", "body"),
        "sentence_stamp": f"SELECT paper_id, coalesce(m, md5('')) AS stamped_md5 FROM (SELECT paper_id FROM ({PAPERS_SQL}) WHERE methods_text IS NOT NULL) LEFT JOIN (SELECT paper_id, md5(string_agg('[' || sentence_id || '] ' || text, chr(10) ORDER BY sentence_id)) AS m FROM ({PAPER_SENTENCES}) GROUP BY paper_id) USING (paper_id)",
        "stamp_round_trip": PAPER_SENTENCES,
        "chunk_packing": CHUNK_SQL,
        "batch_packing": BATCH_SQL,
        "normalize_text": f"SELECT DISTINCT ref_row_id, {norm_sql('raw_citation')} AS normal FROM paper_refs",
        "rule_claims": f"SELECT paper_id, raw_sentence_id, raw_text, type, specificity, array_to_string(cited_ref_ids, ',') AS refs, CASE WHEN specificity = 'fully_described' THEN 'resolved' ELSE 'unresolved' END AS resolution_status FROM ({PAPER_CLAIMS})",
        "claim_ids": CLAIM_IDS_SQL,
        "extraction_mode": f"SELECT paper_id, count(*) AS n_sentences, CASE WHEN count(*) >= 40 THEN 'rules_large_paper' ELSE 'hybrid' END AS mode FROM ({PAPER_SENTENCES}) GROUP BY 1",
        "rejected_papers": f"SELECT paper_id, CASE WHEN regexp_replace(coalesce(methods_text, ''), '{WS}', '', 'g') = '' THEN 'no_methods' ELSE 'no_claims' END AS reason FROM ({PAPERS_SQL}) WHERE paper_id NOT IN (SELECT paper_id FROM ({PAPER_CLAIMS}))",
        "provenance_filter": f"WITH s AS MATERIALIZED ({PAPER_SENTENCES}), c AS ({claims_sql('SELECT * FROM s')}), e AS (SELECT paper_id, raw_sentence_id AS sid, upper(raw_text) AS t FROM c UNION ALL SELECT paper_id, raw_sentence_id + 1, raw_text FROM c) SELECT e.paper_id, count(*) AS n_kept FROM e JOIN s ON s.paper_id = e.paper_id AND s.sentence_id = e.sid WHERE contains({norm_sql('s.text')}, {norm_sql('e.t')}) GROUP BY 1",
        "cached_set_valid": f"SELECT paper_id, count(*) AS n_claims FROM ({PAPER_CLAIMS}) GROUP BY 1 HAVING bool_and(specificity = 'fully_described')",
        "identifier_route": ROUTE_SQL,
        "fetch_dedupe": FETCH_SQL,
    }
