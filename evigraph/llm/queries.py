"""Driver queries of the llm operators. SQL stands beside a query where it can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.bpe import decode_corpus, encode_corpus
from evigraph.llm.encoding import find_garbled
from evigraph.llm.knn import neighbour_pairs
from evigraph.llm.mix import mix, shares
from evigraph.llm.names import entity_pairs
from evigraph.llm.refmatch import match
from evigraph.llm.sentences import sentence_units
from evigraph.llm.split import split_long
from evigraph.llm.token_budget import canonical_source, document_tokens, roll_up
from evigraph.session import spread
from evigraph.sources import latest_rows, read_table

Query = Callable[[SparkSession, str], DataFrame]


def _papers(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """The latest row of each paper, without its repetitions."""
    return latest_rows(read_table(spark, d, "papers").select("paper_id", "ingested_at", *cols), "paper_id", "ingested_at", "methods_text").drop("ingested_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of each paper's methods text."""
    p = _papers(spark, d, "methods_text", "lang").filter(F.col("methods_text").isNotNull())
    return sentence_units(p, "paper_id", "methods_text", "lang")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of author entries of one person or consortium."""
    a = read_table(spark, d, "paper_authors").select("author_id", "author_name", "affiliation", "orcid")
    return entity_pairs(a).select(F.col("a").alias("author_id_a"), F.col("b").alias("author_id_b"))


def p4_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per source and language of papers, and per source, language and domain of documents."""
    p = _papers(spark, d, "methods_text", "lang", "source").withColumn("source", canonical_source(F.col("source")))
    a = roll_up(document_tokens(p, "paper_id", "methods_text", ("source",), "lang"), "source", "lang")
    t = spread(read_table(spark, d, "documents")).select("doc_id", "text", "lang", canonical_source(F.col("source")).alias("source"), F.coalesce("domain", F.lit("unknown")).alias("domain"))
    b = roll_up(document_tokens(t, "doc_id", "text", ("source", "domain"), "lang"), "source", "lang", "domain")
    cols = ["of_table", "source", "lang", "domain", "n_docs", "n_usable_docs", "n_tokens"]
    return a.withColumns({"of_table": F.lit("papers"), "domain": F.lit("")}).select(*cols).unionByName(b.withColumn("of_table", F.lit("documents")).select(*cols))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of sentence vectors of which one is among the other's five nearest."""
    v = read_table(spark, d, "methods_sentences").select("vec_id", "vector")
    return neighbour_pairs(v, "vec_id", "vector").select(F.col("a").alias("vec_id_a"), F.col("b").alias("vec_id_b"))


def p6_match(spark: SparkSession, d: str) -> DataFrame:
    """The paper each reference cites, with a confidence."""
    p = latest_rows(read_table(spark, d, "papers").select("paper_id", "title", "pub_year", "venue", "ingested_at"), "paper_id", "ingested_at", "title")
    r = read_table(spark, d, "paper_refs").select("ref_row_id", "raw_citation", "title", "pub_year", "doi", "arxiv_id", "pmc_id")
    return match(p, r, read_table(spark, d, "paper_authors").select("paper_id", "author_pos", "author_name"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """References whose cited work is among the papers."""
    return p6_match(spark, d).select("ref_row_id", "paper_id")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of each long methods text."""
    return split_long(_papers(spark, d, "methods_text"), "paper_id", "methods_text").drop("piece")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Papers whose methods text is split, and whether a cut had to be forced."""
    return split_long(_papers(spark, d, "methods_text"), "paper_id", "methods_text").filter("piece_no = 0").select("paper_id", "cut_kind")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(read_table(spark, d, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Length and hash of every text decoded from its ids; null and empty texts decode to ''."""
    x = decode_corpus(p8_ids(spark, d), "doc_id", "ids")
    return x.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mixture and how often each is used."""
    return mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return shares(p9_mix(spark, d), read_table(spark, d, "mix_targets"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a wrongly decoded passage: restored text (as hash), chains used, and whether some is lost."""
    g = find_garbled(read_table(spark, d, "documents").select("doc_id", "text"))
    return g.select("doc_id", F.md5("restored").alias("restored_md5"), F.array_join("chains", "; ").alias("chains"), "lossy")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least one passage decoded with the wrong encoding."""
    return find_garbled(read_table(spark, d, "documents").select("doc_id", "text")).select("doc_id")


P7_SQL = r"""
SELECT DISTINCT paper_id, CASE WHEN list_max(list_transform(regexp_split_to_array(methods_text, '[\s\x{a0}\x{2000}-\x{200a}\x{3000}.!?。！？｡．।]+'), lambda x: length(x))) > 4000 THEN 'forced' ELSE 'natural' END AS cut_kind
FROM papers WHERE length(methods_text) > 4000
"""
P8_SQL = "SELECT doc_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents"


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p3_found": p3_found, "p4_tokens": p4_tokens, "p5_found": p5_found, "p6_found": p6_found, "p6_match": p6_match, "p7_found": p7_found, "p7_pieces": p7_pieces, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_restored": p10_restored}


def oracle_sql() -> dict[str, str]:
    return {"p7_found": P7_SQL, "p8_round_trip": P8_SQL}
