"""Sentences to typed claims by ordered rules.

A null or blank methods text has no sentences and no claims; ``papers_without_claims`` reports such
papers. Repeated papers must be removed before (``latest_rows``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import ids, text
from evigraph.functions.lexicon import DEFAULT, Lexicon

VERSION = "rules-1"
LARGE_PAPER = 40


def _any(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _hints(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-").replace("\\<", "<").replace("\\=", "=") for w in words)


def specificity(s: Column, lex: Lexicon = DEFAULT) -> Column:
    return F.when(s.rlike(f"(?i){_any(lex.shortcut)}"), "shortcut_citation").when(s.rlike(f"(?i){_any(lex.standard)}"), "standard_unspecified").when(F.lower(s).rlike(_hints(lex.partial)), "partially_described").otherwise("fully_described")


def cited_refs(s: Column, lex: Lexicon = DEFAULT) -> Column:
    """Bracketed reference ids, case and order kept, repetitions kept."""
    return F.regexp_extract_all(s, F.lit(f"(?i){lex.ref_id}"), F.lit(1))


def claim_type(s: Column, lex: Lexicon = DEFAULT) -> Column:
    low = F.lower(s)
    out = None
    for kind, words in lex.types:
        test = low.rlike(_hints(words))
        if kind == "reagent":
            test = test | low.rlike(lex.concentration)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("procedure")


def sentence_rows(papers: DataFrame, id_col: str = "paper_id", text_col: str = "methods_text") -> DataFrame:
    """(id, sentence_id, text): numbered rule sentences."""
    return papers.select(id_col, F.posexplode(text.sentences(F.col(text_col))).alias("sentence_id", "text"))


def rule_claims(sents: DataFrame, id_col: str = "paper_id", lex: Lexicon = DEFAULT) -> DataFrame:
    """One claim per sentence with three words or more."""
    t = F.col("text")
    kept = sents.filter((t != "") & (F.size(F.regexp_extract_all(t, F.lit("[A-Za-z]+"), F.lit(0))) >= 3))
    c = kept.select(id_col, "sentence_id", "text", claim_type(t, lex).alias("type"), specificity(t, lex).alias("specificity"), cited_refs(t, lex).alias("cited_ref_ids"))
    full = F.col("specificity") == "fully_described"
    return c.select(
        ids.claim_id(F.col(id_col), F.col("sentence_id"), F.col("type"), t).alias("claim_id"),
        id_col,
        F.col("sentence_id").alias("raw_sentence_id"),
        t.alias("raw_text"),
        "type",
        "specificity",
        "cited_ref_ids",
        F.when(full, "resolved").otherwise("unresolved").alias("resolution_status"),
        F.when(full, t).alias("resolved_text"),
        F.lit(VERSION).alias("extraction_version"),
    )


def extraction_mode(sents: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """(id, n_sentences, mode): large papers go by the rules alone."""
    return sents.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_sentences")).withColumn("mode", F.when(F.col("n_sentences") >= LARGE_PAPER, "rules_large_paper").otherwise("hybrid"))


def papers_without_claims(papers: DataFrame, claims: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """Rejects: papers with or without text that yielded no claim, and why."""
    r = papers.join(claims.select(id_col).distinct(), id_col, "left_anti")
    return r.select(id_col, F.when(text.strip(F.coalesce(F.col("methods_text"), F.lit(""))) == "", "no_methods").otherwise("no_claims").alias("reason"))


def provenance(extracted: DataFrame, sents: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """Extracted claims (id, raw_sentence_id, raw_text) whose normal form stands in the sentence they name."""
    s = sents.select(F.col(id_col), F.col("sentence_id").alias("raw_sentence_id"), F.col("text").alias("_source"))
    j = extracted.join(s, [id_col, "raw_sentence_id"])
    return j.filter(F.contains(text.normalize(F.col("_source")), text.normalize(F.col("raw_text"))) & (text.normalize(F.col("raw_text")) != "")).drop("_source")


def extract_with(chunks: DataFrame, classify, schema: str, fallback) -> DataFrame:
    """Pluggable classifier over text chunks: a chunk whose call fails is handled by ``fallback``.

    ``classify`` and ``fallback`` take and give a pandas DataFrame; batches go through Arrow.
    """

    def run(frames):
        for frame in frames:
            try:
                yield classify(frame)
            except Exception:  # a failing model must not fail the job
                yield fallback(frame)

    return chunks.mapInPandas(run, schema)


def first_by_id(claims: DataFrame, *order: str) -> DataFrame:
    """Repeated claim ids: the first in order stays."""
    w = Window.partitionBy("claim_id").orderBy(*order)
    return claims.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def valid_cached_sets(claims: DataFrame, version: str, hashes: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """Papers whose stored claims may be reused: all rows of the right version and text hash, none unresolved."""
    j = claims.join(hashes.select(id_col, F.col("methods_hash").alias("_h")), id_col)
    ok = (F.col("extraction_version") == version) & (F.col("source_methods_hash") == F.col("_h")) & (F.col("resolution_status") != "unresolved")
    return j.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_claims"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("_ok")).filter("_ok").select(id_col, "n_claims")
