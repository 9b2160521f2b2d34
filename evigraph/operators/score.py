"""Evidence coverage, assembly into sections, gaps and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.lexicon import ACTION_DEFAULT, ACTION_OF_GAP, SECTION_OF_TYPE, SECTION_ORDER


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def section_of(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(SECTION_OF_TYPE), kind), F.lit("procedure"))


def suggested_action(reason: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(ACTION_OF_GAP), reason), F.lit(ACTION_DEFAULT))


def evidence(specificity: Column, status: Column, chain: Column | None = None) -> Column:
    """1 if the claim is described, or resolved with a step that names sentences; inferred claims count 0."""
    if chain is None:
        return F.when(specificity == "fully_described", 1).otherwise(0)
    backed = (status == "resolved") & F.exists(F.coalesce(chain, F.array().cast("array<struct<depth:int,source_paper_id:string,sentence_ids:array<int>,extracted_text:string>>")), lambda s: F.size(s["sentence_ids"]) > 0)
    return F.when((specificity == "fully_described") | backed, 1).otherwise(0)


def coverage(claims: DataFrame, *group: str) -> DataFrame:
    """Claims, backed claims and coverage (0..100) per group and type, with the total of each group as type null.

    Counts are whole numbers until the last step, so that results are exact.
    """
    g = claims.rollup(*group, "type").agg(F.count(F.lit(1)).alias("n_claims"), F.sum("backed").alias("n_backed"), F.grouping_id().alias("_g"))
    return g.filter(F.col("_g") <= 1).drop("_g").withColumn("coverage", F.round(100 * F.col("n_backed") / F.col("n_claims"), 6))


def weighted_coverage(claims: DataFrame, weights: DataFrame, *group: str) -> DataFrame:
    """Coverage with a weight per type; types without a weight count 1."""
    j = claims.join(F.broadcast(weights), "type", "left").withColumn("w", F.coalesce("weight", F.lit(1.0)))  # one row per type of a fixed list
    return j.groupBy(*group).agg(F.round(100 * F.sum(F.col("w") * F.col("backed")) / F.sum("w"), 6).alias("weighted"))


def assemble(claims: DataFrame, proposed: DataFrame | None = None, id_col: str = "paper_id") -> DataFrame:
    """(paper, section, pos, claim_id): proposed section items first (first assignment wins, unknown or gap claims dropped), the rest by type in claim order."""
    ok = claims.filter("resolution_status <> 'terminal_gap'")
    base = ok.select(id_col, "claim_id", section_of(F.col("type")).alias("section"), F.lit(1).alias("arm"), F.lit(0).alias("s_no"), F.col("raw_sentence_id").alias("i_no"))
    if proposed is not None:
        p = proposed.join(ok.select(id_col, "claim_id"), [id_col, "claim_id"], "left_semi")
        w = Window.partitionBy("claim_id").orderBy("s_no", "i_no")
        p = p.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(id_col, "claim_id", "section", F.lit(0).alias("arm"), "s_no", "i_no")
        base = p.unionByName(base.join(p.select("claim_id"), "claim_id", "left_anti"))
    w = Window.partitionBy(id_col, "section").orderBy("arm", "s_no", "i_no", "claim_id")
    return base.select(id_col, "section", (F.row_number().over(w) - 1).alias("pos"), "claim_id")


def section_rank(section: Column) -> Column:
    """Order of sections: the fixed list, then others."""
    at = F.array_position(F.array(*[F.lit(s) for s in SECTION_ORDER]), section)
    return F.when(at > 0, at).otherwise(F.lit(len(SECTION_ORDER) + 1))


def gaps(claims: DataFrame) -> DataFrame:
    """Gap rows with reason and next step."""
    r = F.coalesce("terminal_gap_reason", F.lit("parsing_failed"))
    return claims.filter("resolution_status = 'terminal_gap'").select("paper_id", "claim_id", "raw_text", "type", "specificity", r.alias("reason"), suggested_action(r).alias("suggested_action"))


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 25) -> DataFrame:
    """A page after a total order; offset at least 0, limit 1 to 25."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(25, max(1, limit)))


def source_usage(steps: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """(record_id, source_paper_id, n_sentences, sentence_ids): sentences each source gives, the record's own paper always listed."""
    g = steps.filter("source_paper_id <> ''").groupBy("record_id", "source_paper_id").agg(F.array_sort(F.collect_set(F.when(F.col("sentence_id") >= 0, F.col("sentence_id")))).alias("sentence_ids"))
    if papers is not None:
        own = papers.filter("paper_id is not null").select("record_id", F.col("paper_id").alias("source_paper_id"), F.array().cast("array<int>").alias("sentence_ids"))
        g = g.unionByName(own.join(g, ["record_id", "source_paper_id"], "left_anti"))
    return g.select("record_id", "source_paper_id", F.size("sentence_ids").alias("n_sentences"), "sentence_ids")


def markdown(claims: DataFrame) -> DataFrame:
    """(paper_id, section, body): the section as Markdown lines in claim order."""
    text = F.coalesce(F.nullif("resolved_text", F.lit("")), "raw_text")
    src = F.try_element_at("resolution_chain", F.lit(-1))["source_paper_id"]
    line = F.concat(F.lit("- "), text, F.when(F.col("resolution_status") == "inferred", "\n  - *Corpus inference; not evidence-backed.*").otherwise(""), F.when(F.size("resolution_chain") > 0, F.concat(F.lit("\n  - *Source: "), F.coalesce(src, F.lit("?")), F.lit("*"))).otherwise(""))
    r = claims.filter("resolution_status <> 'terminal_gap'").select("paper_id", section_of(F.col("type")).alias("section"), "raw_sentence_id", "claim_id", line.alias("line"))
    g = r.groupBy("paper_id", "section").agg(F.array_sort(F.collect_list(F.struct("raw_sentence_id", "claim_id", "line"))).alias("l"))
    head = F.initcap(F.replace("section", F.lit("_"), F.lit(" ")))
    return g.select("paper_id", "section", F.concat(F.lit("## "), head, F.lit("\n\n"), F.array_join("l.line", "\n")).alias("body"))


def gap_csv(rows: DataFrame) -> DataFrame:
    """(paper_id, line): RFC 4180 lines of claim id, reason, text and action."""
    cell = lambda c: F.when(F.col(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    return rows.select("paper_id", F.concat_ws(",", *[cell(c) for c in ("claim_id", "reason", "raw_text", "suggested_action")]).alias("line"))


def training_examples(claims: DataFrame) -> DataFrame:
    """Source-backed claims as (paper_id, sentence_id, text, type, specificity, resolved_text, n_evidence)."""
    ev = F.filter("resolution_chain", lambda s: (F.coalesce(s["source_paper_id"], F.lit("")) != "") & (F.size(s["sentence_ids"]) > 0))
    backed = (F.col("resolution_status") == "resolved") & F.when(F.col("specificity") == "fully_described", F.coalesce("raw_text", F.lit("")) != "").otherwise(F.size(ev) > 0)
    return claims.filter(backed).select("paper_id", F.col("raw_sentence_id").alias("sentence_id"), F.col("raw_text").alias("text"), "type", "specificity", F.coalesce(F.nullif("resolved_text", F.lit("")), "raw_text").alias("resolved_text"), F.size(ev).alias("n_evidence"))


def print_numbers(usage: DataFrame) -> DataFrame:
    """Numbers of sources in print order: the own paper first, then by id."""
    w = Window.partitionBy("record_id").orderBy(F.col("is_own").desc(), "source_paper_id")
    return usage.withColumn("number", F.dense_rank().over(w))
