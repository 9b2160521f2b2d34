"""Citation edges: references to papers, with the order of sources and the reason of a failure.

Nulls and empty identifiers are missing. Of repeated reference ids within a paper the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import ids, text
from evigraph.operators import retrieve


def reference_table(refs: DataFrame) -> DataFrame:
    """References with their normal key, one per (paper, key): the last position wins."""
    r = refs.withColumn("ref_key", ids.ref_key(F.col("ref_id"))).filter(F.col("ref_key") != "")
    w = Window.partitionBy("paper_id", "ref_key").orderBy(F.col("ref_pos").desc(), F.col("ref_row_id").desc())
    return r.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def cited_references(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """(claim_id, paper_id, cite_pos, ref_row_id): a claim's cited ids that its paper's list holds, in order."""
    c = claims.select("claim_id", "paper_id", F.posexplode("cited_ref_ids").alias("cite_pos", "_id")).withColumn("ref_key", ids.ref_key(F.col("_id"))).drop("_id")
    return c.join(reference_table(refs).select("paper_id", "ref_key", "ref_row_id"), ["paper_id", "ref_key"]).select("claim_id", "paper_id", "cite_pos", "ref_key", "ref_row_id")


def has_methods(c: Column) -> Column:
    return text.strip(F.coalesce(c, F.lit(""))) != ""


def paper_table(papers: DataFrame) -> DataFrame:
    """What ``fetch_targets`` needs of papers, without their texts."""
    return papers.select("paper_id", "title", "abstract", has_methods(F.col("methods_text")).alias("has_methods"))


def fetch_targets(refs: DataFrame, papers: DataFrame, by_citation: bool = True, packs: list[DataFrame] | None = None) -> DataFrame:
    """(ref_row_id, target, via, reason): DOI, arXiv, PMC, then the indexed citation; the first with methods wins.

    Without one: 'source_unavailable' if an identifier led to a paper without methods, else
    'reference_unresolved'. Equal fetches are made once.
    ``papers`` may be their ``paper_table``; ``packs``: ``retrieve.paper_packs`` of those with methods, if at hand.
    """
    p = papers if "has_methods" in papers.columns else paper_table(papers)
    keyed = refs.withColumn("fetch_key", ids.fetch_key(*[F.col(c) for c in ("doi", "arxiv_id", "pmc_id", "title", "raw_citation")]))
    ident = F.array(
        F.struct(F.lit(0).alias("rank"), F.concat(F.lit("doi:"), ids.parse_doi(F.col("doi"))).alias("target")),
        F.struct(F.lit(1).alias("rank"), F.concat(F.lit("arxiv:"), ids.parse_arxiv(F.col("arxiv_id"))).alias("target")),
        F.struct(F.lit(2).alias("rank"), F.concat(F.lit("pmc:"), ids.parse_pmc(F.col("pmc_id"))).alias("target")),
    )
    named = keyed.select("ref_row_id", F.inline(ident)).filter("target is not null")
    found = named.join(p.select(F.col("paper_id").alias("target"), "has_methods"), "target")
    if by_citation:
        once = keyed.groupBy("fetch_key").agg(F.min(F.struct("ref_row_id", F.coalesce(F.nullif("title", F.lit("")), "raw_citation").alias("q"))).alias("x")).select("fetch_key", "x.q").filter("q <> ''")
        best = retrieve.best_paper(p.filter("has_methods"), once, "fetch_key", "q", packs=packs).join(p.select("paper_id", "title"), "paper_id").join(once, "fetch_key")
        best = best.filter(text.title_share(F.col("q"), F.col("title")) >= 0.6).select("fetch_key", F.col("paper_id").alias("target"))
        hit = keyed.select("ref_row_id", "fetch_key").join(best, "fetch_key").select("ref_row_id", F.lit(3).alias("rank"), "target", F.lit(True).alias("has_methods"))
        found = found.select("ref_row_id", "rank", "target", "has_methods").unionByName(hit)
    g = found.groupBy("ref_row_id").agg(F.min(F.when(F.col("has_methods"), F.struct("rank", "target"))).alias("m"), F.count(F.lit(1)).alias("n"))
    via = F.when(F.col("m.rank") == 0, "doi").when(F.col("m.rank") == 1, "arxiv").when(F.col("m.rank") == 2, "pmc").when(F.col("m.rank") == 3, "citation")
    return refs.select("ref_row_id").join(g, "ref_row_id", "left").select(
        "ref_row_id", F.col("m.target").alias("target"), via.alias("via"), F.when(F.col("m").isNull(), F.when(F.coalesce("n", F.lit(0)) > 0, "source_unavailable").otherwise("reference_unresolved")).alias("reason")
    )


def enrich(papers: DataFrame, found: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """Papers without methods filled field by field from other copies; what is there stays, and so does the source."""
    cols = [c for c in papers.columns if c not in (id_col, "source")]
    j = papers.alias("l").join(found.alias("r"), id_col, "left")

    def pick(c: str) -> Column:
        if c not in found.columns:
            return F.col(f"l.{c}").alias(c)
        kind = papers.schema[c].dataType.typeName()
        left = F.nullif(F.col(f"l.{c}"), F.lit("")) if kind == "string" else F.col(f"l.{c}")
        return F.when(has_methods(F.col("l.methods_text")), F.col(f"l.{c}")).otherwise(F.coalesce(left, F.col(f"r.{c}"))).alias(c)

    return j.select(id_col, "l.source", *[pick(c) for c in cols])


def acquisition(wanted: DataFrame, stored: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """(paper_id, decision): 'hit' with methods, 'fresh_negative' within the time to live, else 'fetch'."""
    j = wanted.select("paper_id").distinct().join(stored.select("paper_id", "methods_text", "ingested_at"), "paper_id", "left")
    return j.select("paper_id", F.when(has_methods(F.col("methods_text")), "hit").when(ids.fresh(F.col("ingested_at"), now, ttl_seconds), "fresh_negative").otherwise("fetch").alias("decision"))


def reachable(edges: DataFrame, depth: int) -> DataFrame:
    """(src, dst, depth): papers reached over citation edges within ``depth`` steps, with the least number of steps."""
    from evigraph.session import checkpoint

    e = checkpoint(edges.select("src", "dst").filter("src <> dst").distinct())
    seen = frontier = e.withColumn("depth", F.lit(1))
    for k in range(2, depth + 1):
        step = frontier.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").filter("src <> dst").distinct()
        frontier = checkpoint(step.join(seen, ["src", "dst"], "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.unionByName(frontier))
    return seen
