"""Repeat-run analytics: variability between runs, pathway and stage summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import ids, text


def counts_by(df: DataFrame, group: str, what: str) -> DataFrame:
    """(group, what, n)."""
    return df.groupBy(group, F.coalesce(what, F.lit("unknown")).alias(what)).agg(F.count(F.lit(1)).alias("n"))


def modes(df: DataFrame, group: str, mode: str) -> DataFrame:
    """Distinct modes of a group in order, comma-joined; blank ones as 'unknown'."""
    m = F.coalesce(F.nullif(F.trim(mode), F.lit("")), F.lit("unknown"))
    return df.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(m)), ",").alias("modes"))


def run_pairs(runs: DataFrame, group: str = "paper_id") -> DataFrame:
    """(group, left_run, right_run, jaccard, agreement) of every two runs of a group.

    ``runs``: group, run, raw_text, type, specificity, resolution_status. Runs meet on signatures and
    on texts, never row by row: each signature carries the set of runs that have it (runs are few), and
    pairs come from run numbers only. Two empty runs agree fully; two without a common text not at all.
    """
    have = runs.select(group, "run").distinct()
    sig = runs.select(group, "run", ids.signature(F.col("raw_text"), F.col("type"), F.col("specificity"), F.col("resolution_status")).alias("sig")).distinct()
    size = sig.groupBy(group, "run").agg(F.count(F.lit(1)).alias("n"))
    both = lambda t, on: t.alias("l").join(t.alias("r"), on).filter("l.run < r.run")
    same = both(sig, [group, "sig"]).groupBy(group, F.col("l.run").alias("left_run"), F.col("r.run").alias("right_run")).agg(F.count(F.lit(1)).alias("shared"))
    named = runs.filter(F.coalesce("raw_text", F.lit("")) != "").select(group, "run", text.normalize(F.col("raw_text")).alias("t"), F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("type", "specificity", "resolution_status")]).alias("label"), F.col("pos"))
    last = named.groupBy(group, "run", "t").agg(F.max_by("label", "pos").alias("label"))
    agree = both(last, [group, "t"]).groupBy(group, F.col("l.run").alias("left_run"), F.col("r.run").alias("right_run")).agg(F.avg((F.col("l.label") == F.col("r.label")).cast("double")).alias("agreement"))
    pairs = have.alias("l").join(have.alias("r"), group).filter("l.run < r.run").select(group, F.col("l.run").alias("left_run"), F.col("r.run").alias("right_run"))
    j = pairs.join(same, [group, "left_run", "right_run"], "left").join(agree, [group, "left_run", "right_run"], "left")
    j = j.join(size.select(group, F.col("run").alias("left_run"), F.col("n").alias("nl")), [group, "left_run"], "left").join(size.select(group, F.col("run").alias("right_run"), F.col("n").alias("nr")), [group, "right_run"], "left")
    nl, nr, sh = (F.coalesce(c, F.lit(0)) for c in ("nl", "nr", "shared"))
    union = nl + nr - sh
    return j.select(group, "left_run", "right_run", F.round(F.when(union == 0, 1.0).otherwise(sh / union), 6).alias("jaccard"), F.round(F.coalesce("agreement", F.when((nl == 0) & (nr == 0), 1.0).otherwise(0.0)), 6).alias("agreement"))


def stats(value: Column) -> list[Column]:
    """Mean, least, most and coefficient of variation (0 for one value or a mean of 0)."""
    cv = F.when((F.count(value) > 1) & (F.avg(value) != 0), F.stddev_pop(value) / F.avg(value)).otherwise(0.0)
    return [F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(cv, 6).alias("cv")]


def variability(runs: DataFrame, group: str = "paper_id") -> DataFrame:
    """Per group: number of runs, claim counts, their variation, and pairwise Jaccard and agreement."""
    n = runs.groupBy(group, "run").agg(F.count(F.lit(1)).alias("n"))
    c = n.groupBy(group).agg(F.count(F.lit(1)).alias("n_runs"), *stats(F.col("n")))
    p = run_pairs(runs, group).groupBy(group).agg(F.round(F.avg("jaccard"), 6).alias("jaccard_mean"), F.min("jaccard").alias("jaccard_min"), F.round(F.avg("agreement"), 6).alias("agreement_mean"), F.min("agreement").alias("agreement_min"))
    return c.join(p, group, "left").na.fill(1.0, ["jaccard_mean", "jaccard_min", "agreement_mean", "agreement_min"])


def pathway(holders: DataFrame, steps: DataFrame) -> DataFrame:
    """Per record: claims, gaps, chains and their depth, distinct sources (from flat protocol tables)."""
    h = holders.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("holder") == "gap").alias("n_gaps"),
        F.count_if(F.col("n_steps") > 0).alias("n_chains"),
        F.count_if((F.col("n_steps") > 0) & (F.col("holder") == "gap")).alias("n_failed_chains"),
        F.round(F.avg(F.when(F.col("n_steps") > 0, F.col("n_steps"))), 6).alias("chain_depth_mean"),
        F.max(F.when(F.col("n_steps") > 0, F.col("n_steps"))).alias("chain_depth_max"),
    )
    s = steps.filter("source_paper_id <> ''").groupBy("record_id").agg(F.count_distinct("source_paper_id").alias("n_sources"))
    return h.join(s, "record_id", "left").na.fill(0, ["n_sources"])


def stage_summary(trials: DataFrame, within_ms: float) -> DataFrame:
    """Per paper and stage: trials, time statistics, whether all lie within the target."""
    return trials.groupBy("paper", "stage").agg(F.count(F.lit(1)).alias("n"), *stats(F.col("ms")), F.bool_and(F.coalesce(F.col("ms") <= within_ms, F.lit(False))).alias("all_within"))


def suite(trials: DataFrame, within_ms: float) -> DataFrame:
    """Totals of a suite of trials (paper, status, ms)."""
    per = trials.groupBy("paper").agg(F.bool_and(F.coalesce(F.col("ms") <= within_ms, F.lit(False))).alias("ok"), F.count_distinct("status").alias("kinds"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("failed"))
    return per.agg(F.count(F.lit(1)).alias("n_papers"), F.sum("n").alias("n_trials"), F.sum("failed").alias("n_failed"), F.count_if("ok").alias("n_within"), F.count_if(F.col("kinds") == 1).alias("n_stable"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("rate_within"))
