"""Context windows around retrieved sentences, and the decision on a passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.operators.claims import cited_refs, specificity


def window_ids(anchors: Column, radius: int = 2) -> Column:
    """Sentence ids around the densest anchors, ascending, not yet clipped to existing ones.

    Anchors in rank order; the centre is the first that has most anchors within twice the radius.
    """
    a = F.array_distinct(anchors)
    near = F.transform(a, lambda c: F.size(F.filter(a, lambda o: F.abs(c - o) <= radius * 2)))
    centre = F.element_at(a, F.array_position(near, F.array_max(near)).cast("int"))
    kept = F.filter(a, lambda x: F.abs(x - centre) <= radius * 2)
    spread = F.array_sort(F.array_distinct(F.flatten(F.transform(kept, lambda x: F.sequence(x - radius, x + radius)))))
    return F.when(F.size(a) > 0, spread).otherwise(F.array().cast("array<int>"))


def passages(anchors: DataFrame, key: list[str], sentences: DataFrame, radius: int = 2, paper_col: str = "paper_id") -> DataFrame:
    """(key, paper, sentence_ids, passage): window text as '[id] sentence' lines; the band join is an equi-join on ids."""
    w = anchors.select(*key, paper_col, F.explode(window_ids(F.col("anchors"), radius)).alias("sentence_id"))
    j = w.join(sentences.select(paper_col, "sentence_id", "text"), [paper_col, "sentence_id"])
    g = j.groupBy(*key, paper_col).agg(F.array_sort(F.collect_list(F.struct("sentence_id", "text"))).alias("_s"))
    return g.select(*key, paper_col, F.col("_s.sentence_id").alias("sentence_ids"), F.array_join(F.transform("_s", lambda x: F.concat(F.lit("["), x["sentence_id"].cast("string"), F.lit("] "), x["text"])), "\n").alias("passage"))


def decide(passage: Column, strip_stamps: bool = False) -> Column:
    """struct<full, shortcut, refs> of a passage under the rules.

    The stamps of a passage look like numeric references; they are read as such unless ``strip_stamps``.
    """
    p = F.regexp_replace(passage, r"(?m)^\[[0-9]+\] ", "") if strip_stamps else passage
    kind = specificity(p)
    return F.struct(((kind == "fully_described") & (F.length(p) > 60)).alias("full"), (kind == "shortcut_citation").alias("shortcut"), cited_refs(p).alias("refs"))
