"""Tokens per source, language and domain under a public tokenizer.

Counts are exact for whole texts. Documents beyond ``limit`` code points are cut only where the
tokenizer's split pattern must start a new piece whatever stands around: between a
non-space and a space character, between a letter and a digit, and between a letter or digit
and a symbol. No alternative of the pattern spans such a place, and none looks behind, so the
counts of the parts add up to the count of the whole. Parts are spread over workers by
(document, part), so that one huge document or a source of huge documents makes no long task.

Nulls, empty and blank texts: counted as documents with their exact tokens (none for null and
empty). Repeated rows count once. A missing source is 'unknown', a missing domain 'unknown'.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.bpe import transducer
from evigraph.llm.langid import detect

PART = 20_000
_BOUNDARY = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])")


def parts(text: str, limit: int = PART) -> list[str]:
    """Cut at the first proven boundary at or after each ``limit`` code points."""
    out, at = [], 0
    while len(text) - at > limit:
        m = _BOUNDARY.search(text, at + limit)
        if m is None or m.start() >= len(text):
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def canonical_source(c: Column) -> Column:
    """One name per source: lower case, trimmed, blanks and hyphens as underscores."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_")
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("unknown"))


def document_tokens(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), lang_col: str | None = None, limit: int = PART, vocabulary: str | None = None) -> DataFrame:
    """(id, keep..., [lang], n_tokens) with one row per row of ``df``; ids must be unique.

    With ``lang_col`` the language is read from the whole text, helped by that column.
    """
    schema = df.schema
    extra = [c for c in keep if c != lang_col]
    cols = [id_col, *extra]
    head = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in cols) + (", lang string" if lang_col else "")

    def langs(batch: pa.RecordBatch, texts: list) -> list[pa.Array]:
        return [pa.array([detect(t, s) for t, s in zip(texts, batch.column(batch.num_columns - 1).to_pylist())], pa.string())] if lang_col else []

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for b in batches:
            texts = b.column(len(cols)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], *langs(b, texts), pa.array([t.count(x) for x in texts], pa.int64())], names=[*cols, *(["lang"] if lang_col else []), "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                one = b.slice(row, 1)
                texts = one.column(len(cols)).to_pylist()
                cuts = parts(texts[0], limit)
                at = pa.array([0] * len(cuts))
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in one.columns[: len(cols)]], *[a.take(at) for a in langs(one, texts)], pa.array(range(len(cuts)), pa.int32()), pa.array(cuts, pa.string())], names=[*cols, *(["lang"] if lang_col else []), "part_no", "part"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array([t.count(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.int64())], names=[*b.schema.names[:-2], "n_tokens"])

    slim = df.select(*cols, F.col(text_col).alias("_text"), *([F.col(lang_col).alias("_stated")] if lang_col else []))
    big = F.coalesce(F.length("_text"), F.lit(0)) > limit
    out = slim.filter(~big).mapInArrow(small, f"{head}, n_tokens long")
    spread = slim.filter(big).mapInArrow(cut, f"{head}, part_no int, part string").repartition(F.col(id_col), F.col("part_no"))
    keys = [*cols, *(["lang"] if lang_col else [])]
    summed = spread.mapInArrow(count, f"{head}, n_tokens long").groupBy(*keys).agg(F.sum("n_tokens").alias("n_tokens"))
    return out.unionByName(summed)


def roll_up(counted: DataFrame, *slices: str) -> DataFrame:
    """Documents and tokens of each slice; hot slices are combined before the shuffle."""
    return counted.groupBy(*slices).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.when(F.col("n_tokens") > 0, 1).otherwise(0)).alias("n_usable_docs"),
        F.sum("n_tokens").alias("n_tokens"),
    )
