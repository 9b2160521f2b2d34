"""Nested protocol records -> related flat tables.

The payload is JSON of several writer versions: names in snake or camel case, a byte-order
mark, the document encoded once more as a JSON string, wrappers around it,
``sections`` as a map, as a list of ``{section, claims}`` or null, a claim list written as one
object, and a chain written as a list, as ``{"steps": [...]}``, as one step, as a linked list
through ``next_step`` or as a JSON string of any of these.

Everything is a projection with higher-order functions: nested ``transform`` calls attach the
ancestors' keys and indices, ``flatten`` joins the arrays, and one ``inline`` per target table
emits the rows. There is no shuffle but the removal of repeated records, which moves only
(record id, time, payload). All folds are bounded by counts taken from the text itself, so no
depth is cut.

Results for odd input: a null, blank or incomplete payload gives no rows; a claim or gap
without an id has ``claim_id`` ''; a step without a source has ``source_paper_id`` ''; sentence
ids that are not whole numbers are dropped; repeated rows count once; ``{}`` gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.sources.tables import latest_rows

_UNQUOTE = "struct<v:string,_bad:string>"
_CLAIM = (
    "struct<claim_id:string,claimId:string,paper_id:string,paperId:string,type:string,raw_text:string,"
    "rawText:string,specificity:string,resolution_status:string,resolutionStatus:string,reason:string,"
    "confidence:double,resolution_chain:string,resolutionChain:string,chain_trace:string,chainTrace:string>"
)
_STEP = "struct<depth:int,source_paper_id:string,sourcePaperId:string,sentence_ids:string,sentenceIds:string,extracted_text:string,extractedText:string>"
_OPT = {"columnNameOfCorruptRecord": "_bad"}


def _value(json: Column) -> Column:
    """A JSON value as text: a string loses its quoting, anything else stays JSON; null if malformed."""
    x = F.from_json(F.concat(F.lit('{"v":'), json, F.lit("}")), _UNQUOTE, _OPT)
    return F.when(x["_bad"].isNull(), x["v"])


def _items(json: Column) -> Column:
    """A list as its elements' JSON, an object as one element, anything else as none."""
    t = F.ltrim(json)
    return (
        F.when(t.startswith("["), F.from_json(t, "array<string>"))
        .when(t.startswith("{"), F.array(t))
        .otherwise(F.array().cast("array<string>"))
    )


def _unquoted(json: Column) -> Column:
    """Undo repeated encoding as a JSON string; k encodings need at least 2^(k-1)-1 backslashes."""
    slashes = F.length(json) - F.length(F.replace(json, F.lit("\\"), F.lit("")))
    times = F.lit(1) + F.floor(F.log2(F.lit(1) + slashes)).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), F.coalesce(times, F.lit(1))),
        F.trim(json),
        lambda s, i: F.when(s.startswith('"'), F.trim(_value(s))).otherwise(s),
    )


def _unwrapped(doc: Column) -> Column:
    """Descend through wrappers to the object that has sections or gaps; at most as many as open before the first of these names."""
    lead = F.regexp_extract(doc, r'(?s)^(.*?)"(?:sections|gaps)"\s*:', 1)
    n = F.length(lead) - F.length(F.replace(lead, F.lit("{"), F.lit("")))

    def down(s: Column, i: Column) -> Column:
        m = F.from_json(s, "map<string,string>")
        known = F.map_contains_key(m, "sections") | F.map_contains_key(m, "gaps")
        inner = F.try_element_at(F.filter(F.map_values(m), lambda v: F.ltrim(v).startswith("{") & v.rlike(r'"(?:sections|gaps)"\s*:')), F.lit(1))
        return F.when(~known & inner.isNotNull(), inner).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce(n, F.lit(1)))), doc, down)


def _linked(step: Column) -> Column:
    """A step and those that hang on it through next_step, in order."""
    n = sum(((F.length(step) - F.length(F.replace(step, F.lit(k), F.lit("")))) / len(k)).cast("int") for k in ("next_step", "nextStep"))

    def follow(st: Column, i: Column) -> Column:
        nxt = F.coalesce(F.get_json_object(st["cur"], "$.next_step"), F.get_json_object(st["cur"], "$.nextStep"))
        return F.when(st["cur"].isNull(), st).otherwise(
            F.struct(F.when(F.ltrim(nxt).startswith("{"), nxt).alias("cur"), F.concat(st["acc"], F.array(st["cur"])).alias("acc"))
        )

    return F.aggregate(
        F.sequence(F.lit(1), n + 1),
        F.struct(step.alias("cur"), F.array().cast("array<string>").alias("acc")),
        follow,
        lambda st: st["acc"],
    )


def _steps(chain: Column) -> Column:
    """Any form of a chain as an array of (source_paper_id, sentence_ids, depth, extracted_text)."""
    c = _unquoted(chain)
    raw = F.when(F.ltrim(c).startswith("{") & F.get_json_object(c, "$.steps").isNotNull(), _items(F.get_json_object(c, "$.steps"))).otherwise(_items(c))
    each = F.filter(F.flatten(F.transform(F.coalesce(raw, F.array().cast("array<string>")), _linked)), lambda s: F.ltrim(s).startswith("{"))

    def parse(s: Column) -> Column:
        x = F.from_json(s, _STEP)
        ids = F.ltrim(F.coalesce(x["sentence_ids"], x["sentenceIds"]))
        many = F.when(ids.startswith("["), F.from_json(ids, "array<string>")).when(ids.isNotNull(), F.array(ids))
        return F.struct(
            F.coalesce(x["source_paper_id"], x["sourcePaperId"], F.lit("")).alias("source_paper_id"),
            F.coalesce(F.filter(F.transform(many, lambda v: v.try_cast("int")), lambda v: v.isNotNull()), F.array().cast("array<int>")).alias("sentence_ids"),
            x["depth"].alias("depth"),
            F.coalesce(x["extracted_text"], x["extractedText"]).alias("extracted_text"),
        )

    return F.transform(each, parse)


def _holder(kind: str, section: Column, no: Column, json: Column, *chains: str) -> Column:
    c = F.from_json(json, _CLAIM)
    return F.struct(
        F.lit(kind).alias("holder"),
        section.alias("section"),
        no.alias("holder_no"),
        F.coalesce(c["claim_id"], c["claimId"], F.lit("")).alias("claim_id"),
        c["type"].alias("type"),
        c["specificity"].alias("specificity"),
        F.coalesce(c["resolution_status"], c["resolutionStatus"]).alias("resolution_status"),
        c["reason"].alias("reason"),
        c["confidence"].alias("confidence"),
        F.coalesce(c["raw_text"], c["rawText"]).alias("raw_text"),
        _steps(F.coalesce(*[c[k] for k in chains])).alias("steps"),
    )


def nest_holders(records: DataFrame) -> DataFrame:
    """(record_id, paper_id, holders): claims and gaps of each readable payload with their steps."""
    r = latest_rows(records.select("record_id", "paper_id", "received_at", "payload"), "record_id", "received_at", "payload")
    text = F.regexp_replace(F.col("payload"), "^﻿", "")
    r = r.select("record_id", "paper_id", _unquoted(text).alias("_t"))
    r = r.filter(F.col("_t") != "").withColumn("_docs", F.filter(F.transform(_items(_value(F.col("_t"))), _unwrapped), lambda d: d.isNotNull()))
    r = r.select("record_id", "paper_id", F.posexplode("_docs").alias("doc_no", "_d"))
    r = r.select("record_id", "paper_id", "doc_no", F.get_json_object("_d", "$.sections").alias("_s"), F.get_json_object("_d", "$.gaps").alias("_g"))

    s = F.ltrim(F.col("_s"))
    by_name = F.transform(
        F.map_entries(F.from_json(s, "map<string,string>")),
        lambda e: F.struct(e["key"].alias("section"), e["value"].alias("claims")),
    )
    listed = F.transform(F.from_json(s, "array<struct<section:string,name:string,claims:string>>"), lambda e: F.struct(F.coalesce(e["section"], e["name"]).alias("section"), e["claims"].alias("claims")))
    sections = F.when(s.startswith("{"), by_name).when(s.startswith("["), listed).otherwise(F.array().cast("array<struct<section:string,claims:string>>"))
    r = r.withColumn("_sections", sections)
    claims = F.flatten(
        F.transform(
            F.col("_sections"),
            lambda e: F.transform(
                F.filter(F.coalesce(_items(e["claims"]), F.array().cast("array<string>")), lambda c: F.ltrim(c).startswith("{")),
                lambda c, i: _holder("claim", e["section"], i, c, "resolution_chain", "resolutionChain"),
            ),
        )
    )
    gaps = F.transform(
        F.filter(F.coalesce(_items(F.col("_g")), F.array().cast("array<string>")), lambda c: F.ltrim(c).startswith("{")),
        lambda c, i: _holder("gap", F.lit(None).cast("string"), i, c, "chain_trace", "chainTrace"),
    )
    return r.select("record_id", "paper_id", "doc_no", F.concat(claims, gaps).alias("holders"))


def holder_rows(nested: DataFrame) -> DataFrame:
    """One row per claim or gap, keyed by (record_id, doc_no, holder, section, holder_no)."""
    keyed = F.transform(
        "holders",
        lambda h: F.struct(*[h[c].alias(c) for c in ("holder", "section", "holder_no", "claim_id", "type", "specificity", "resolution_status", "reason", "confidence", "raw_text")], F.size(h["steps"]).alias("n_steps")),
    )
    return nested.select("record_id", "paper_id", "doc_no", F.inline(keyed))


def step_rows(nested: DataFrame) -> DataFrame:
    """One row per chain step with its claim's or gap's keys."""
    keyed = F.flatten(
        F.transform(
            "holders",
            lambda h: F.transform(
                h["steps"],
                lambda s, i: F.struct(h["holder"].alias("holder"), h["section"].alias("section"), h["holder_no"].alias("holder_no"), h["claim_id"].alias("claim_id"), i.alias("step_no"), s["depth"].alias("depth"), s["source_paper_id"].alias("source_paper_id"), F.size(s["sentence_ids"]).alias("n_sentences"), s["extracted_text"].alias("extracted_text")),
            ),
        )
    )
    return nested.select("record_id", "doc_no", F.inline(keyed))


def sentence_links(nested: DataFrame) -> DataFrame:
    """record -> claim or gap -> step -> sentence; -1 and '' stand for a missing level."""

    def row(h: Column, no: Column, src: Column, sid: Column) -> Column:
        return F.struct(h["holder"].alias("holder"), h["claim_id"].alias("claim_id"), no.cast("int").alias("step_no"), src.alias("source_paper_id"), sid.cast("int").alias("sentence_id"))

    def of(h: Column) -> Column:
        links = F.flatten(
            F.transform(
                h["steps"],
                lambda s, i: F.transform(F.when(F.size(s["sentence_ids"]) > 0, s["sentence_ids"]).otherwise(F.array(F.lit(-1))), lambda sid: row(h, i, s["source_paper_id"], sid)),
            )
        )
        return F.when(F.size(h["steps"]) > 0, links).otherwise(F.array(row(h, F.lit(-1), F.lit(""), F.lit(-1))))

    return nested.select("record_id", F.inline(F.array_distinct(F.flatten(F.transform("holders", of)))))
