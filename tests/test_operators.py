import json

import pytest
from pyspark.sql import functions as F

from evigraph.operators import analytics, citations, claims, context, nested, resolve, retrieve, score, store
from evigraph.sources import latest_rows, parsers
from evigraph.streaming import events as E

REFS = "ref_row_id long, paper_id string, ref_pos int, ref_id string, raw_citation string, doi string, arxiv_id string, pmc_id string, title string, pub_year int"
PAPERS = "paper_id string, title string, abstract string, methods_text string"


@pytest.fixture(scope="module")
def chain(spark):
    """Paper a cites b, b refers on to c, c describes; d has no text."""
    papers = spark.createDataFrame(
        [
            ("doi:10.1/a", "Alpha", None, "Tissue clearing was performed as described previously [ref_1]. Embryos were stained as described in [ref_9]. Wells were shaken as described previously."),
            ("doi:10.1/b", "Beta", None, "Tissue clearing was performed as described in our earlier work [ref_1]."),
            ("doi:10.1/c", "Gamma", None, "Tissue clearing used four percent formalin for sixty minutes in a cold room with gentle shaking throughout."),
            ("doi:10.1/d", "Delta", None, None),
        ],
        PAPERS,
    )
    refs = spark.createDataFrame(
        [
            (1, "doi:10.1/a", 0, "[ref_1]", "b", "10.1/b", None, None, None, None),
            (2, "doi:10.1/b", 0, "ref_1", "c", "10.1/c", None, None, None, None),
            (3, "doi:10.1/a", 1, "ref_9", "d", "10.1/d", None, None, None, None),
        ],
        REFS,
    )
    sents = claims.sentence_rows(papers)
    return papers, refs, sents, claims.rule_claims(sents)


def test_walk_commits_and_descends(spark, chain):
    papers, refs, sents, c = chain
    # the identifiers here have a short registrant; targets are joined as given
    refs = refs.withColumn("doi", F.regexp_replace("doi", "10.1/", "10.10000/"))
    fix = lambda df, col: df.withColumn(col, F.regexp_replace(col, "10.1/", "10.10000/"))
    papers, refs, sents, c = fix(papers, "paper_id"), fix(refs, "paper_id"), fix(sents, "paper_id"), fix(c, "paper_id")
    w = {r.claim_id: r for r in resolve.walk(c.filter("specificity = 'shortcut_citation'").select("claim_id", "paper_id", "raw_text", "cited_ref_ids"), refs, papers, sents, strip_stamps=True).collect()}
    by = {r.raw_sentence_id: w[r.claim_id] for r in c.filter(F.col("paper_id").endswith("/a")).collect()}
    assert by[0].status == "resolved" and [s.source_paper_id[-1] for s in by[0].chain] == ["b", "c"] and by[0].confidence == 0.75
    assert by[1].status == "terminal_gap" and by[1].reason == "source_unavailable"
    assert by[2].reason == "no_reference"


def test_walk_stops_at_depth(spark):
    papers = spark.createDataFrame([("doi:10.10000/x", "X", None, "Cells were treated as described in the same paper [ref_1].")], PAPERS)
    refs = spark.createDataFrame([(1, "doi:10.10000/x", 0, "ref_1", "x", "10.10000/x", None, None, None, None)], REFS)
    s = claims.sentence_rows(papers)
    c = claims.rule_claims(s)
    r = resolve.walk(c.select("claim_id", "paper_id", "raw_text", "cited_ref_ids"), refs, papers, s, strip_stamps=True).collect()
    assert [(x.status, x.reason, len(x.chain)) for x in r] == [("terminal_gap", "depth_exceeded", 5)]


def test_context_window(spark):
    df = spark.createDataFrame([([2, 3, 20, 21, 22],), ([],), ([7, 7],)], "a array<int>")
    out = [r.w for r in df.select(context.window_ids(F.col("a"), 1).alias("w")).collect()]
    assert out == [[19, 20, 21, 22, 23], [], [6, 7, 8]]


def test_stamps_read_as_references_unless_stripped(spark):
    df = spark.createDataFrame([("[0] as described [ref_1]",)], "p string")
    r = df.select(context.decide(F.col("p")).alias("a"), context.decide(F.col("p"), True).alias("b")).collect()[0]
    assert r.a.refs == ["0", "ref_1"] and r.b.refs == ["ref_1"] and r.a.shortcut and not r.a.full


def test_fusion_ties_keep_first_seen(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "q int, id string, rank0 int")
    b = spark.createDataFrame([(1, "y", 0), (1, "x", 1), (1, "z", 2)], "q int, id string, rank0 int")
    out = [(r.id, round(r.score, 6)) for r in retrieve.fuse([a, b], ["q"], ["id"]).orderBy("rank0").collect()]
    assert out == [("x", round(1 / 61 + 1 / 62, 6)), ("y", round(1 / 61 + 1 / 62, 6)), ("z", round(1 / 63, 6))]


def test_bm25_empty_and_null(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "rare word"), (3 + 1, "rare word")], "id int, t string")
    q = spark.createDataFrame([(9, "rare"), (10, None)], "qid int, q string")
    r = retrieve.bm25(docs, ["id"], "t", q, "qid", "q", 5).orderBy("rank0").collect()
    assert [(x.qid, x.id) for x in r] == [(9, 3), (9, 4)] and r[0].score == r[1].score
    assert retrieve.bm25(docs.limit(0), ["id"], "t", q, "qid", "q", 5).count() == 0


def test_hash_vectors_have_unit_length(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id int, t string")
    v = {r.id: r.vector for r in retrieve.hash_vectors(df, "id", "t").collect()}
    assert len(v[1]) == 384 and abs(sum(x * x for x in v[1]) - 1) < 1e-5 and v[1] == v[3] != v[2]


def test_last_reference_of_a_key_wins(spark):
    refs = spark.createDataFrame([(1, "p", 0, "[R1]", None, None, None, None, None, None), (2, "p", 5, "r1", None, None, None, None, None, None), (3, "p", 1, "#", None, None, None, None, None, None)], REFS)
    assert [(r.ref_key, r.ref_row_id) for r in citations.reference_table(refs).collect()] == [("r1", 2)]


def test_citation_fetch(spark):
    papers = spark.createDataFrame([("doi:10.10000/z", "Rapid clearing of zebrafish embryos", None, "Text here."), ("doi:10.10000/q", "Other", None, " ")], PAPERS)
    refs = spark.createDataFrame([(1, "p", 0, "a", "Smith. Rapid clearing of zebrafish embryos. 2001", None, None, None, None, None), (2, "p", 1, "b", "x", "10.10000/q", None, None, None, None), (3, "p", 2, "c", None, None, None, None, None, None)], REFS)
    out = {r.ref_row_id: (r.target, r.via, r.reason) for r in citations.fetch_targets(refs, papers).collect()}
    assert out == {1: ("doi:10.10000/z", "citation", None), 2: (None, None, "source_unavailable"), 3: (None, None, "reference_unresolved")}


def test_enrichment_fills_but_keeps(spark):
    p = spark.createDataFrame([("a", "doi", "T", ""), ("b", "doi", None, "has text")], "paper_id string, source string, title string, methods_text string")
    f = spark.createDataFrame([("a", "Other", "found"), ("b", "Other", "found")], "paper_id string, title string, methods_text string")
    assert {tuple(r) for r in citations.enrich(p, f).collect()} == {("a", "doi", "T", "found"), ("b", "doi", None, "has text")}


@pytest.mark.parametrize("rows,total", [([("fully_described", 1)], 100.0), ([("shortcut_citation", 0)], 0.0), ([("fully_described", 1), ("shortcut_citation", 0)], 50.0)])
def test_coverage(spark, rows, total):
    c = spark.createDataFrame([("p", "procedure", s, b) for s, b in rows], "paper_id string, type string, specificity string, backed int")
    assert [r.coverage for r in score.coverage(c, "paper_id").filter("type is null").collect()] == [total]


def test_inferred_is_not_evidence(spark):
    step = [(0, "p", [1], "t")]
    df = spark.createDataFrame([("shortcut_citation", "resolved", step), ("partially_described", "inferred", step), ("shortcut_citation", "resolved", []), ("fully_described", "resolved", None)], f"specificity string, status string, chain {resolve.STEP}")
    assert [r.e for r in df.select(score.evidence(F.col("specificity"), F.col("status"), F.col("chain")).alias("e")).collect()] == [1, 0, 0, 1]


def test_upsert_latest_wins_and_replaces(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "claim_id string, v int")
    b = spark.createDataFrame([("x", 2), ("x", 3)], "claim_id string, v int")
    assert {tuple(r) for r in store.upsert(a, b, "claim_id", "v").collect()} == {("x", 3), ("y", 1)}


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "paper_id string, v int")
    store.write_table(df, str(tmp_path / "t"), buckets=2)
    assert store.read_or_empty(spark, str(tmp_path / "t"), "paper_id string, v int").count() == 2
    assert store.read_or_empty(spark, str(tmp_path / "none"), "paper_id string").count() == 0


def test_latest_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5, "b"), (1, 5, "a"), (None, 1, "z")], "k int, v int, t string")
    assert {tuple(r) for r in latest_rows(df, "k", "v", "t").collect()} == {(1, 5, "b"), (None, 1, "z")}


def test_variability(spark):
    runs = [("p", 0, "a", 0), ("p", 1, "a", 0), ("p", 2, "a", 0), ("p", 2, "b", 1)]
    df = spark.createDataFrame([(p, r, t, "procedure", "fully_described", "resolved", i) for p, r, t, i in runs], "paper_id string, run int, raw_text string, type string, specificity string, resolution_status string, pos int")
    r = analytics.variability(df).collect()[0]
    assert (r.n_runs, r.least, r.most, r.jaccard_min, r.agreement_mean) == (3, 1, 2, 0.5, 1.0) and r.cv > 0
    one = analytics.variability(df.filter("run = 0")).collect()[0]
    assert (one.cv, one.jaccard_mean, one.agreement_min) == (0.0, 1.0, 1.0)


def protocol(chain, **more):
    return json.dumps({"protocol_id": "x", "sections": {"procedure": [{"claim_id": "c", "resolution_chain": chain}]}, "gaps": None} | more)


@pytest.mark.parametrize(
    "payload,want",
    [
        (None, set()),
        ("", set()),
        ("{}", set()),
        (protocol([])[:-9], set()),
        (protocol([]), {("claim", "c", -1, "", -1)}),
        (protocol(None), {("claim", "c", -1, "", -1)}),
        (protocol([{"source_paper_id": "s", "sentence_ids": [1, "2", None]}, {"sourcePaperId": "t"}]), {("claim", "c", 0, "s", 1), ("claim", "c", 0, "s", 2), ("claim", "c", 1, "t", -1)}),
        (json.dumps(protocol({"source_paper_id": "s", "sentence_ids": 4, "next_step": {"source_paper_id": "u", "sentence_ids": []}})), {("claim", "c", 0, "s", 4), ("claim", "c", 1, "u", -1)}),
        (json.dumps({"result": json.loads(protocol({"steps": [{"source_paper_id": "s", "sentence_ids": [3]}]}))}), {("claim", "c", 0, "s", 3)}),
        (json.dumps({"status": "ok", "n": 1, "data": {"protocol": json.loads(protocol([]))}}), {("claim", "c", -1, "", -1)}),
        ("﻿" + protocol(json.dumps([{"source_paper_id": "s", "sentence_ids": [0]}])), {("claim", "c", 0, "s", 0)}),
        (json.dumps({"sections": [{"section": "a", "claims": {"claimId": "k"}}], "gaps": [{"claim_id": "g", "chain_trace": [{"source_paper_id": "z"}]}]}), {("claim", "k", -1, "", -1), ("gap", "g", 0, "z", -1)}),
    ],
)
def test_nested_payloads(spark, payload, want):
    df = spark.createDataFrame([(1, "p", None, payload, "clash")], "record_id long, paper_id string, received_at timestamp, payload string, holder string")
    got = nested.sentence_links(nested.nest_holders(df.unionByName(df)))
    assert {tuple(r)[1:] for r in got.collect()} == want and got.count() == len(want)


def test_nested_empty_table(spark):
    df = spark.createDataFrame([], "record_id long, paper_id string, received_at timestamp, payload string")
    n = nested.nest_holders(df)
    assert nested.sentence_links(n).count() == nested.holder_rows(n).count() == nested.step_rows(n).count() == 0


def test_jats_and_tei(spark):
    jats = '<article><front><article-title>A &amp; B</article-title></front><body><sec><title>Methods</title><p>We did <xref ref-type="bibr" rid="b1 b2">1</xref> it.</p><sec><title>Inner</title><p>More.</p></sec><fig><p>no</p></fig></sec><sec><title>Results</title><p>no</p></sec></body></article>'
    df = spark.createDataFrame([(1, jats), (2, "<bad"), (3, None)], "id int, x string")
    r = {x.id: x for x in parsers.xml_papers(df, "id", "x", "jats").collect()}
    assert r[1].title == "A & B" and r[1].methods == "Methods\nWe did [b1] it.\nInner\nMore." and r[2].title is None and r[3].methods is None
    tei = "<TEI><text><body><div><head>Intro</head><p>no</p></div><div><head>Methods</head><p>Yes <ref type='bibr' target='#b3'>[4]</ref>.</p></div><div><head>Staining</head><p>Also.</p></div><div><head>Results</head><p>no</p></div></body></text></TEI>"
    t = parsers.xml_papers(spark.createDataFrame([(1, tei)], "id int, x string"), "id", "x", "tei").collect()[0]
    assert t.methods == "Yes [b3].\nAlso."


def test_find_paper(spark):
    p = spark.createDataFrame([("fixture:smith_2020", "Rapid clearing of embryos", ["old one"], 2020, [("Smith, Ann", None, None)], "f1")], "paper_id string, title string, aliases array<string>, year int, authors array<struct<name:string,orcid:string,affiliation:string>>, file string")
    i = spark.createDataFrame([("fixture:smith_2020",), ("smith_2020",), ("Old One",), ("rapid clearing",), ("Smith 2020",), ("zzz",)], "ident string")
    assert {r.ident: r.rule for r in parsers.find_paper(i, p).collect()} == {"fixture:smith_2020": 0, "smith_2020": 1, "Old One": 2, "rapid clearing": 3, "Smith 2020": 5}


def test_events_stream_equals_batch(spark, small, tmp_path):
    log = spark.read.parquet(f"{small}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job"), F.col("event_type").alias("kind"), "value")
    log.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    s = E.stream(spark, str(tmp_path / "in"), log.schema.simpleString()[7:-1].replace(":", " "), 10)
    q = E.stream_windows(s).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    row = lambda r: (r.start, r.kind, r.n, round(r.total, 4))
    assert sorted(map(row, spark.table("w").collect())) == sorted(map(row, E.windows(log).collect()))


def test_events_with_nulls(spark):
    df = spark.createDataFrame([(1, None, "j", "a", 1.0), (2, "2024-01-01 00:00:00", None, "a", 1.0), (3, "2024-01-01 00:00:00", "j", "a", None)], "event_id long, ts string, job string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert [tuple(r)[:2] for r in E.latest_status(df).collect()] == [("j", "a")]
    assert E.budget(df, F.col("value"), 5).collect()[0].spent == 0
    assert E.replay(df.limit(0)).count() == 0


def test_cache(spark):
    req = spark.createDataFrame([("a", 1), ("b", 2)], "p string, t int")
    key = req.select(F.sha2(F.to_json(F.struct("p", "t")), 256).alias("k")).collect()[0].k
    cache = spark.createDataFrame([(key, "yes", "2024-01-01 00:00:00")], "key string, answer string, stored_at string").withColumn("stored_at", F.to_timestamp("stored_at"))
    out = E.cached(req, cache, ["p", "t"], F.to_timestamp(F.lit("2024-01-01 10:00:00")), 86_400).collect()
    assert {(r.p, r.answer, r.ask) for r in out} == {("a", "yes", False), ("b", None, True)}


def test_plugged_classifier_falls_back(spark):
    def bad(frame):
        raise ValueError("no model")

    df = spark.createDataFrame([("x",)], "chunk string")
    out = claims.extract_with(df, bad, "chunk string, kind string", lambda f: f.assign(kind="rules"))
    assert [tuple(r) for r in out.collect()] == [("x", "rules")]


def test_packed_search_is_the_full_sum(spark, monkeypatch):
    """Packs give what summing every posting gives, with hidden and kept-out documents and a least share of words."""
    import math
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    text_of = lambda n: " ".join(words[min(59, int(rng.expovariate(0.12)))] for _ in range(n))
    rows = [(i, text_of(rng.randint(1, 12)), rng.choice("ab"), f"p{i % 7}") for i in range(900)]
    asks = [(i, text_of(6), rng.choice("ab"), f"p{i % 7}") for i in range(40)]
    docs, q = spark.createDataFrame(rows, "id int, t string, kind string, paper string"), spark.createDataFrame(asks, "qid int, q string, kind string, paper string")
    n, avg = len(rows), sum(len(r[1].split()) for r in rows) / len(rows)
    df = {w: sum(w in r[1].split() for r in rows) for w in words}

    def full(ok, k, need=0.0):
        out = set()
        for a in asks:
            qs, all_ = set(a[1].split()), []
            for r in rows:
                t = r[1].split()
                hit = [w for w in qs if w in t]
                if hit and ok(a, r) and len(hit) >= math.floor(len(qs) * need):
                    all_.append((-round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in hit), 6), r[0]))
            out |= {(a[0], i) for _, i in sorted(all_)[:k]}
        return out

    got = lambda found: {(r.qid, r.id) for r in found.collect()}
    assert got(retrieve.bm25(docs, ["id"], "t", q.select("qid", "q"), "qid", "q", 4)) == full(lambda a, r: True, 4)
    assert got(retrieve.bm25(docs, ["id"], "t", q.select("qid", "q"), "qid", "q", 4, keep=F.col("kind") == "a")) == full(lambda a, r: r[2] == "a", 4)
    assert got(retrieve.bm25(docs, ["id"], "t", q, "qid", "q", 4, ["kind"], own="paper")) == full(lambda a, r: r[2] == a[2] and r[3] != a[3], 4)
    cited = retrieve.best_paper(docs.select(F.format_string("%04d", "id").alias("paper_id"), F.col("t").alias("title"), F.lit("").alias("abstract")), q.select("qid", "q"), "qid", "q")
    assert {(r.qid, int(r.paper_id)) for r in cited.collect()} == full(lambda a, r: True, 1, 0.6)


def test_search_makes_no_row_per_posting(spark):
    """Documents and queries that all share a word: rows between operators stay far below their product."""
    docs = spark.range(300).select("id", F.concat(F.lit("common w"), "id").alias("t"))
    q = spark.range(200).select(F.col("id").alias("qid"), F.concat(F.lit("common w"), "id").alias("q"))
    found = retrieve.bm25(docs, ["id"], "t", q, "qid", "q", 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (term" not in plan and "explode" not in plan
    assert found.filter("rank0 = 0 and qid = id").count() == 200


def test_walk_sends_no_table_through_the_driver(spark, chain, monkeypatch):
    """Its rounds join by shuffles, and the papers are packed once for all of them."""
    fix = lambda df, col: df.withColumn(col, F.regexp_replace(col, "10.1/", "10.10000/"))
    papers, refs, sents, c = fix(chain[0], "paper_id"), fix(fix(chain[1], "paper_id"), "doi"), fix(chain[2], "paper_id"), fix(chain[3], "paper_id")
    name, seen, packed = "spark.sql.autoBroadcastJoinThreshold", [], []
    before = spark.conf.get(name)
    fetch, pack = citations.fetch_targets, retrieve.paper_packs
    monkeypatch.setattr(citations, "fetch_targets", lambda *a: (seen.append(spark.conf.get(name)), fetch(*a))[1])
    monkeypatch.setattr(retrieve, "paper_packs", lambda p: (packed.append(p.columns), pack(p))[1])
    resolve.walk(c.filter("specificity = 'shortcut_citation'").select("claim_id", "paper_id", "raw_text", "cited_ref_ids"), refs, papers, sents, strip_stamps=True).collect()
    assert len(seen) > 1 and set(seen) == {"-1"} and spark.conf.get(name) == before
    assert len(packed) == 1 and "methods_text" not in packed[0]
