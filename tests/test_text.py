from pyspark.sql import functions as F

from evigraph.functions import ids, text
from evigraph.operators import claims as C


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).collect()[0].x


def sents(spark, t):
    return one(spark, text.sentences(F.col("t")), t=t)


def test_abbreviation_joins_also_across_lines(spark):
    assert sents(spark, "Cells came from St. Louis today. They grew.") == ["Cells came from St. Louis today.", "They grew."]
    assert sents(spark, "as shown in Fig.\n2 here. Done!") == ["as shown in Fig. 2 here.", "Done!"]


def test_blank_null_and_repeated(spark):
    assert sents(spark, None) == [] and sents(spark, "") == [] and sents(spark, " \n\t ") == []
    assert sents(spark, "A b. A b.") == ["A b.", "A b."]


def test_unicode_space_and_letters(spark):
    assert sents(spark, "Señor ño. Luego fin.") == ["Señor ño.", "Luego fin."]


def test_stamp_round_trip(spark):
    s = ["One two.", "[3] odd start", "x"]
    df = spark.createDataFrame([(s,)], "s array<string>")
    out = df.select(text.parse_stamped(text.stamp(F.col("s"))).alias("x")).collect()[0].x
    assert [(r.sentence_id, r.text) for r in out] == list(enumerate(s))


def test_packing(spark):
    df = spark.createDataFrame([([40, 30, 1],)], "z array<int>")
    assert df.select(text.pack(F.col("z"), 60).alias("x")).collect()[0].x == [0, 1, 1]
    df = spark.createDataFrame([([1] * 501,)], "z array<int>")
    x = df.select(text.pack(F.col("z"), 60_000, 250).alias("x")).collect()[0].x
    assert [x.count(i) for i in range(3)] == [250, 250, 1]
    df = spark.createDataFrame([([],)], "z array<int>")
    assert df.select(text.pack(F.col("z"), 10).alias("x")).collect()[0].x == []


def test_overlap(spark):
    ok = text.meaningful_overlap(F.col("a"), F.col("b"))
    assert one(spark, ok, a="embryos were fixed in formalin overnight", b="formalin fixed embryos")
    assert not one(spark, ok, a="cells were washed with buffer", b="mice were kept in cages")
    assert not one(spark, ok, a="", b="")


def test_reference_ids_keep_case_order_and_repetition(spark):
    assert one(spark, C.cited_refs(F.col("s")), s="see [R9][b12] and [ref_4][R9]") == ["R9", "b12", "ref_4", "R9"]


def test_specificity_and_type(spark):
    k = lambda s: (one(spark, C.specificity(F.col("s")), s=s), one(spark, C.claim_type(F.col("s")), s=s))
    assert k("It was described in a book.")[0] == "shortcut_citation"  # the rule is not anchored
    assert k("Done under standard conditions.")[0] == "standard_unspecified"
    assert k("Briefly, tubes were centrifuged.") == ("partially_described", "procedure")
    assert k("5 mM solution")[1] == "reagent"
    assert k("Summary of all")[1] == "procedure"


def test_identifiers(spark):
    r = lambda s: tuple(one(spark, ids.route(F.col("s")), s=s))
    assert r("https://x.org/abs/2301.12345v2") == ("arxiv", "2301.12345")
    assert r("pmc123456") == ("pmc", "PMC123456")
    assert r("doi:10.5555/ABC.1).") == ("doi", "10.5555/abc.1")
    assert r("see file.PDF") == ("pdf", "see file.PDF")
    assert r("nothing") == ("none", None)
    assert one(spark, ids.ref_key(F.col("s")), s=" [Ref_12] ") == "ref_12"


def test_uuid_is_name_based(spark):
    import uuid

    for n in ("a|0|procedure|x", "", "ß 漢"):
        assert one(spark, ids.uuid5(F.col("n")), n=n) == str(uuid.uuid5(uuid.NAMESPACE_URL, n))


def test_addresses(spark):
    a = lambda u: one(spark, ids.acceptable_url(F.col("u")), u=u)
    assert a("https://example.org/x.pdf")
    assert not a("http://10.1.2.3/x") and not a("http://localhost/") and not a("ftp://example.org/") and not a("http://u:p@example.org/") and not a("http://172.20.0.1/")
    assert a("http://172.32.0.1/") and not a(None) and not a("")


def test_freshness(spark):
    f = ids.fresh(F.to_timestamp("t"), F.to_timestamp(F.lit("2024-01-02 00:00:00")), 86_400)
    assert not one(spark, f, t="2024-01-01 00:00:00") and one(spark, f, t="2024-01-01 00:00:01")
    assert not one(spark, f, t=None) and not one(spark, f, t="2024-01-03 00:00:00")


def test_stems(spark):
    from evigraph.functions.stem import english_terms, porter
    from evigraph.operators import retrieve

    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll"}
    assert {w: porter(w) for w in want} == want
    assert one(spark, english_terms(F.col("t")), t="The cell's Washings, and 2 tubes") == ["cell", "wash", "2", "tube"]
    docs = spark.createDataFrame([(1, "washing of cells"), (2, "frozen"), (3, None)], "id int, t string")
    q = spark.createDataFrame([(9, "washed cell")], "q int, x string")
    assert [r.id for r in retrieve.bm25(docs, ["id"], "t", q, "q", "x", 5, analyze=english_terms).collect()] == [1]


def test_address_guard_refuses_odd_forms(spark):
    rows = [
        ("http://[::1]/x", False), ("http://[fd00::1]/", False), ("http://[fe80::1]/", False), ("http://[::ffff:10.0.0.1]/", False), ("http://[2001:db8::1]/", False), ("http://[2002:7f00:1::]/", False),
        ("http://[2606:4700::1111]/a.pdf", True), ("http://2130706433/", False), ("http://0x7f000001/", False), ("http://127.1/", False), ("http://0177.0.0.1/", False), ("http://8.8.8.8/a", True), ("http://10.1.2.3/", False),
        ("https://localhost./", False), ("https://a.localhost/", False), ("https://data.example.org/x", True), ("ftp://data.example.org/x", False), ("https://u@data.example.org/", False), (None, False), ("", False),
    ]
    df = spark.createDataFrame(rows, "u string, want boolean")
    assert df.filter(ids.acceptable_url(F.col("u")) != F.col("want")).collect() == []
