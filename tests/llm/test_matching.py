import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import names, refmatch
from evigraph.llm.knn import _pack, _unpack, neighbour_pairs, neighbours


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    out = set()
    for i, row in enumerate(s):
        for j in np.lexsort((ids, -row))[:k]:
            out.add(tuple(sorted((int(ids[i]), int(ids[j])))))
    return out


def test_neighbours_against_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/methods_sentences.parquet").select("vec_id", "vector")
    got = {tuple(r) for r in neighbour_pairs(df, "vec_id", "vector").collect()}
    rows = [r for r in df.dropDuplicates(["vec_id"]).collect() if r.vector is not None and len(r.vector) == 384 and any(r.vector)]
    want = brute(np.array([r.vec_id for r in rows]), np.array([r.vector for r in rows], float), 5)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.05 * len(want)


def test_many_equal_vectors_and_bad_ones(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0] + [0.0] * 7) for i in range(40)] + [(100 + i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(200, None), (201, [0.0] * 8), (202, [1.0] * 3), (203, [float("nan")] * 8), (5, [1.0] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "id long, v array<float>").withColumn("q", F.lit(1))
    got = {tuple(r) for r in neighbour_pairs(df, "id", "v", 5, 8).collect()}
    same = {(min(i, j), max(i, j)) for i in range(40) for j in [x for x in range(7) if x != i][:5]}
    assert {p for p in got if p[1] < 40} == same
    assert not any(x >= 200 for p in got for x in p)
    assert neighbours(df.limit(0), "id", "v", 5, 8).count() == 0


def test_pivots_grow_and_bundled_files_lose_nothing(spark, monkeypatch):
    from evigraph.llm import knn

    assert knn.MAX_PIVOTS >= 2 * 15_600_000**0.5  # 6.2 GB: files of 5,900 vectors, not 11,400
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(60, 16))[rng.integers(0, 60, 2000)] + rng.normal(size=(2000, 16)) / 2).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    monkeypatch.setattr(knn, "FLAT", 32)  # up to 89 pivots in bundles of 6
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -3)
    want = {(min(i, j), max(i, j)) for i in range(len(x)) for j in np.argsort(-cos[i], kind="stable")[:5].tolist()}
    for options, least in (({"posts": 12, "max_pivots": 40}, 0.99), ({"block": 128}, 0.9)):
        got = {tuple(r) for r in neighbour_pairs(df, "id", "v", 5, 16, **options).collect()}
        assert len(got & want) >= least * len(want)


def test_packs_are_lossless():
    import zstandard

    from evigraph.llm.knn import _codes

    rng = np.random.default_rng(1)
    for x in (rng.normal(size=(5, 12)).astype(np.float32), (rng.integers(-60, 60, (5, 12)) / 64).astype(np.float32)):
        ids, prefix, coded = np.arange(5), np.zeros((5, 4), np.int16), _codes(x)
        i, p, y = _unpack(_pack(ids, prefix, x, coded, zstandard.ZstdCompressor()), 4, 12)
        assert (i == ids).all() and (y == x).all() and (p == prefix).all()


@pytest.mark.parametrize(
    "name,want",
    [
        ("Adele Puzindru", ("puzindru", "adele", "", "a")),
        ("Puzindru, Adele M.", ("puzindru", "adele", "m", "a")),
        ("Puzindru AM", ("puzindru", "", "m", "a")),
        ("A. M. PUZINDRU*", ("puzindru", "", "m", "a")),
        ("Prof. Puzindru Adele 1,2", ("puzindru", "adele", "", "a")),
        ("The Foklemvem Atlas Consortium", ("foklemvemac", "", "", "*")),
        ("", None),
        (None, None),
    ],
)
def test_parse_name(name, want):
    assert names.parse_name(name, frozenset({"adele"})) == want


def test_affiliations_and_orcid():
    a = names.affiliation_key
    assert a("National Laboratory for Imaging, Velmar") == a("NLI Velmar") == a("velmar natl. lab. imaging")
    assert a("School of Medicine, Brask") != a("School of Medicine, Velmar") and a(None) is None
    assert names.orcid_key("https://o.example/9000-0000-0001-337x") == names.orcid_key("900000000001337X") and names.orcid_key("none") is None


def test_entities(spark):
    rows = [
        (1, "Puzindru, Adele", "NLI Velmar", None), (2, "A. Puzindru", "Natl. Lab. Imaging, Velmar", None), (3, "Pzuindru, Adele", "NLI Velmar", None),
        (4, "Puzindru, Adele", "School of Medicine, Brask", None),  # same name elsewhere
        (5, "Tony Kelmas", "TU Brask", "9000-0000-0000-0001"), (6, "Kelmas, Anthony", "TU Velmar", "9000000000000001"), (7, "A. Kelmas", "TU Velmar", None),
        (8, "Bo Ramos", None, None), (9, None, "TU Brask", None), (10, " ", None, None), (1, "Puzindru, Adele", "NLI Velmar", None),
        (11, "The Foklem Atlas Consortium", "X", None), (12, "Foklem Atlas Consort.", None, None),
        (13, "Ada Vornel", "TU Brask", None), (14, "Anna Vornel", "TU Brask", None), (15, "A. Vornel", "TU Brask", None),
    ]
    df = spark.createDataFrame(rows, "author_id long, author_name string, affiliation string, orcid string").withColumn("entity", F.lit("clash"))
    got = {tuple(r) for r in names.entity_pairs(df).collect()}
    want = {p for g in ((1, 2, 3), (5, 6, 7), (11, 12)) for p in itertools.combinations(g, 2)}
    assert got == want
    assert names.entity_pairs(df.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51), (51, 50)], "a long, b long")
    assert {(r.cid, r.root) for r in names.components(links).collect()} == {(i, 1) for i in range(2, 31)} | {(51, 50)}


PAPERS = [("p1", "Deep sequencing of kormalib and wound closure in rat", 2010, "Journal of Tests"), ("p2", "Deep sequencing of kormalib and wound closure in rat II", 2012, "Journal of Tests"), ("p3", "Deep sequencing of kormalib and wound closure in yeast", 2011, "Journal of Tests"), ("p4", "Spatial mapping of tudrelone in barley", 2001, None)]


def test_references_against_expectation(spark):
    refs = [
        (1, "A. Bor (2010). Deep sequencing of kormalib and wound closure in rat. J Tests 4.", None, 2010, None, None, None),
        (2, "A. Bor, Deep sequencing of kormalbi and wound clsoure in rat II. J Tests 4.", None, None, None, None, None),
        (3, "", "deep seq. of kormalib & wound closure in yeast", None, None, None, None),
        (4, "A. Bor. Deep sequencing of kormalib and wound closure in axolotl. 2010.", None, 2010, "10.5555/p1", None, None),
        (5, None, None, None, None, None, None),
        (6, "Spatial Mapping of Tudrelone in Barley. 2001", None, 2001, None, None, None),
    ]
    p = spark.createDataFrame(PAPERS, "paper_id string, title string, pub_year int, venue string")
    r = spark.createDataFrame(refs, "ref_row_id long, raw_citation string, title string, pub_year int, doi string, arxiv_id string, pmc_id string")
    got = {x.ref_row_id: (x.paper_id, x.confidence) for x in refmatch.match(p, r.unionByName(r)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "p1", 2: "p2", 3: "p3", 6: "p4"} and all(0.5 <= v[1] <= 1 for v in got.values())
    assert refmatch.match(p, r.limit(0)).count() == 0 and refmatch.match(p.limit(0), r).count() == 0


def test_training_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 14))
    y = (x[:, 0] > 0).astype(float)
    w, slope, _ = refmatch.train(x, y, np.arange(400) % 2)
    z = slope * (x @ w[:-1] + w[-1])
    assert ((z > 0) == (y > 0)).mean() > 0.95
    assert refmatch.train(x[:10], y[:10], np.arange(10) % 2)[0] is refmatch.DEFAULT


def test_exact_titles_are_found(spark, small):
    """Held-out check: references whose title equals one paper's title go to that paper."""
    from evigraph.llm.queries import p6_match

    m = {r.ref_row_id: r.paper_id for r in p6_match(spark, small).collect()}
    p = {refmatch.fold(r.title): r.paper_id for r in spark.read.parquet(f"{small}/papers.parquet").collect() if r.title}
    want = {r.ref_row_id: p[refmatch.fold(r.title)] for r in spark.read.parquet(f"{small}/paper_refs.parquet").collect() if r.title and refmatch.fold(r.title) in p}
    assert want and sum(m.get(k) == v for k, v in want.items()) >= 0.97 * len(want)


TEMPLATE = "Deep sequencing of {} and wound closure in rat"
REF_SCHEMA = "ref_row_id long, raw_citation string, title string, pub_year int, doi string, arxiv_id string, pmc_id string"


def invented(n, seed=7):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("bdfgklmnprstvz" if i % 2 == 0 else "aeiou")) for i in range(rng.integers(5, 10))) for _ in range(n)]


def slips(w, rng):
    i = int(rng.integers(1, len(w) - 2))
    return [w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]]


def template_papers(spark, rare):
    return spark.createDataFrame([(f"p{i}", TEMPLATE.format(w), 2010, None) for i, w in enumerate(rare)], "paper_id string, title string, pub_year int, venue string")


def test_slips_in_the_only_rare_word(spark):
    """A slipped rare word still meets its paper, whatever the slip and wherever it stands."""
    rng, rare = np.random.default_rng(3), sorted(set(invented(60)))
    want = {100 * i + k: (f"p{i}", s) for i, w in enumerate(rare) if len(w) >= 7 for k, s in enumerate(slips(w, rng)[:3])}
    r = spark.createDataFrame([(n, None, TEMPLATE.format(s), 2010, None, None, None) for n, (_, s) in want.items()], REF_SCHEMA)
    got = {x.ref_row_id: x.paper_id for x in refmatch.match(template_papers(spark, rare), r).collect()}
    assert got == {n: p for n, (p, _) in want.items()}


def test_words_of_many_titles_meet_by_their_context(spark, monkeypatch):
    monkeypatch.setattr(refmatch, "WARM_LEAST", 5)
    rare = sorted(set(invented(40)))
    p = template_papers(spark, rare).unionByName(spark.createDataFrame([(f"w{i}", f"Deep sequencing of kormalib and closure in {w}", 2010, None) for i, w in enumerate(["liver", "kidney", "muscle", "spleen", "tendon", "retina"])], "paper_id string, title string, pub_year int, venue string"))
    r = spark.createDataFrame([(1, None, "Deep sequencing of kormalbi and closure in spleen", 2010, None, None, None), (2, None, "Deep sequencing of kormalib and closure in retina", 2010, None, None, None)], REF_SCHEMA)
    got = {x.ref_row_id: x.paper_id for x in refmatch.match(p, r).collect()}
    assert got == {1: "w3", 2: "w5"}


def test_any_one_slip_is_alike():
    bits = refmatch._bits
    for w in [*invented(80), "kubokza", "bemtoksu", "kornalib"]:
        for i in range(len(w)):
            made = {w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :]}
            assert all(refmatch._like(w, bits(w), x, bits(x)) for x in made), (w, made)
    assert refmatch._like("kornalib", bits("kornalib"), "komalbi", bits("komalbi")) and not refmatch._like("kubokza", bits("kubokza"), "bemtoksu", bits("bemtoksu"))


def test_citation_counts_beside_a_garbled_title(spark):
    rare = sorted(set(invented(40)))
    r = spark.createDataFrame([(i, f"A. Bor. {TEMPLATE.format(w)}. 2010", TEMPLATE.format("xq" + w[2:-2] + "qx"), 2010, None, None, None) for i, w in enumerate(rare)], REF_SCHEMA)
    got = {x.ref_row_id: x.paper_id for x in refmatch.match(template_papers(spark, rare), r).collect()}
    assert got == {i: f"p{i}" for i in range(len(rare))}


def test_slipped_family_without_affiliation(spark):
    rows = [(1, "Fokzorras, Odile", "TU Brask", None), (2, "Fpkzorras, Odile", None, None), (3, "Vindala, Maria", "TU Brask", None), (4, "Vindela, Maria", "TU Velmar", None), (5, "Vindila, Maria", None, None)]
    df = spark.createDataFrame(rows, "author_id long, author_name string, affiliation string, orcid string")
    assert {tuple(r) for r in names.entity_pairs(df).collect()} == {(1, 2)}  # 5 fits two


def test_files_longer_than_a_block_leave_no_pair_out(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, *rows[:50]], "id long, v array<float>").repartition(5)
    got = {tuple(r) for r in neighbour_pairs(df, "id", "v", 5, 16, max_pivots=4, posts=4, block=64).collect()}
    assert got == brute(np.arange(700), x, 5)  # four files that hold every vector
    got = {tuple(r) for r in neighbour_pairs(df, "id", "v", 5, 16, max_pivots=100, posts=2, block=8).collect()}
    want = {tuple(r) for r in neighbour_pairs(df, "id", "v", 5, 16, max_pivots=100, posts=2).collect()}
    assert got == want


def test_titles_without_a_rare_word_or_a_common_neighbour(spark):
    a, b = (sorted(set(invented(20, seed)))[:13] for seed in (21, 22))
    titles = {f"t{i}_{j}": f"Spatial mapping of {x} in {y}" for i, x in enumerate(a) for j, y in enumerate(b)}  # every word in 13 titles or more
    titles["alone"] = "Vondrelaq kimzortup beldranof"
    p = spark.createDataFrame([(k, t, 2010, None) for k, t in titles.items()], "paper_id string, title string, pub_year int, venue string")
    r = spark.createDataFrame([(1, None, titles["t3_4"], 2010, None, None, None), (2, f"Bor, Q. (2010). {titles['t5_6']}. 4, 7-9.", None, 2010, None, None, None), (3, f"Borzu: {titles['alone']}. 2010", None, 2010, None, None, None)], REF_SCHEMA)
    got = {x.ref_row_id: x.paper_id for x in refmatch.match(p, r).collect()}
    assert got == {1: "t3_4", 2: "t5_6", 3: "alone"}


def test_words_unlike_any_common_one_are_mended_without_variants(monkeypatch):
    """Most words of a citation differ from every common word at both ends; their variants are made only to be posted, all at once."""
    made, deletions = [], refmatch._deletions
    common = frozenset(["sequencing", "closure", "wound", "liver", "burner"]) | refmatch.STOP
    h = refmatch.Poster(common, frozenset(["kidney"]))
    monkeypatch.setattr(refmatch, "_deletions", lambda w: made.append(w) or deletions(w))
    rare = [f"x{w}x" for w in invented(300)]
    assert h.keys(rare, False, 4) == (set(rare), set()) and not made
    words = [*common, "kidney"]
    for w in [w for w in words if len(w) > 4]:
        for i in range(len(w)):
            for x in (w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :], w[:i] + w[i] + w[i:]):
                assert h.mend(x) == (() if x in words or len(x) < 4 else tuple(v for v in sorted(words) if len(v) > 4 and refmatch.one_slip(v, x))), x


def test_variant_keys_are_those_of_the_variants():
    some = [*invented(200), "kornalib", "rnrn", "aaaa", "ßßab", "x" * 500, "\U0001d4d0bcde", "burner"]
    sizes, keys = refmatch.variant_keys(some)
    own = [set(k.tolist()) for k in np.split(keys, np.cumsum(sizes)[:-1])]
    want = [refmatch._deletions(w) | (refmatch._deletions(w.replace("rn", "m")) if "rn" in w else set()) for w in some]
    for k, v in zip(own, want):
        assert len(k) == len(v)
    for i, j in itertools.combinations(range(len(some)), 2):
        assert len(own[i] & own[j]) == len(want[i] & want[j]), (some[i], some[j])
    assert refmatch.variant_keys([])[1].size == 0


def test_keys_of_a_row_are_distinct():
    posted = [({"kormalib", "kormalbi"}, {5, 7}), (set(), set()), ({"kormalib"}, {7})]
    row, key = refmatch.posted_keys(posted)
    assert len(set(zip(row.tolist(), key.tolist()))) == len(row) == len(refmatch._deletions("kormalib") | refmatch._deletions("kormalbi")) + 2 + len(refmatch._deletions("kormalib")) + 1
    assert set(row.tolist()) == {0, 2} and [x.size for x in refmatch.posted_keys([(set(), set())])] == [0, 0]


def test_words_of_any_script():
    for text in ("a-b_c 12x", "Größe – “α-beta”", "naïve", "– “x1” …", "", "日本語 text", "a\x1cb\u2028c"):
        assert refmatch.words(text) == refmatch._TOKEN.findall(text)
