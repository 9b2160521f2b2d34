import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evigraph.llm.bpe import Utf8, decode_corpus, encode_corpus, transducer
from evigraph.llm.split import cut_kind, pieces, split_long
from evigraph.llm.token_budget import document_tokens, parts, roll_up

TEXTS = st.text(alphabet="aAb c1'\"é中\n\t .,<|>ß😀\x85\xa0​xyzsdt", max_size=60)


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_equals_the_library(library, text):
    got = transducer().encode(text)
    assert got == library.encode(text, add_special_tokens=False).ids
    assert transducer().decode(got) == text and transducer().count(text) == len(got)


def test_special_strings_are_text_and_long_pieces_work(library):
    for t in ("<|endoftext|>", "ab" * 20_000, "中文" * 20_000, " " * 5_000 + "x"):
        assert transducer().encode(t) == library.encode(t, add_special_tokens=False).ids


def test_transducer_equals_merging():
    t = transducer()
    for w in ("tokenizer", "zzzzzz", "naïve", "0123456789"):
        assert list(t.run(w.encode())) == t.merged(w.encode())


@given(st.binary(max_size=20))
def test_utf8_machine_on_valid_and_invalid_input(data):
    out = "".join(Utf8().feed(data, last=True))
    try:
        assert out == data.decode()
    except UnicodeDecodeError:
        assert "�" in out
    u = Utf8()
    assert "".join(c for b in data for c in u.feed(bytes([b]))) + ("�" if u.need else "") == out


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_parts_are_independent(text, limit):
    p = parts(text, limit)
    assert "".join(p) == text and sum(map(transducer().count, p)) == transducer().count(text)


def test_corpus(spark):
    df = spark.createDataFrame([(1, "Hello world", "s"), (2, None, None), (3, "", "S "), (1, "Hello world", "s")], "doc_id long, text string, source string").withColumn("ids", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    e = encode_corpus(df)
    assert sorted((r.doc_id, r.ids) for r in e.collect()) == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert {r.doc_id: r.text for r in decode_corpus(e).collect()} == {1: "Hello world", 2: "", 3: ""}
    assert encode_corpus(df.limit(0)).count() == 0


def test_token_budget_cuts_big_documents(spark):
    big = "some words and 12 numbers, " * 400
    df = spark.createDataFrame([(1, big, "a", "en"), (2, "x", "a", None), (3, None, "b", None)], "doc_id long, text string, source string, lang string")
    r = document_tokens(df, "doc_id", "text", ("source",), "lang", limit=500)
    got = {x.doc_id: (x.n_tokens, x.lang) for x in r.collect()}
    assert got[1] == (transducer().count(big), "en") and got[2][0] == 1 and got[3] == (0, "und")
    assert {tuple(x) for x in roll_up(r, "source").collect()} == {("a", 2, 2, got[1][0] + 1), ("b", 1, 0, 0)}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n。!", max_size=120), st.integers(4, 20), st.integers(0, 3))
def test_pieces(text, limit, overlap):
    p = pieces(text, limit, overlap)
    if not text:
        assert p == []
        return
    assert p[0][0] == 0 and p[-1][1] == len(text) and all(0 < b - a <= limit for a, b, _ in p)
    assert all(y[0] == x[1] - overlap for x, y in zip(p, p[1:]))


def test_strongest_and_rightmost_cut():
    t = "aaaa. bb cc\n\ndd ee ff gg hh ii"
    assert [t[a:b] for a, b, _ in pieces(t, 16, 0)][0].rstrip() == "aaaa. bb cc"
    assert pieces("aa bb cc dd", 8, 0)[0][1] == 6 or pieces("aa bb cc dd", 8, 0)[0][1] in (5, 6, 8)


def test_cut_kind_and_rows(spark):
    assert cut_kind("x" * 4001) == "forced" and cut_kind("x" * 4000 + " y") == "natural"
    df = spark.createDataFrame([("a", "x" * 4001), ("b", "ab " * 2000), ("c", None), ("d", "short")], "paper_id string, methods_text string")
    r = split_long(df, "paper_id", "methods_text").collect()
    assert {(x.paper_id, x.cut_kind) for x in r} == {("a", "forced"), ("b", "natural")}
    assert split_long(df.limit(0), "paper_id", "methods_text").count() == 0
