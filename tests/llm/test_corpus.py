import numpy as np
import pytest
from oracle import rows_of, sql_rows, view_connection

from evigraph.llm import encoding, mix
from evigraph.llm import queries as Q
from evigraph.llm.langid import canonical_lang, detect


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, small, name):
    got, cols = rows_of(Q.queries()[name](spark, small))
    sql = Q.oracle_sql().get(name)
    if sql:
        want, names = sql_rows(view_connection(small), sql)
        assert cols == names and got == want
    assert cols


def test_language():
    assert detect("The cells were washed and the buffer was kept.") == "en"
    assert detect("Die Proben wurden mit dem Puffer gewaschen und nicht erwärmt.", "en") == "de"
    assert [detect(x) for x in ("样品被弃去", "試料は切片である", "Срезы промывали", "ऊतक को धोया", "เซลล์ถูกล้าง", "", None)] == ["zh", "ja", "ru", "hi", "th", "und", "und"]
    assert [canonical_lang(x) for x in ("de-DE", "zh_CN", "eng", "und", None, "EN ")] == ["de", "zh", "en", None, None, "en"]


CLEAN = {
    "en": "Gradients were cooled to 37 °C in both groups – a step we tested twice. Beads of 2 µm were used.",
    "fr": "Les échantillons ont été lavés à 4 °C pendant 36 min. Le débit a été réglé à l’aide du logiciel.",
    "de": "Größere Stücke wurden für 20 min gekühlt und Überstände geprüft. Für die Prüfung gilt das Übliche.",
    "ru": "Образцы инкубировали при 37 °C в течение часа. Срезы трижды промывали и заключали в среду.",
    "ja": "組織を冷たい緩衝液で洗浄し、氷上に置いた。測定はすべて盲検で行った。",
    "zh": "样品在室温下孵育七分钟。所有测量均采用盲法进行。",
}


MEANT = "Error scales with √n; ∞ and ≈ are used, © the lab."


@pytest.fixture(scope="module")
def model():
    return encoding.Model(encoding.trained([t for t in (*CLEAN.values(), MEANT) for _ in range(12)]))


def garble(text, right, wrong):
    return text.encode(right).decode(wrong, errors="strict")


@pytest.mark.parametrize("lang,right,wrong", [("fr", "utf-8", "latin-1"), ("en", "utf-8", "mac_roman"), ("de", "utf-8", "cp437"), ("de", "utf-8", "latin-1"), ("ru", "cp1251", "latin-1"), ("ru", "koi8-r", "cp1251"), ("ru", "cp866", "latin-1"), ("zh", "gb18030", "latin-1"), ("ja", "euc_jp", "latin-1")])
def test_restores(model, lang, right, wrong):
    text = CLEAN[lang].replace("°", "") if lang == "ru" and right != "utf-8" else CLEAN[lang]
    bad = garble(text, right, wrong)
    fixed, chain, lost = encoding.restore(bad, model)
    assert fixed == text and chain and not lost


def test_double_and_partial(model):
    t = CLEAN["fr"]
    bad = garble(garble(t, "utf-8", "latin-1"), "utf-8", "latin-1")
    assert encoding.restore(bad, model)[0] == t
    mixed = CLEAN["en"] + " " + garble(t, "utf-8", "latin-1")
    assert encoding.restore(mixed, model)[0] == CLEAN["en"] + " " + t


@pytest.mark.parametrize("right,wrong", [("cp1252", "mac_roman"), ("cp1252", "cp1250")])
def test_latin_confusions_are_tried_whatever_letters_they_give(right, wrong):
    text = "Después, los tejidos se lavaron en una solución fría." if wrong == "mac_roman" else "Los años de la muestra."
    assert text in {out for _, out, _, _ in encoding.chains(text.encode(right).decode(wrong), frozenset("áéíóúñü"))}


@pytest.mark.parametrize("text", [*CLEAN.values(), "", None, "ascii", MEANT, "O ensaio começou de MANHÃ, COM SÃO registo.", "Ã/Â ratio: the author's own.", "Table: ├─ a └─ c", "👩‍🔬 done"])
def test_meant_characters_are_no_case(model, text):
    assert encoding.restore(text, model) == (text, [], False)


def test_lost_originals_are_found(model):
    assert encoding.restore("kept at 4 �C", model)[2] and encoding.restore("a\x9db", model)[2]


def test_find_on_tables(spark):
    rows = [(i, t) for i, t in enumerate([*CLEAN.values()] * 10)] + [(900, garble(CLEAN["fr"], "utf-8", "latin-1")), (901, None), (902, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in encoding.find_garbled(df).collect()] == [900]
    assert encoding.find_garbled(df.limit(0)).count() == 0


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "word " * int(rng.integers(5, 60)), ["big", "mid ", "Tiny"][0 if i < 300 else 1 if i < 380 else 2]) for i in range(400)]
    rows += [(1000, None, "big"), (1001, "", "mid"), (1002, "word word", None), (1003, "word", "other"), (0, rows[0][1], "big")]
    t = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    m = mix.mix(docs(spark, rows), t)
    s = {r.source: r for r in mix.shares(m, t).collect()}
    for name, share in (("big", 0.5 / 0.9), ("mid", 0.3 / 0.9), ("tiny", 0.1 / 0.9)):
        assert abs(s[name].reached_share - share) < 0.02 * share + 0.003
    assert s["none"].n_tokens == 0 and s["big"].most_copies <= 2 and s["mid"].most_copies <= 2 and s["tiny"].most_copies <= 4
    ids = [r.doc_id for r in m.collect()]
    assert len(ids) == len(set(ids)) and not {1000, 1001, 1003} & set(ids)


def test_mix_without_anything(spark):
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert mix.mix(docs(spark, [(1, "x", "b")]), t).count() == 0
    assert mix.mix(docs(spark, [(1, "x", "b")]).limit(0), t).count() == 0


def test_classifier_on_held_out_rows():
    rows = [("a", f"alpha beta {i} gamma") for i in range(60)] + [("b", f"delta epsilon {i} zeta") for i in range(60)]
    c = mix.Classifier(rows[::2])
    hit = sum(c.labels[int(c.posterior(t).argmax())] == s for s, t in rows[1::2])
    assert hit >= 0.95 * len(rows[1::2]) and abs(c.posterior("").sum() - 1) < 1e-9
