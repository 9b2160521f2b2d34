import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from evigraph.llm.sentences import sentence_units, units


def cut(text, lang=None):
    return [text[a:b] for a, b in units(text, lang)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("", []),
        (" \n\t", []),
        ("One. Two.", ["One.", "Two."]),
        ("Cells (n = 3) grew. They died.[4] We left.7 End", ["Cells (n = 3) grew.", "They died.[4]", "We left.7", "End"]),
        ("Mice were weighed at 12 p.m. Monday and then returned. It stopped at 5 p.m. As in ref. 4, yes.", ["Mice were weighed at 12 p.m. Monday and then returned.", "It stopped at 5 p.m.", "As in ref. 4, yes."]),
        ('We asked: "Does it bind?" Cells were fine. "Stop!" was called once.', ['We asked: "Does it bind?"', "Cells were fine.", '"Stop!" was called once.']),
        ('The label read "Do not freeze. Keep dry." and was left.', ['The label read "Do not freeze. Keep dry." and was left.']),
        ("Is n = 7 enough? asked one rater; we think so. pH was 7.", ["Is n = 7 enough? asked one rater; we think so.", "pH was 7."]),
        ("It was on ice.Then it used .5 mg at p<.01 after all.", ["It was on ice.", "Then it used .5 mg at p<.01 after all."]),
        ("2.3 Imaging\n\nImages were taken with a\nmicroscope. Fine.\n• spin at 9 × g\n• wash", ["2.3 Imaging", "Images were taken with a\nmicroscope.", "Fine.", "• spin at 9 × g", "• wash"]),
        ("Am 6.4.2017 wurde die 2. Charge geöffnet, z. B. nach Nr. 2. Laut Protokoll gilt das.", ["Am 6.4.2017 wurde die 2. Charge geöffnet, z. B. nach Nr. 2.", "Laut Protokoll gilt das."]),
        ("L’étiquette portait « Ne pas congeler. Garder au sec. » et fut conservée. Attendre 3 min !", ["L’étiquette portait « Ne pas congeler. Garder au sec. » et fut conservée.", "Attendre 3 min !"]),
        ("¿Se cambió? Según el Dr. Rupel, EE. UU. aportó 4 muestras, núm. 5. Fin.", ["¿Se cambió?", "Según el Dr. Rupel, EE. UU. aportó 4 muestras, núm. 5.", "Fin."]),
        ("«Готово ли?» – спросил проф. Rin. В 2009 г. измерения повторили, т. е. дважды.", ["«Готово ли?» – спросил проф. Rin.", "В 2009 г. измерения повторили, т. е. дважды."]),
        ("操作员写道：“信号消失。”所有实验重复9次．“样品是否合格？”审核员问道。", ["操作员写道：“信号消失。”", "所有实验重复9次．", "“样品是否合格？”审核员问道。"]),
        ("担当者は「信号は消えた。」と述べた。（詳細は図143を参照。）Mok et al.の方法に従った｡", ["担当者は「信号は消えた。」と述べた。", "（詳細は図143を参照。）", "Mok et al.の方法に従った｡"]),
        ("डॉ. Zem ने देखा। क्या यह हुआ? हाँ|", ["डॉ. Zem ने देखा।", "क्या यह हुआ?", "हाँ|"]),
        ("การวัดทำซ้ำสองครั้ง ปริมาตรคือ7.19มล.ต่อหลอด\nตัวอ่อนถูกคัด", ["การวัดทำซ้ำสองครั้ง", "ปริมาตรคือ7.19มล.ต่อหลอด", "ตัวอ่อนถูกคัด"]),
    ],
)
def test_units(text, want):
    assert cut(text) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB .!?\n\"“”()[]1。」「…|é-", max_size=80))
def test_units_cover_all_but_white_space(text):
    at = 0
    for a, b in units(text):
        assert at <= a < b and not text[at:a].strip() and text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()


def test_rows(spark):
    df = spark.createDataFrame([("a", "One. Two.", "en", 1), ("b", None, None, 1), ("c", "  ", "x", 1)], "paper_id string, methods_text string, lang string, sentence_no int")
    got = sentence_units(df, "paper_id", "methods_text", "lang")
    assert {tuple(r) for r in got.collect()} == {("a", 0, 0, 4), ("a", 1, 5, 9)}
    assert sentence_units(df.limit(0), "paper_id", "methods_text").count() == 0
    assert len(units("A sentence. " * 20_000)) == 20_000


def test_every_terminator_ends_a_sentence():
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and regex.match(r"\p{Sentence_Terminal}", chr(c))]
    assert len(marks) > 150
    assert [m for m in marks if cut(f"Aaaa bbb{m} Cccc dd{m}") != [f"Aaaa bbb{m}", f"Cccc dd{m}"]] == []


def test_brackets_and_numerals():
    assert cut("It was p < .060. (All were cold.) Then No. 6.\n(Group 7) The probe.") == ["It was p < .060.", "(All were cold.)", "Then No. 6.", "(Group 7) The probe."]
    assert cut("From Nord Corp. (Ulfstad). It had DNase I. Then M. I. Smith left.") == ["From Nord Corp. (Ulfstad).", "It had DNase I.", "Then M. I. Smith left."]
