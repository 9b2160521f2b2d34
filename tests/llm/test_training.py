"""Dictionaries and alphabets of problem 10 come from all clean texts."""

from evigraph.llm import encoding


def test_every_document_counts(spark):
    # one character of its own in each of 6,000 texts, and one beyond 20,000 code points
    rows = [(i, "样品在室温下孵育" + chr(0x4E00 + i) + "分钟。") for i in range(6_000)] + [(6_000, "样品。" * 7_000 + "龠")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = encoding.train(df.repartition(5))
    assert {*map(chr, range(0x4E00, 0x4E00 + 6_000)), "龠"} <= model["zh"][1]
    assert model == encoding.train(df.repartition(2)) == encoding.trained([t for _, t in rows])


def test_words_worth_most_by_all_counts_make_the_dictionary(spark):
    # in Latin script: rare words would fill more than a dictionary; the frequent one stands in late rows only
    rows = [(i, f"The cells of {'abcdefghij'[i % 10] * 3}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}lin were kept.") for i in range(9_000)]
    rows += [(9_000 + i, f"The façade of lot {i} was cleaned with the Überstand.") for i in range(300)]
    table = {}
    for lang, w, n, _, _ in encoding.words([t for _, t in rows], {"en": frozenset("çÜ")}):
        table[w] = table.get(w, 0) + n
    assert table["façade"] == 300 and table["The"] == 9_300
    model = encoding.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert model["en"][1] == frozenset("çÜ") and "façade".encode() in model["en"][0] and sum(map(len, table)) > encoding.DICTIONARY > 0.9 * encoding.DICTIONARY < len(model["en"][0])


def test_a_letter_where_another_one_nearly_always_stands_is_no_model():
    assert encoding.betraying({"é": 40, "È": 2}) == ["È"]
    assert encoding.betraying({"а": 40, "е": 35, "и": 3}) == [] and encoding.betraying({"é": 6, "È": 1}) == []
    texts = ["Les échantillons ont été lavés avec le tampon."] * 60 + ["Les Èchantillons ont été lavés avec le tampon. Voilà È."] * 2 + ["Les tubes sont à È et au froid dans une boîte."]
    data = encoding.trained(texts)["fr"][0]
    assert " échantillons".encode() in data and "Èchantillons".encode() not in data
