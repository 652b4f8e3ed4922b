import random

from clauseworks.llm import leaks
from clauseworks.llm.forms import form_words


def _run(spark, texts, items, **more):
    t = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    i = spark.createDataFrame(items, "item string, text string")
    return leaks.leaks(t, i, **more)


def test_equals_brute_force_in_any_number_of_blocks(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(12)]
    items = [(f"i{k}", " ".join(rng.choices(words, k=rng.randrange(5, 40)))) for k in range(40)]
    texts = []
    for k in range(60):
        text = rng.choices(words, k=30)
        own = items[rng.randrange(40)][1].split()
        at, n = rng.randrange(len(own)), rng.choice([8, 9, 10, 11, 14])
        text[rng.randrange(30) : 0] = own[at : at + n]
        texts.append((k, " ".join(text)))
    runs = {}
    for name, text in items:
        w = form_words(text)
        for k in range(len(w) - 9):
            runs.setdefault(tuple(w[k : k + 10]), set()).add(name)
    want = {(name, d) for d, text in texts for w in [form_words(text)] for k in range(len(w) - 9) for name in runs.get(tuple(w[k : k + 10]), ())}
    assert len(want) > 10
    for most in (10**6, 100):
        assert {tuple(r) for r in _run(spark, texts, items, most_words=most).collect()} == want


TEN = "one two three four five six seven eight nine ten"


def test_forms_and_places(spark):
    text = f"Before.  ＯＮＥ two,\nthr​ee four fivе six seven eight nine TEN after"
    rows = _run(spark, [(1, text), (2, TEN.replace("ten", "eleven")), (3, None), (4, "")], [("a", TEN), ("b", "one two"), ("c", None)], places=True).collect()
    assert [(r.item, r.doc_id) for r in rows] == [("a", 1)]
    assert text[rows[0].char_start : rows[0].char_end] == text[9 : text.index(" after")]


def test_repeated_rows_and_empty_tables(spark):
    assert _run(spark, [(1, TEN), (1, TEN)], [("a", TEN), ("a", TEN), ("b", "x " + TEN)]).count() == 2
    assert _run(spark, [], [("a", TEN)]).count() == 0
    assert _run(spark, [(1, TEN)], []).count() == 0


def test_items_of_spans_and_training_documents(spark):
    documents = spark.createDataFrame([(1, "x/test.txt", TEN + " and more"), (2, "y/train.txt", "So " + TEN), (3, None, TEN), (4, "z/named.txt", TEN)], "doc_id bigint, path string, text string")
    docs = spark.createDataFrame([(" test.txt ", "test"), (None, "test"), ("gone.txt", "valid")], "file string, split string")
    spans = spark.createDataFrame([("s1", "c", "test.txt", 0, 48), ("s1", "c", "test.txt", 0, 48), ("s2", "c", "test.txt", 9, 9), ("s3", None, "named.txt", 0, 9999), ("s4", "c", "gone.txt", 0, 50), ("s5", "c", None, 0, 9), ("s6", "c", "test.txt", None, 9)], "span_id string, category string, file string, char_start int, char_end int")
    queries = spark.createDataFrame([("q", "zero " + TEN, 1), (None, TEN, 1)], "id string, text string, item int")
    got = {tuple(r) for r in leaks.leaked_items(documents, queries, docs, spans).collect()}
    assert got == {(i, d) for i in ("s1", "s3", "q") for d in (2, 3)}


def test_very_long_texts_and_ties(spark):
    long = "word " * 200_000
    got = _run(spark, [(1, long + TEN), (2, long)], [("a", TEN), ("b", TEN), ("c", "other " + TEN + " " + "z " * 50_000)]).collect()
    assert {tuple(r) for r in got} == {("a", 1), ("b", 1), ("c", 1)}
