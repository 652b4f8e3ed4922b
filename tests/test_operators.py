import random
from math import log

import pytest
from pyspark.sql import functions as F

from clauseworks.functions import stats, vectors
from clauseworks.operators import chunking, evaluation, retrieval, tables
from clauseworks.operators.chunking import ChunkConfig


def test_overlap_must_be_less_than_the_size():
    with pytest.raises(ValueError):
        ChunkConfig(40, 40)


def test_windows():
    assert chunking.windows(10, 4, 1) == [(0, 4), (3, 7), (6, 10)]
    assert chunking.windows(4, 4, 1) == [(0, 4)]


def test_packing():
    text = "one two three\n\nfour five six\n\nseven"
    got = [text[s:e] for s, e in chunking.chunk_text(text, ChunkConfig(7, 1))]
    assert got == [text]
    got = [text[s:e] for s, e in chunking.chunk_text(text, ChunkConfig(6, 1))]
    assert got == ["one two three\n\nfour five six", "seven"]


def test_a_long_unit_stands_alone():
    text = "a b\n\n" + " ".join(map(str, range(10))) + "\n\nc"
    got = [text[s:e] for s, e in chunking.chunk_text(text, ChunkConfig(4, 1))]
    assert got == ["a b", "0 1 2 3", "3 4 5 6", "6 7 8 9", "c"]


@pytest.mark.parametrize("size,overlap", [(5, 0), (20, 3), (200, 40)])
def test_chunks_hold_every_word(size, overlap):
    rng = random.Random(size)
    text = "\n\n".join("\n".join(f"{rng.choice(['', '(a) ', '1.2 '])}" + " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 40))) for _ in range(3)) for _ in range(8))
    spans = chunking.chunk_text(text, ChunkConfig(size, overlap))
    covered = set()
    for s, e in spans:
        assert len(text[s:e].split()) <= size
        covered.update(range(s, e))
    assert all(text[k].isspace() for k in range(len(text)) if k not in covered)


def test_units_of_columns_and_of_python_agree(spark):
    texts = ["a\nb\n\nc", "(a) x\n(b) y\nz", "1. q\nSection 2\nw", "", "only", "(a)\nnext", "v. ACME x\nSection 3 lower"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in chunking.units(rows).orderBy("doc_id", "unit").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {k: [t[s:e] for s, e in chunking.split_units(t)] for k, t in enumerate(texts) if t}


def test_null_and_empty_texts_give_no_chunks(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "a")], "doc_id bigint, text string").withColumn("ord", F.lit(9))
    assert [r.doc_id for r in chunking.chunk_documents(rows).collect()] == [4]
    assert [r.doc_id for r in chunking.word_windows(rows).collect()] == [4]


CHUNKS = [(0, "the licensee pays royalties"), (1, "the licensor pays"), (2, "termination of the agreement"), (3, None)]


def _rank(spark, query, stems):
    chunks = spark.createDataFrame(CHUNKS, "id bigint, text string")
    asked = spark.createDataFrame([("q", query)], "query_id string, text string")
    return [(r.id, r.score) for r in retrieval.ranked(retrieval.bm25(chunks, asked, stems=stems)).orderBy("rank").collect()]


def test_bm25_value(spark):
    (only,) = _rank(spark, "royalties", False)
    n, df, length, mean = 4, 1, 4, 11 / 4
    want = log(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / mean))
    assert only == (0, pytest.approx(want, abs=1e-8))


def test_bm25_stems_and_ignores_what_shares_no_term(spark):
    assert [k for k, _ in _rank(spark, "terminated", True)] == [2]
    assert _rank(spark, "terminated", False) == []
    assert _rank(spark, "zebra", True) == []


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([("q", 7, 1), ("q", 8, 2)], "query_id string, id bigint, rank int")
    b = spark.createDataFrame([("q", 7, 1), ("q", 9, 2)], "query_id string, id bigint, rank int")
    got = {r.id: r.score for r in retrieval.fused([a, b], 60).collect()}
    assert got == {7: pytest.approx(2 / 61), 8: pytest.approx(1 / 62), 9: pytest.approx(1 / 62)}
    assert [r.id for r in retrieval.ranked(retrieval.fused([a, b], 60)).orderBy("rank").collect()] == [7, 8, 9]


def test_search_equals_full_sort(spark):
    rng = random.Random(3)
    data = [(k, [rng.choice([-1.0, 0.5, 1.0]) for _ in range(4)]) for k in range(300)]
    data += [(400, None), (401, [1.0]), (402, [0.0] * 4), (403, [float("nan")] * 4), data[5]]
    rows = spark.createDataFrame(data, "id bigint, vec array<float>").repartition(3)
    q = [0.3, -0.2, 0.9, 0.1]
    got = [(r.id, round(r.score, 6)) for r in vectors.top(vectors.search(rows, [("q", q)], 20, "id", "vec", 4), 20).orderBy("rank").collect()]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    full = sorted(((k, round(sum(a * b for a, b in zip(q, v, strict=True)) / norm(q) / norm(v), 9)) for k, v in data[:300]), key=lambda x: (-x[1], x[0]))
    assert got == [(k, round(s, 6)) for k, s in full[:20]]
    assert vectors.top(vectors.search(rows, [("q", q)], 0, "id", "vec", 4), 0).count() == 0


def _judge(spark, chunks, spans):
    c = spark.createDataFrame([(k, 1, s, e) for k, (s, e) in enumerate(chunks)], "id bigint, doc_id bigint, char_start int, char_end int")
    p = spark.createDataFrame([("c", 1, s, e) for s, e in spans], "category string, doc_id bigint, s int, e int")
    q = spark.createDataFrame([("q", "c")], "id string, category string")
    return sorted(r.chunk_id for r in evaluation.judged(c, p, q).collect())


def test_relevance(spark):
    assert _judge(spark, [(100, 110)], [(105, 200)]) == [0]
    assert _judge(spark, [(100, 110)], [(106, 200)]) == []
    assert _judge(spark, [(0, 1000)], [(5, 9)]) == [0]
    # touching spans are one, which covers half but is no whole of either
    assert _judge(spark, [(10, 20)], [(5, 12), (12, 15)]) == [0]
    assert _judge(spark, [(7, 7)], [(0, 20)]) == []


def test_merged(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 2, 3), (1, 9, 12), (2, 1, 2)], "k int, s int, e int")
    assert sorted(map(tuple, evaluation.merged(rows, ["k"]).collect())) == [(1, 0, 8), (1, 9, 12), (2, 1, 2)]


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("m", "a", k, k) for k in range(1, 4)], "method string, query_id string, id bigint, rank int")
    qrels = spark.createDataFrame([("a", 2), ("a", 3)], "query_id string, chunk_id bigint")
    queries = spark.createDataFrame([("a", "matched"), ("b", "matched")], "id string, kind string")
    scores = {r.query_id: r for r in evaluation.metrics(run, qrels, queries).collect()}
    assert (round(scores["a"].ndcg, 4), scores["a"].mrr, scores["a"].r_precision) == (0.6934, 0.5, 0.5)
    assert (scores["b"].ndcg, scores["b"].mrr, scores["b"].r_precision) == (0.0, 0.0, 0.0)
    means = {r.kind: r for r in evaluation.group_means(evaluation.metrics(run, qrels, queries), queries).collect()}
    assert means["all"].queries == 2 and means["all"].mrr == 0.25


def test_signed_rank_test(spark):
    rows = [(m, f"q{k}", v) for k, (a, b) in enumerate([(0.5, 0.1), (0.3, 0.3), (0.2, 0.4), (0.9, 0.5), (0.7, 0.6)]) for m, v in (("x", a), ("y", b))]
    scores = spark.createDataFrame(rows, "method string, query_id string, ndcg double")
    (r,) = evaluation.signed_ranks(scores, [("x", "y")]).collect()
    assert (r.n, r.w_plus, r.w_minus, r.ties) == (4, 8.0, 2.0, 6.0)
    assert stats.wilcoxon_p(4, 8.0, 2.0, 6.0) == pytest.approx(0.2693, abs=1e-3)
    assert stats.wilcoxon_p(0, 0, 0, 0) is None
    assert stats.sign_test_p(5, 0) == pytest.approx(0.0625)
    assert stats.nearest_rank([5, 1, 4, 2, 3], 0.95) == 5


def test_cross_validation_takes_the_first_on_ties(spark):
    rows = [(s, p, q, 1.0) for p, s in enumerate(["b", "a"]) for q in ("A1", "B1")]
    scores = spark.createDataFrame(rows, "setting string, position int, query_id string, ndcg double")
    assert {r.setting for r in evaluation.cross_validated(scores, F.substring("query_id", 1, 1)).collect()} == {"b"}


def test_numbers_are_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7)
    got = tables.numbered(rows, ["x"], "n").collect()
    assert all(r.x == r.n for r in got) and len(got) == 1000
    assert tables.numbered(rows.where("x < 0"), ["x"], "n").count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id bigint, text string")
    asked = spark.createDataFrame([("q", "x")], "query_id string, text string")
    assert retrieval.ranked(retrieval.bm25(none, asked)).count() == 0
    assert vectors.top(vectors.search(spark.createDataFrame([], "id bigint, vec array<float>"), [("q", [1.0])], 3, "id", "vec", 1), 3).count() == 0


def test_query_syntax():
    parse = lambda q: retrieval.parse_query(q, stems=False)
    assert parse('rent "due date" non-compete') == [("should", ("rent",)), ("should", ("due", "date")), ("should", ("non", "compete"))]
    assert parse("+a -b c AND d OR e") == [("must", ("a",)), ("not", ("b",)), ("must", ("c",)), ("must", ("d",)), ("should", ("e",))]
    assert parse('"section 5: (x') == [("should", ("section",)), ("should", ("5",)), ("should", ("x",))]
    assert parse("") == parse(' - "" ()') == []


def test_phrases_demands_and_exclusions(spark):
    texts = ["non compete clause", "compete or non", "clause only", "royalty fee", "other", "royalty fee", None]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")

    def ids(query):
        return [r.id for r in retrieval.ranked(retrieval.bm25_parsed(chunks, [("q", query)])).orderBy("rank").collect()]

    assert ids("non-compete") == [0]
    assert ids("compete") == [0, 1]
    assert ids("+clause -only") == [0]
    assert ids("clause AND royalty") == []
    assert ids("-only") == []
    assert ids("royalties") == [3, 5]
    assert set(ids('"clause fee')) == {0, 2, 3, 5}
    plain = spark.createDataFrame([("q", "royalty clause clause")], "query_id string, text string")
    a = {r.id: r.score for r in retrieval.bm25(chunks, plain, stems=True).collect()}
    b = {r.id: r.score for r in retrieval.bm25_parsed(chunks, [("q", "royalty clause clause")]).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
