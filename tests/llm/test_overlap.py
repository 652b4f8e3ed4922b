import numpy as np
import pytest

from clauseworks.llm import neardup, overlap


def test_suffix_array():
    text = np.array([3, 2, 3, 2, 1, 3, 2, 0], np.int32)
    order = overlap.suffix_array(text)
    assert order.tolist() == sorted(range(8), key=lambda k: text[k:].tolist())


def test_backward_search_finds_all_places():
    texts = ["a b c a b d", "b c a b c", "x"]
    shard = overlap.Shard([1, 2, 3], texts).ready()
    words = np.array([shard.words.get(w, 0) for w in "a b c q a b".split()])
    low, high = shard.ranges(words, 2)
    assert (high - low).tolist() == [3, 3, 0, 0, 3]
    places = sorted(shard.suffixes[low[0] : high[0]].tolist())
    assert all(shard.text[p : p + 2].tolist() == words[:2].tolist() for p in places)


def test_maximal_matches():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(0, 30)) for _ in range(2))
        want = set()
        for i in range(len(a)):
            for j in range(len(b)):
                if not (i and j and a[i - 1] == b[j - 1]):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                        k += 1
                    if k >= 3:
                        want.add((i, j, k))
        got = list(zip(*(x.tolist() for x in overlap.maximal_matches(a, b)), strict=True))
        assert len(got) == len(set(got)) and set(got) == want
    assert overlap._merged(np.array([5, 0, 8, 20]), np.array([4, 3, 2, 3])) == (3, 3 + 5 + 3)


@pytest.fixture(scope="module")
def tables():
    import random

    rng = random.Random(2)
    words = [f"w{k}" for k in range(80)]
    chunks, n = [], 0
    for doc in range(40):
        for _ in range(3):
            text = rng.choices(words, k=rng.choice([2, 8, 30, 90]))
            chunks.append((n, doc, text))
            n += 1
    for doc in range(40):
        _, _, text = chunks[rng.randrange(len(chunks))]
        text = list(text)
        text[rng.randrange(len(text))] = "new"
        chunks.append((n, doc, text if doc % 3 else list(text)))
        n += 1
    chunks = [(k, d, " ".join(t)) for k, d, t in chunks] + [(n, 1, "p q"), (n + 1, 30, "p q"), (n + 2, 2, None), (n + 3, None, "p q"), (n + 4, 99, "p q")]
    documents = [(k, f"x/{k}.txt", bytes([k % 11]) if k % 4 else None) for k in range(40)]
    return chunks, documents


@pytest.mark.parametrize("chars", [(10**7, 10**8), (700, 1500)])
def test_equals_pairs_of_near_duplicates(spark, tables, chars):
    chunks, documents = tables
    c = spark.createDataFrame(chunks + chunks[:5], "id bigint, doc_id bigint, text string").repartition(4)
    d = spark.createDataFrame(documents, "doc_id bigint, path string, hash binary")
    docs = spark.createDataFrame([(f" {k}.txt", "test") for k in range(10)] + [(None, "x")], "file string, split string")
    spans = spark.createDataFrame([("s", "c", "10.txt", 0, 1)], "span_id string, category string, file string, char_start int, char_end int")
    owner = {k: x for k, x, _ in chunks}
    want = set()
    for a, b in (tuple(r) for r in neardup.similar_pairs(c).collect()):
        x, y = sorted((owner[a], owner[b]), key=lambda v: -1 if v is None else v)
        if x is not None and y < 40 and (x <= 10) != (y <= 10):
            want.add((x, y))
    assert len(want) > 3
    got = overlap.chunk_overlaps(c, d, docs, spans, shard_chars=chars[0], round_chars=chars[1]).collect()
    assert {(r.evaluation, r.training) for r in got} == want
    assert all(r.similarity >= 0.6 for r in got)
    assert all(0 <= r.longest <= r.words for r in got)
    classes = overlap.overlap_classes(c, d, docs, spans).collect()
    assert sum(r.evaluation * r.training for r in classes) >= len(want) and all(r.training > 0 for r in classes)
    both = {tuple(r) for r in overlap.hash_overlaps(d, docs, spans).collect()}
    assert both == {(a, b) for a, _, h in documents for b, _, g in documents if h is not None and h == g and a <= 10 < b}
    counts = overlap.overlap_counts(d.selectExpr("*", "'src' AS source"), c, docs, spans).collect()
    assert sum(r.pairs for r in counts) == len(want | both) and {r.split for r in counts} <= {"test", ""}


def test_work_follows_text_and_not_text_times_shards(spark, tables, monkeypatch):
    chunks, documents = tables
    c = spark.createDataFrame(chunks, "id bigint, doc_id bigint, text string").repartition(4)
    d = spark.createDataFrame(documents, "doc_id bigint, path string, hash binary")
    docs = spark.createDataFrame([(f"{k}.txt", "test") for k in range(11)], "file string, split string")
    spans = spark.createDataFrame([], "span_id string, category string, file string, char_start int, char_end int")
    want = sorted(overlap.chunk_overlaps(c, d, docs, spans).collect())
    asked, read, plain = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), overlap.matches

    def counted(shard, texts, *more):
        asked.add(len(texts))
        return plain(shard, texts, *more)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    monkeypatch.setattr(overlap, "matches", counted)
    c = c.mapInArrow(seen, c.schema)
    got, reads = [], []
    for chars in (10**7, 10**8), (700, 1500):
        before = read.value
        got.append(sorted(overlap.chunk_overlaps(c, d, docs, spans, shard_chars=chars[0], round_chars=chars[1]).collect()))
        reads.append(read.value - before)
    assert got == [want, want] and len(want) > 3
    assert reads[0] == reads[1]
    assert asked.value < sum(x is not None and 10 < x < 40 for _, x, _ in chunks)


def test_more_texts_for_a_shard_than_a_task_takes(spark, tables, monkeypatch):
    chunks, documents = tables
    c = spark.createDataFrame(chunks + [(500 + k, 20 + k, t) for k, (_, _, t) in enumerate(chunks[:18])], "id bigint, doc_id bigint, text string").repartition(4)
    d = spark.createDataFrame(documents, "doc_id bigint, path string, hash binary")
    docs = spark.createDataFrame([(f"{k}.txt", "test") for k in range(11)], "file string, split string")
    spans = spark.createDataFrame([], "span_id string, category string, file string, char_start int, char_end int")
    want = sorted(overlap.chunk_overlaps(c, d, docs, spans).collect())
    monkeypatch.setattr(overlap, "PART", 2)
    monkeypatch.setattr(overlap, "_AT_ONCE", 7)
    monkeypatch.setattr(overlap, "FILTER_PART", 256)
    assert sorted(overlap.chunk_overlaps(c, d, docs, spans, shard_chars=2000).collect()) == want and len(want) > 18


def test_empty_tables(spark):
    c = spark.createDataFrame([], "id bigint, doc_id bigint, text string")
    d = spark.createDataFrame([], "doc_id bigint, path string, hash binary")
    docs = spark.createDataFrame([], "file string, split string")
    spans = spark.createDataFrame([], "span_id string, category string, file string, char_start int, char_end int")
    assert overlap.overlaps(d, c, docs, spans).count() == 0
