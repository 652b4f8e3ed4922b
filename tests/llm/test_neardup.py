import random
from collections import defaultdict

import pytest

from clauseworks.llm import neardup
from clauseworks.llm.forms import form_words


def _pairs(rows, threshold=0.6):
    once = dict(rows)
    sets = {k: {tuple(w[i : i + 3]) for w in [form_words(t)] for i in range(len(w) - 2)} for k, t in once.items() if k is not None and t is not None}
    ids = sorted(sets)
    near = lambda a, b: once[a] == once[b] if not sets[a] or not sets[b] else len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold - 1e-12
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if near(a, b)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    out = []
    for family in range(25):
        base = rng.choices(words, k=rng.choice([3, 5, 12, 30, 80, 150]))
        for _ in range(6):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(text) // 10) + 1)):
                k = rng.randrange(len(text))
                text[k : k + rng.randrange(2)] = rng.choices(words, k=rng.randrange(2))
            out.append((len(out), " ".join(text)))
    out += [(900, "a b"), (901, "a b"), (902, "A b"), (903, ""), (904, ""), (905, None), (None, "x y z"), (906, "Ｗ1  w2 w3 w4"), (907, "w1 w2 w3 w4")]
    return out + out[:10]


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "id bigint, text string, class string").repartition(5)
    got = [tuple(r) for r in neardup.similar_pairs(df).collect()]
    want = _pairs(rows)
    assert len(want) > 100 and set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("threshold", [0.04, 0.3, 0.9])
def test_other_thresholds(spark, rows, threshold):
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {tuple(r) for r in neardup.similar_pairs(df, threshold=threshold).collect()}
    assert got == _pairs(rows, threshold)


def test_the_byte_is_part_of_the_key():
    import numpy as np

    hashes = np.array([0x1234567801, 0x1234567802], np.uint64)
    texts = np.array([7, 8]), np.array([10, 10]), np.zeros((2, 4), np.uint64)
    bucket = neardup._Bucket(0.6)
    assert not list(bucket.add(neardup._pack(hashes, np.array([0, 0]), np.array([0, 1]), *texts)))
    assert sum(b.num_rows for b in bucket.finish()) == 0


def _tallied(blobs, threshold=0.6):
    """What buckets and the blocks they pass on tally together, and the largest block."""
    import pyarrow as pa

    tally, blocks = defaultdict(int), defaultdict(dict)
    bucket = neardup._Bucket(threshold)
    batches = [b for blob in blobs for b in bucket.add(blob)] + list(bucket.finish())
    for b in batches:
        if b.num_rows and b.column(6)[0].as_py() is not None:
            blocks[b.column(4)[0].as_py()][b.column(5)[0].as_py()] = b.column(6)[0].as_py()
    for own in blocks.values():
        assert sorted(own) == list(range(len(own)))
        for i in own:
            for j in range(i, len(own)):
                batches += neardup._paired_blocks(pa.table({"entries": pa.array([own[i]] + [own[j]] * (j > i), pa.binary())}), threshold).to_batches()
    for b in batches:
        for x, y, n in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
            if x is not None:
                tally[x, y] += n
    return dict(tally), [len(neardup._unpack(e)[0]) for own in blocks.values() for e in own.values()]


def test_hot_keys_are_passed_on_in_blocks(spark, rows, monkeypatch):
    texts = neardup._keyed(spark.createDataFrame(rows, "id bigint, text string"), "id", "text")
    sketch = neardup._sketch(neardup._sets(texts, 3))
    blobs = [bytes(r.entries) for r in neardup._entries(texts, sketch, 0.6, 3, 1).collect()]
    want, none = _tallied(blobs)
    assert want and not none
    for hot, held in ((2, 10**9), (2, 5), (3, 50)):
        monkeypatch.setattr(neardup, "HOT", hot)
        monkeypatch.setattr(neardup, "MOST_HELD", held)
        got, blocks = _tallied(blobs)
        assert got == want and blocks and max(blocks) <= hot


def test_one_key_of_200_000_entries_is_never_held_whole(monkeypatch):
    import tracemalloc

    import numpy as np

    monkeypatch.setattr(neardup, "MOST_HELD", 20_000)
    bucket, sizes = neardup._Bucket(0.6), []
    tracemalloc.start()
    for k in range(100):
        n = 2000
        blob = neardup._pack(np.full(n, 77, np.uint64), np.zeros(n, np.int64), np.arange(n), np.arange(n) + k * n, np.full(n, 30), np.zeros((n, 4), np.uint64))
        sizes += [len(neardup._unpack(b.column(6)[0].as_py())[0]) for b in bucket.add(blob) if b.column(6)[0].as_py() is not None]
        assert bucket.number <= 22_000
    sizes += [len(neardup._unpack(b.column(6)[0].as_py())[0]) for b in bucket.finish() if b.num_rows]
    assert sum(sizes) == 200_000 and max(sizes) <= neardup.HOT and tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_sketches_add_up_in_a_tree(spark, rows, monkeypatch):
    import numpy as np

    texts = neardup._keyed(spark.createDataFrame(rows, "id bigint, text string").repartition(9), "id", "text")
    plain = neardup._sketch(neardup._sets(texts, 3))
    monkeypatch.setattr(neardup, "FAN_IN", 2)
    assert np.array_equal(plain, neardup._sketch(neardup._sets(texts, 3))) and plain.sum() > 0


def test_groups(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, text string")
    parent = {k: k for k, t in rows if k is not None and t is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in _pairs(rows):
        parent[root(a)] = root(b)
    groups = defaultdict(set)
    for r in neardup.similar_groups(df).collect():
        groups[r.group].add(r.id)
    want = defaultdict(set)
    for k in parent:
        want[root(k)].add(k)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.group for r in neardup.components(edges).collect()}
    assert {got[k] for k in range(1, 61)} == {1} and got[101] == 100


def test_empty_table(spark):
    assert neardup.similar_pairs(spark.createDataFrame([], "id bigint, text string")).count() == 0
    assert neardup.similar_groups(spark.createDataFrame([(1, None)], "id bigint, text string")).count() == 0


def test_many_copies(spark):
    df = spark.range(300).selectExpr("id", "if(id < 100, 'the same old clause again and again', concat('clause ', id, ' of ', id * 7, ' words ', id * 13)) AS text")
    assert neardup.similar_pairs(df).count() == 100 * 99 // 2


def test_very_long_texts(spark):
    import numpy as np

    words = [f"w{k}" for k in np.random.default_rng(0).integers(0, 5000, 60_000)]
    other = list(words)
    other[::40] = ["new"] * len(other[::40])
    far = list(words)
    far[::5] = ["new"] * len(far[::5])
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(far))], "id bigint, text string")
    assert [tuple(r) for r in neardup.similar_pairs(df).collect()] == [(1, 2)]
