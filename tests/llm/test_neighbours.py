import numpy as np
import pytest

from clauseworks.llm import neighbours


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(30, 64))
    x = (centre[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 64))).astype(np.float32)
    for k in range(0, 400, 2):
        x[k + 1] = x[k] * 3 + rng.normal(size=64) * 0.2
    x[500:530] = x[500]
    return x


def _exact(x, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), s.shape), -s), axis=1)[:, :k]
    return s, order


def _frame(spark, x):
    bad = [(9000, None), (9001, [1.0]), (9002, [0.0] * 64), (9003, [float("nan")] + [1.0] * 63), (None, x[0].tolist()), (0, x[0].tolist())]
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + bad, "chunk_id bigint, vec array<float>").repartition(4)


def test_near_pairs_are_exact(spark, data, monkeypatch):
    s, order = _exact(data, 10)
    want = {(min(a, b), max(a, b)) for a in range(len(data)) for b in order[a].tolist() if s[a, b] >= 0.9}
    got = [tuple(r) for r in neighbours.near_pairs(_frame(spark, data)).collect()]
    assert len(want) > 300 and set(got) == want and len(got) == len(want)


def test_recall(spark, data):
    _, order = _exact(data, 10)
    got = {}
    for r in neighbours.nearest(_frame(spark, data), every=50).collect():
        got.setdefault(r.id, set()).add(r.near)
    assert set(got) == set(range(0, 3000, 50)) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(got[q] & set(order[q].tolist())) / 10 for q in got if not 500 <= q < 530]) >= 0.9


def test_parallel_error_weighs_more(data):
    rng = np.random.default_rng(0)
    x = neighbours._unit(data.astype(float)).astype(np.float32)
    books = neighbours.codebooks(x, x, rng)
    codes = neighbours.encode(x, x, books)
    back = np.take_along_axis(books[None], codes[:, :, None, None].astype(int), 2).reshape(len(x), 64)
    q = x[:200]
    assert np.allclose(neighbours.scan(q, codes, books), q @ back.T, atol=1e-3)
    plain = neighbours.encode(x, x, books, passes=0)
    flat = np.take_along_axis(books[None], plain[:, :, None, None].astype(int), 2).reshape(len(x), 64)
    along = lambda b: np.abs(((x - b) * x).sum(axis=1)).mean()
    assert along(back) < along(flat)


def test_few_vectors(spark):
    none = spark.createDataFrame([], "chunk_id bigint, vec array<float>")
    assert neighbours.nearest(none).count() == 0
    one = spark.createDataFrame([(1, [1.0] * 64)], "chunk_id bigint, vec array<float>")
    assert neighbours.near_pairs(one).count() == 0
    two = spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64), (3, [1.0] * 64)], "chunk_id bigint, vec array<float>")
    assert sorted(map(tuple, neighbours.near_pairs(two).collect())) == [(1, 2), (1, 3), (2, 3)]


@pytest.fixture(scope="module")
def loose():
    """Vectors in no clusters, with partners at a cosine of about 0.9."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12_000, 64)).astype(np.float32)
    x[1::40] = x[0::40] + rng.normal(size=(300, 64)) * 0.45
    return x


def test_unclustered_recall(spark, loose):
    _, order = _exact(loose, 10)
    got = {}
    for r in neighbours.nearest(_frame(spark, loose), every=50, cell=200).collect():
        got.setdefault(r.id, set()).add(r.near)
    assert np.mean([len(got[q] & set(order[q].tolist())) / 10 for q in got]) >= 0.9


def test_unclustered_pairs(spark, loose):
    s, order = _exact(loose, 10)
    want = {(min(a, b), max(a, b)) for a in range(len(loose)) for b in order[a].tolist() if s[a, b] >= 0.9}
    got = {tuple(r) for r in neighbours.near_pairs(_frame(spark, loose)).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.99 * len(want)


def _wanted(x, order):
    return {(q, n) for q in range(0, len(x), 50) for n in order[q].tolist()}


@pytest.mark.parametrize("least", [None, 0.9])
def test_exact_way_loses_nothing(spark, data, monkeypatch, least):
    monkeypatch.setattr(neighbours, "BLOCK", 400)
    s, order = _exact(data, 10)
    want = {(q, n) for q, n in _wanted(data, order) if least is None or s[q, n] >= least}
    got = {(r.id, r.near) for r in neighbours.nearest(_frame(spark, data), least=least, every=50, exact=True).collect()}
    assert got == want


def test_two_levels_and_blocks(spark, data, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_COARSE", 5)
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    s, order = _exact(data, 10)
    want = {(min(a, b), max(a, b)) for a in range(len(data)) for b in order[a].tolist() if s[a, b] >= 0.9}
    near = neighbours.nearest(_frame(spark, data), 10, 0.9, cell=30)
    got = {(min(r.id, r.near), max(r.id, r.near)) for r in near.collect()}
    assert got <= want and len(got) >= 0.99 * len(want)
    got = {(r.id, r.near) for r in neighbours.nearest(_frame(spark, data), every=50, cell=30).collect()}
    want = _wanted(data, order)
    assert len(got & want) >= 0.9 * len(want)


def test_a_copy_that_asks_after_one_that_does_not(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 64)).astype(np.float32)
    x[50] = x[49]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "chunk_id bigint, vec array<float>").coalesce(1)
    got = {r.id: r.near for r in neighbours.nearest(frame, 1, every=50).collect()}
    assert set(got) == {0, 50, 100, 150} and got[50] == 49
