"""Most similar vectors by cosine: cells, score-aware four-bit codes, table scans and exact reranking.

Vectors of unit length are put into cells around centroids, in two levels where
one level of MOST_COARSE centroids would make cells too large: a cell is then a
centroid and one of the shared second centroids of what is left after it.  What
is left after both is coded in pairs of dimensions, four bits each, two codes a
byte.  Codes and codebooks minimise an error in which the part parallel to the
vector weighs more than the part across it, since that is what shifts large inner
products.  A query visits its own cell and all cells that score within a gap of
its best one, adds up its tables over the codes there and computes exact cosines
of the best.  The gap follows from the recall asked for, measured on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

DIM, PAIRS, CODES = 64, 32, 16
#: Vectors that centroids and codebooks are fitted to at most, drawn by hash.
SAMPLE, CODEBOOK_SAMPLE = 40_000, 5_000
#: Vectors a cell holds on average, centroids of the first level at most, and vectors or queries of a cell that are scanned as one block.
CELL, MOST_COARSE, BLOCK = 2000, 4096, 8192
#: Share of the true neighbours whose cell is to be visited: of the nearest in the sample, and of partners placed exactly at the least score.
RECALL, PAIR_RECALL = 0.98, 0.9995
#: Score from which inner products are to be kept well, which sets the weight of the parallel error.
T = 0.2
PARALLEL = (DIM - 1) * T * T / (1 - T * T)
#: What a least score allows for, as a multiple of the largest error of a scanned score in the sample; candidates reranked for each wanted.
SAFETY, RERANK = 1.25, 6
#: Hashes that a task remembers so as to send copies of a vector once, and vectors placed at a time.
REMEMBERED, AT_ONCE = 1_000_000, 2048


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Places in the batch and values of the vectors that are finite, not zero and of 64 values."""
    lists = b.column(1)
    fit = np.flatnonzero(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == DIM)
    values = lists.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, DIM)
    good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    return fit[good], values[good]


def _hash(row: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(row.tobytes())


def _rows(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    return vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<float>").alias("vec")).where("id is not null and vec is not null")


def usable(vectors: DataFrame, key: str = "chunk_id", vec: str = "vec") -> DataFrame:
    """id and hash (the class of equal vectors) of vectors that are finite, not zero, of 64 values, with an id; once for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fit, values = _read(b)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(fit)), pa.array(map(_hash, values), pa.binary())], names=["id", "hash"])

    return _rows(vectors, key, vec).mapInArrow(run, "id bigint, hash binary").groupBy("id").agg(F.min("hash").alias("hash"))


def _sample(vectors: DataFrame, share: float) -> np.ndarray:
    """Unit vectors of about a share of the classes, drawn by their hash, each once; of at most 2 * SAMPLE rows that reach the driver."""
    limit = int(min(1.0, share) * 0xFFFFFFFF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            out = {h: v.tobytes() for v in _read(b)[1] if int.from_bytes((h := _hash(v))[:4]) <= limit and h not in seen}
            if len(seen) < REMEMBERED:
                seen |= out.keys()
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.binary()), pa.array(out.values(), pa.binary())], names=["hash", "vec"])

    rows = vectors.mapInArrow(run, "hash binary, vec binary").groupBy("hash").agg(F.first("vec").alias("vec")).orderBy("hash").limit(2 * SAMPLE).collect()
    return _unit(np.frombuffer(b"".join(bytes(r.vec) for r in rows), np.float32).reshape(-1, DIM).astype(np.float64)).astype(np.float32)


def _centroids(x: np.ndarray, number: int, rng: np.random.Generator, rounds: int = 8, unit: bool = True) -> np.ndarray:
    centroids = x[rng.choice(len(x), number, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centroids)
        order = np.argsort(own, kind="stable")
        sums = np.zeros_like(centroids)
        found, at = np.unique(own[order], return_index=True)
        for k, part in zip(found, np.split(x[order], at[1:]), strict=True):
            sums[k] = part.sum(axis=0) if unit else part.mean(axis=0)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-9) if unit else sums, centroids).astype(np.float32)
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(axis=1) / 2
    return np.concatenate([(x[k : k + 4096] @ centroids.T - half).argmax(axis=1) for k in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def encode(x: np.ndarray, rest: np.ndarray, books: np.ndarray, passes: int = 2) -> np.ndarray:
    """Codes of the rests of unit vectors x: coordinate descent over the pairs on the weighted error."""
    n = len(x)
    pairs, units = (np.ascontiguousarray(v.reshape(n, PAIRS, 2).transpose(1, 0, 2), np.float32) for v in (rest, x))
    turned = np.ascontiguousarray(books.transpose(0, 2, 1), np.float32)
    # of every code of every pair: squared error, and error along the vector
    square = (pairs**2).sum(axis=2)[:, :, None] - 2 * (pairs @ turned) + (books**2).sum(axis=2)[:, None, :]
    part = (pairs * units).sum(axis=2)[:, :, None] - units @ turned
    codes = square.argmin(axis=2)
    along = np.take_along_axis(part, codes[:, :, None], 2)[:, :, 0]
    total = along.sum(axis=0)
    at = np.arange(n)
    for _ in range(passes):
        for k in range(PAIRS):
            total -= along[k]
            cost = part[k] + total[:, None]
            cost *= cost
            cost *= PARALLEL - 1
            cost += square[k]
            codes[k] = cost.argmin(axis=1)
            along[k] = part[k][at, codes[k]]
            total += along[k]
    return codes.T.astype(np.uint8)


def codebooks(x: np.ndarray, rest: np.ndarray, rng: np.random.Generator, rounds: int = 3) -> np.ndarray:
    """Codebooks that minimise the weighted error: plain ones first, then codes and books in turn."""
    n = len(x)
    books = np.stack([rest.reshape(n, PAIRS, 2)[rng.choice(n, CODES, replace=n < CODES), k] for k in range(PAIRS)]).astype(np.float32)
    for _ in range(6):
        for k in range(PAIRS):
            own = rest.reshape(n, PAIRS, 2)[:, k]
            code = ((own[:, None] - books[k][None]) ** 2).sum(axis=2).argmin(axis=1)
            number = np.maximum(np.bincount(code, minlength=CODES), 1)[:, None]
            mean = np.stack([np.bincount(code, own[:, d], CODES) for d in (0, 1)], axis=1) / number
            books[k] = np.where(np.bincount(code, minlength=CODES)[:, None] > 0, mean, books[k])
    size = PAIRS * CODES * 2
    column = np.arange(PAIRS)[None, :, None] * CODES * 2 + np.arange(2)[None, None, :]
    for _ in range(rounds):
        at = (column + encode(x, rest, books)[:, :, None].astype(np.int64) * 2).reshape(n, DIM)
        chosen = np.zeros((n, size), np.float32)
        np.put_along_axis(chosen, at, x, axis=1)
        left = (PARALLEL - 1) * (chosen.T @ chosen).astype(np.float64)
        left[np.diag_indices(size)] += np.bincount(at.ravel(), minlength=size) + 1e-3
        right = np.bincount(at.ravel(), rest.ravel(), size) + (PARALLEL - 1) * chosen.T.astype(np.float64) @ (rest * x).sum(axis=1)
        right += 1e-3 * books.ravel()
        books = np.linalg.solve(left, right).astype(np.float32).reshape(PAIRS, CODES, 2)
    return books


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.take_along_axis(books[None], codes[:, :, None, None].astype(np.intp), 2).reshape(len(codes), DIM)


def scan(queries: np.ndarray, codes: np.ndarray, books: np.ndarray, rows: int = 256) -> np.ndarray:
    """Inner products of coded rests and queries, by tables: two four-bit codes, a byte, at a time.

    A byte's sums for all queries lie side by side, so a step adds whole rows.
    """
    tables = np.einsum("nkd,kcd->kcn", queries.reshape(len(queries), PAIRS, 2), books, optimize=True).astype(np.float32)
    both = (tables[0::2, :, None] + tables[1::2, None]).reshape(PAIRS // 2, CODES * CODES, len(queries))
    bytes_ = packed(codes) if codes.shape[1] == PAIRS else codes
    out = np.empty((len(bytes_), len(queries)), np.float32)
    step = np.empty((rows, len(queries)), np.float32)
    for s in range(0, len(bytes_), rows):
        part, own = bytes_[s : s + rows], out[s : s + rows]
        np.take(both[0], part[:, 0], axis=0, out=own, mode="clip")
        for k in range(1, PAIRS // 2):
            np.take(both[k], part[:, k], axis=0, out=step[: len(own)], mode="clip")
            own += step[: len(own)]
    return out.T


class Model(NamedTuple):
    """What placing and scanning need: bounded by the sample, not by the table."""

    coarse: np.ndarray
    fine: np.ndarray
    books: np.ndarray
    gap: float
    margin: float
    blocks: np.ndarray
    parts: np.ndarray


def _cells(x: np.ndarray, coarse: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second centroid of each vector."""
    first = _nearest(x, coarse)
    return first, _nearest(x - coarse[first], fine)


def _visited(x: np.ndarray, coarse: np.ndarray, fine: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell of every cell that scores within the gap of the row's best, on both levels."""
    scores = x @ coarse.T
    row, first = np.nonzero(scores >= scores.max(axis=1, keepdims=True) - gap)
    if len(fine) == 1:
        return row, first
    both = scores[row, first][:, None] + (x @ fine.T)[row]
    best = np.full(len(x), -9, np.float32)
    np.maximum.at(best, row, both.max(axis=1))
    at, second = np.nonzero(both >= (best[row] - gap)[:, None])
    return row[at], first[at] * len(fine) + second


def _deficit(q: np.ndarray, x: np.ndarray, coarse: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """The gap from which each q visits the cell of its x; of two levels somewhat too large where another first centroid would do."""
    own, own_fine = _cells(x, coarse, fine)
    scores, second = q @ coarse.T, q @ fine.T
    at = np.arange(len(q))
    first = scores.max(axis=1) - scores[at, own]
    return np.maximum(first, first + second.max(axis=1) - second[at, own_fine])


def calibrated(x: np.ndarray, coarse: np.ndarray, fine: np.ndarray, least: float | None, recall: float, both: bool, k: int, rng: np.random.Generator) -> float:
    """The gap that reaches a share of the neighbours, of either side if both ask.

    With a least score these are partners of exactly that score in random
    directions, the hardest to meet; else the k nearest within the sample, which
    are further away than those within the table.
    """
    if least is not None:
        q = x[:4000]
        across = rng.normal(size=q.shape).astype(np.float32)
        across = _unit(across - (across * q).sum(axis=1, keepdims=True) * q)
        near = (least * q + np.sqrt(1 - least * least) * across).astype(np.float32)
    else:
        asks = x[:1000]
        scores = asks @ x.T
        scores[np.arange(len(asks)), np.arange(len(asks))] = -9
        take = min(k, len(x) - 1)
        if not take:
            return 2.0
        near = x[np.argpartition(-scores, take - 1, axis=1)[:, :take].ravel()]
        q = np.repeat(asks, take, axis=0)
    deficit = _deficit(q, near, coarse, fine)
    if both:
        deficit = np.minimum(deficit, _deficit(near, q, coarse, fine))
    return float(np.quantile(deficit, recall, method="higher")) + 1e-6


def fitted(x: np.ndarray, total: int, least: float | None, recall: float, exact: bool, both: bool, k: int, cell: int) -> Model:
    rng = np.random.default_rng(7)
    cells = max(1, total // (BLOCK if exact else cell))
    number = min(cells, max(1, len(x) // 8), MOST_COARSE)
    coarse = _centroids(x, number, rng)
    rest = x - coarse[_nearest(x, coarse)]
    second = min(-(-cells // number), max(1, len(x) // 8))
    fine = _centroids(rest, second, rng, unit=False) if second > 1 else np.zeros((1, DIM), np.float32)
    own = x[:CODEBOOK_SAMPLE]
    first, fine_at = _cells(own, coarse, fine)
    rest = own - coarse[first] - fine[fine_at]
    books = codebooks(own, rest, rng)
    gap = 9.0 if exact else calibrated(x, coarse, fine, least, recall, both, k, rng)
    # errors of scanned scores: of partners at the least score
    error = rest - decoded(encode(own, rest, books), books)
    across = rng.normal(size=own.shape)
    across = _unit(across - (across * own).sum(axis=1, keepdims=True) * own)
    near = (least or 0.9) * own + np.sqrt(1 - (least or 0.9) ** 2) * across
    margin = SAFETY * float(np.abs((near * error).sum(axis=1)).max(initial=0))
    # cells of many vectors are scanned in blocks, cells of many queries in parts
    first, fine_at = _cells(x, coarse, fine)
    scale = total / len(x)
    held = np.bincount(first * len(fine) + fine_at, minlength=len(coarse) * len(fine)) * scale
    asked = np.zeros(len(held)) + (total if exact else 0)
    for s in range(0, 0 if exact else len(x), AT_ONCE):
        asked += np.bincount(_visited(x[s : s + AT_ONCE], coarse, fine, gap)[1], minlength=len(held)) * scale
    blocks, parts = (np.ceil(2 * n / BLOCK).clip(1).astype(np.int32) for n in (held, asked))
    return Model(coarse, fine, books, gap, margin, blocks, parts)


_PLACED = "cell bigint, block int, part int, role int, hash binary, codes binary, vec binary"
_NAMES = ["cell", "block", "part", "role", "hash", "codes", "vec"]
#: What a row is in a scan: coded vector, coded vector that asks in this part, query from elsewhere, coded vector that asks in another part.
BASE, BOTH, ASK, ELSEWHERE = range(4)


def _placed(model: Model, x: np.ndarray, asks: np.ndarray, hashes: list[bytes], raw: list[bytes]) -> pa.RecordBatch:
    """Rows of vectors for all scans they take part in; asks says which ask."""
    _, fine, books, gap, _, blocks, parts = model
    first, second = _cells(x, model.coarse, fine)
    own = first * len(fine) + second
    codes = packed(encode(x, x - model.coarse[first] - fine[second], books))
    number = np.array([int.from_bytes(h[:8]) for h in hashes], np.uint64)
    block, part = ((number % n[own].astype(np.uint64)).astype(np.int32) for n in (blocks, parts))
    # as coded vectors: own block, every part
    times = parts[own]
    i = np.repeat(np.arange(len(x)), times)
    p = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
    role = np.where(~asks[i], BASE, np.where(p == part[i], BOTH, ELSEWHERE))
    rows = [(i, own[i], block[i], p, role)]
    # as queries: all blocks of the cells visited, and of the own cell all others
    row, cell = _visited(x[asks], model.coarse, fine, gap)
    row = np.flatnonzero(asks)[row]
    away = own[row] != cell
    i = np.concatenate([row[away], np.flatnonzero(asks)])
    cell = np.concatenate([cell[away], own[asks]])
    times = blocks[cell]
    b = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    i, cell = np.repeat(i, times), np.repeat(cell, times)
    keep = (own[i] != cell) | (b != block[i])
    i, cell, b = i[keep], cell[keep], b[keep]
    rows.append((i, cell, b, (number[i] % parts[cell].astype(np.uint64)).astype(np.int32), np.full(len(i), ASK)))
    i, cell, block, part, role = (np.concatenate(c) for c in zip(*rows, strict=True))
    at = pa.array(i)
    coded = pa.array([c.tobytes() for c in codes], pa.binary()).take(pa.array(i, mask=role == ASK))
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.array(role, pa.int32()), pa.array(hashes, pa.binary()).take(at), coded, pa.array(raw, pa.binary()).take(at)], names=_NAMES)


def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row and of all that tie with the last of them."""
    order = np.lexsort((-scores, rows))
    r, s = rows[order], scores[order]
    first = np.searchsorted(r, r)
    last = np.minimum(first + k - 1, np.searchsorted(r, r, side="right") - 1)
    return order[s >= s[last]]


def _scan_block(table: pa.Table, k: int, least: float | None, exact: bool, model: Model) -> pa.Table:
    """query, near (hashes) and score of the best of every query in a block, and of the block's own vectors among queries from elsewhere."""
    cell = table.column("cell")[0].as_py()
    centroid = model.coarse[cell // len(model.fine)] + model.fine[cell % len(model.fine)]
    role = table.column("role").to_numpy()
    hashes = table.column("hash").to_pylist()
    # copies that several tasks sent count once; one of them may ask where the others don't
    base: dict[bytes, int] = {}
    outside: dict[bytes, int] = {}
    for n in np.argsort(-(role % 4 > 0).astype(np.int8), kind="stable").tolist():
        (outside if role[n] == ASK else base).setdefault(hashes[n], n)
    at, away = np.array(list(base.values()), np.int64), np.array(list(outside.values()), np.int64)
    if not len(at):
        return pa.table({"query": pa.array([], pa.binary()), "near": pa.array([], pa.binary()), "score": pa.array([], pa.float64())})
    x, q = (_unit(np.frombuffer(b"".join(table.column("vec").take(pa.array(n)).to_pylist()), np.float32).reshape(-1, DIM).astype(np.float64)) for n in (at, away))
    codes = np.frombuffer(b"".join(table.column("codes").take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, PAIRS // 2)
    asking = np.flatnonzero(role[at] == BOTH)
    asked = role[at] != BASE
    q = np.concatenate([x[asking], q])
    own = np.concatenate([asking, np.full(len(away), -1)])
    # of a scanned score nothing is off by more than the length of what its code leaves
    error = np.linalg.norm(x - centroid - decoded(np.stack([codes >> 4, codes & 15], axis=2).reshape(-1, PAIRS), model.books), axis=1) + 1e-5 if exact else None
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(q), 256):
        part, self_ = q[s : s + 256], own[s : s + 256]
        score = scan(part.astype(np.float32), codes, model.books) + (part @ centroid).astype(np.float32)[:, None]
        inside = np.flatnonzero(self_ >= 0)
        score[inside, self_[inside]] = -9
        if exact and least is None and len(at) > k:
            low = -np.partition(-(score - error), k - 1, axis=1)[:, k - 1]
            row, column = np.nonzero(score + error >= low[:, None])
        elif exact:
            row, column = np.nonzero(score + error >= (-2 if least is None else least))
        elif least is not None:
            row, column = np.nonzero(score >= least - model.margin)
        else:
            take = min(RERANK * k, len(at))
            column = np.argpartition(-score, take - 1, axis=1)[:, :take].ravel()
            row = np.repeat(np.arange(len(part)), take)
        keep = self_[row] != column
        row, column = row[keep], column[keep]
        true = np.einsum("nd,nd->n", part[row], x[column])
        keep = np.flatnonzero(true >= (-2 if least is None else least))
        found.append((row[keep] + s, column[keep], true[keep]))
    row, column, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2 + (np.empty(0),)
    near = _best(row, score, k)
    back = np.flatnonzero((own[row] < 0) & asked[column])
    back = back[_best(column[back], score[back], k)]
    own_hash = np.array(list(base), object)
    query_hash = np.concatenate([own_hash[asking], np.array([*outside, None], object)[:-1]])
    return pa.table({
        "query": pa.array(np.concatenate([query_hash[row[near]], own_hash[column[back]]]), pa.binary()),
        "near": pa.array(np.concatenate([own_hash[column[near]], query_hash[row[back]]]), pa.binary()),
        "score": pa.array(np.concatenate([score[near], score[back]]), pa.float64()),
    })


def _first(df: DataFrame, by: str, near: str, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), F.col(near)))
    return df.withColumn("rank", place).where(F.col("rank") <= most)


def nearest(vectors: DataFrame, k: int = 10, least: float | None = None, every: int = 1, key: str = "chunk_id", vec: str = "vec", recall: float | None = None, exact: bool = False, cell: int = CELL) -> DataFrame:
    """id, near, score, rank: the k most similar others of every usable vector whose id is divisible by every.

    With least only neighbours of that cosine or more, which makes visits and
    reranking cheaper.  Ties go to the smaller id.  Repeated rows count once;
    vectors that are null, zero, not of 64 values or not finite neither ask nor
    are found.  Equal vectors are indexed once; of their ids only the k + 1
    smallest can be neighbours, every one gets its list.

    recall is the share of neighbours whose cells are to be visited, which sets
    how far from its best cell a query looks; there is no cap on the number.
    With exact all cells are visited and candidates are kept by the proven error
    of their codes: nothing is lost, at a cost that grows with the square.
    """
    members = checkpointed(usable(vectors, key, vec))
    classes = checkpointed(members.groupBy("hash").agg(F.min("id").alias("class"), F.count("*").alias("copies")))
    spark, total = vectors.sparkSession, classes.count()
    if total == 0:
        return spark.createDataFrame([], "id bigint, near bigint, score double, rank int")
    rows = _rows(vectors, key, vec)
    x = _sample(rows, SAMPLE / total if total > SAMPLE else 1.0)
    if not len(x):
        x = _sample(rows, 1.0)
    rng = np.random.default_rng(7)
    x = x[rng.permutation(len(x))]
    share = recall if recall is not None else RECALL if least is None else PAIR_RECALL
    sent = spark.sparkContext.broadcast(fitted(x, total, least, share, exact, every == 1, k, cell))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bool] = {}
        for whole in batches:
            for s in range(0, len(whole), AT_ONCE):
                b = whole.slice(s, AT_ONCE)
                fit, values = _read(b)
                own = b.column(0).to_numpy()[fit] % every == 0
                new: dict[bytes, list] = {}
                for n, (v, a) in enumerate(zip(values, own.tolist(), strict=True)):
                    h = _hash(v)
                    if h in new:
                        new[h][1] |= a
                    elif h not in seen or a and not seen[h]:
                        new[h] = [n, a]
                if not new:
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                at, asks = (np.array(c) for c in zip(*new.values(), strict=True))
                # a copy that asks after one that didn't is sent again, with what it then is
                seen.update((h, bool(a)) for h, (_, a) in new.items())
                x = _unit(values[at].astype(np.float64)).astype(np.float32)
                yield _placed(sent.value, x, asks.astype(bool), list(new), [values[n].tobytes() for n in at])

    placed = rows.mapInArrow(place, _PLACED)
    found = placed.groupBy("cell", "block", "part").applyInArrow(lambda t: _scan_block(t, k, least, exact, sent.value), "query binary, near binary, score double")
    return _spelled_out(found, members, classes, k, every)


def _spelled_out(found: DataFrame, members: DataFrame, classes: DataFrame, k: int, every: int) -> DataFrame:
    """Neighbours of classes as those of their ids, copies first."""
    few = _first(members.withColumn("score", F.lit(0.0)), "hash", "id", k + 1).select(F.col("hash").alias("near_hash"), F.col("id").alias("near"))
    copies = classes.where("copies > 1").select(F.col("hash").alias("query"), F.col("hash").alias("near_hash"), F.lit(1.0).alias("score"))
    # both sides may have found a pair; the partitioning by query serves this and both rankings
    once = found.repartition("query").dropDuplicates(["query", "near"])
    ids = classes.select(F.col("hash").alias("near"), "class")
    best = _first(once.join(ids, "near"), "query", "class", k).select("query", F.col("near").alias("near_hash"), "score")
    lists = _first(best.unionByName(copies).join(few, "near_hash").select("query", "near", "score"), "query", "near", k + 1).drop("rank")
    asking = members.where(F.col("id") % every == 0).select("id", F.col("hash").alias("query"))
    return _first(asking.join(lists, "query").where("id <> near").select("id", "near", "score"), "id", "near", k)


def near_pairs(vectors: DataFrame, k: int = 10, least: float = 0.9, recall: float = PAIR_RECALL, exact: bool = False) -> DataFrame:
    """id_a < id_b with a cosine of at least least where one is among the k most similar of the other."""
    near = nearest(vectors, k, least, recall=recall, exact=exact)
    return near.select(F.least("id", "near").alias("id_a"), F.greatest("id", "near").alias("id_b")).distinct()
