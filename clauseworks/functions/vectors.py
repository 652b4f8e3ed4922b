"""Vectors as arrays: cosine searches by a query set, unit length, hashed bags of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import terms


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision; null if a value is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def usable(vec: Column, dim: int) -> Column:
    """Whether a vector has dim finite values that aren't all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vec) == dim) & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def normalized(vec: Column) -> Column:
    """Unit vector in doubles; a zero vector becomes NaN."""
    length = F.sqrt(dot(vec, vec))
    return F.transform(vec, lambda x: F.when(length == 0, F.lit(float("nan"))).otherwise(x.cast("double") / length))


def hash_embedding(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """key, bucket, value: a unit vector of term counts in buckets by md5, without zeros; nothing for texts without terms."""
    term = F.explode(terms(F.col(text)))
    bucket = (F.conv(F.substring(F.md5("term"), 1, 6), 16, 10).cast("bigint") % dim).cast("int")
    counts = df.select(key, term.alias("term")).groupBy(key, bucket.alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("n") / length).alias("value"))


def _directions(queries: list[tuple[object, list[float]]], dim: int) -> np.ndarray:
    asked = np.array([v for _, v in queries], np.float64).reshape(-1, dim)
    return asked / np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)


def _scores(b: pa.RecordBatch, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines (to 9 decimals) of a batch's usable vectors with all queries."""
    lists, dim = b.column(1), asked.shape[1]
    fit = np.flatnonzero(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == dim)
    x = lists.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x = x[good]
    return b.column(0).to_numpy()[fit[good]], np.round(asked @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 9) + 0.0


def search(vectors: DataFrame, queries: list[tuple[object, list[float]]], most: int, key: str, vec: str, dim: int, query_type: str = "string", listed: dict[object, set[int]] | None = None) -> DataFrame:
    """query_id, id, score (cosine to 9 decimals): the most similar vectors of each query, exact; more of them per task, to be ranked.

    The queries are a stated set held by every task; vectors pass once, a batch
    against all queries as one product, and a task keeps its best only.  The ids
    listed for a query are given whatever their score.
    """
    ids = [q for q, _ in queries]
    wanted = [np.array(sorted((listed or {}).get(q, ())), np.int64) for q in ids]
    sent = vectors.sparkSession.sparkContext.broadcast((ids, _directions(queries, dim), wanted))
    arrow = pa.string() if query_type == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, wanted = sent.value
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in ids]
        also = [[] for _ in ids]
        for b in batches:
            own, scores = _scores(b, asked)
            for q in range(len(ids)):
                s, i = scores[q], own
                if len(wanted[q]):
                    at = np.flatnonzero(np.isin(own, wanted[q]))
                    also[q].append((s[at], own[at]))
                if len(best[q][0]) >= most:  # only what reaches the last of the best can change them
                    at = np.flatnonzero(s >= best[q][0][-1])
                    if not len(at):
                        continue
                    s, i = s[at], i[at]
                s, i = np.concatenate([best[q][0], s]), np.concatenate([best[q][1], i])
                order = np.lexsort((i, -s))
                # repeated rows of an id lie side by side
                order = order[np.concatenate([[True], (i[order][1:] != i[order][:-1])])][:most] if len(order) else order
                best[q] = s[order], i[order]
        best = [tuple(map(np.concatenate, zip(own, *more, strict=True))) for own, more in zip(best, also, strict=True)]
        n = [len(s) for s, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array([q for q, k in zip(ids, n, strict=True) for _ in range(k)], arrow), pa.array(np.concatenate([i for _, i in best]) if best else [], pa.int64()), pa.array(np.concatenate([s for s, _ in best]) if best else [], pa.float64())], names=["query_id", "id", "score"])

    return vectors.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).cast("bigint").alias("id"), vec).mapInArrow(run, f"query_id {query_type}, id bigint, score double")


def better(scores: np.ndarray, ids: np.ndarray, wanted: np.ndarray, wanted_ids: np.ndarray) -> np.ndarray:
    """How many of the rows come before each wanted one: a higher score, or the same and a smaller id."""
    order = np.lexsort((ids, scores))
    scores, ids = scores[order], ids[order]
    low, high = np.searchsorted(scores, wanted), np.searchsorted(scores, wanted, side="right")
    out = len(scores) - high
    for k in np.flatnonzero(low < high):
        out[k] += np.searchsorted(ids[low[k] : high[k]], wanted_ids[k])
    return out


def beaten(vectors: DataFrame, queries: list[tuple[str, list[float]]], wanted: dict[str, tuple[np.ndarray, np.ndarray]], key: str, vec: str, dim: int) -> DataFrame:
    """query_id, id, n: how many vectors come before each wanted one (scores, ids) of a query, per task; a vector an id."""
    ids = [q for q, _ in queries]
    sent = vectors.sparkSession.sparkContext.broadcast((ids, _directions(queries, dim), wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, wanted = sent.value
        counts = {q: np.zeros(len(s), np.int64) for q, (s, _) in wanted.items()}
        for b in batches:
            own, scores = _scores(b, asked)
            for k, q in enumerate(ids):
                if q in counts:
                    counts[q] += better(scores[k], own, *wanted[q])
        for q, n in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(n), pa.string()), pa.array(wanted[q][1]), pa.array(n)], names=["query_id", "id", "n"])

    return vectors.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).cast("bigint").alias("id"), vec).mapInArrow(run, "query_id string, id bigint, n bigint")


def top(scored: DataFrame, most: int) -> DataFrame:
    """query_id, id, score, rank: the best of each query, ties to the smaller id, an id once."""
    once = scored.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most)
