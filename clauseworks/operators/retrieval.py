"""Ranking of chunks by words, by vectors and by both."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from ..functions.stem import stem
from ..functions.text import terms
from ..functions.vectors import beaten, better, search, top
from ..session import checkpointed

#: BM25's constants, and what is added to ranks in fusion.
K1, B = 1.2, 0.75
KAPPA = 5
#: Terms of queries that are broadcast at most (about 100 bytes each).
BROADCAST_TERMS = 200_000


@pandas_udf(ArrayType(StringType()))
def stemmed_all(lists: pd.Series) -> pd.Series:
    return lists.map(lambda words: None if words is None else [stem(w) for w in words])


def stemmed_terms(text: Column) -> Column:
    return stemmed_all(terms(text))


def postings(chunks: DataFrame, words: DataFrame, key: str, analyse: Callable[[Column], Column], runs: list[int] = []) -> DataFrame:
    """id, length, term, tf of the words (and runs of several, in one string) that chunks hold, and a row of the empty term for every chunk; kept.

    Texts are read once and stay where they are: what is shuffled are counts of
    the words asked for.  Rows that repeat a chunk count once; of rows of one id
    with other texts one holds, chosen by the hash of its text.
    """
    asked = words.select("term").union(words.sparkSession.createDataFrame([("",)], "term string")).distinct()
    asked = F.broadcast(asked) if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else asked
    rows = chunks.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(F.col("text")).alias("hash"), analyse(F.col("text")).alias("all"))
    # the words pass through the generator as a column and as an outer one: else they would be made anew for their number and for a filter
    every = F.concat(F.array(F.lit("")), "all", *(_runs(F.col("all"), n) for n in runs))
    rows = rows.select("id", "hash", "all", F.explode_outer(every).alias("term")).join(asked, "term", "left_semi").select("id", "hash", F.size("all").alias("length"), "term")
    counts = rows.groupBy("id", "hash", "length", "term").agg(F.count("*").alias("n")).repartition("id")
    # the empty term stands once in every copy, so it tells how often a text was counted
    copies = F.max(F.when(F.col("term") == "", F.col("n"))).over(Window.partitionBy("id", "hash"))
    last = F.max("hash").over(Window.partitionBy("id"))
    once = counts.select("*", copies.alias("copies"), last.alias("last")).where("hash = last")
    return checkpointed(once.select("id", "length", "term", (F.col("n") / F.col("copies")).cast("int").alias("tf")))


def _parts(tf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The number of chunks that hold each term, and of all chunks (n, mean length: one row)."""
    return tf.where("term <> ''").groupBy("term").agg(F.count("*").alias("df")), tf.where("term = ''").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))


def _idf() -> Column:
    return F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _part() -> Column:
    return F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))


def bm25(chunks: DataFrame, queries: DataFrame, key: str = "id", stems: bool = False, analyse: Callable[[Column], Column] = terms) -> DataFrame:
    """query_id, id, score of all chunks (key, text) that share a term with a query (query_id, text).

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)) times tf (k1 + 1) / (tf + k1 (1 - b + b length / mean length)), for
    every occurrence of a term in the query.  Lengths are exact.  Chunks count
    once an id; a null text is empty.
    """
    analyse = stemmed_terms if stems else analyse
    asked = queries.where("query_id is not null").select("query_id", F.explode(analyse(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    tf = postings(chunks, asked, key, analyse)
    df, corpus = _parts(tf)
    weight = asked.join(df, "term").crossJoin(F.broadcast(corpus))  # one row
    weight = weight.select("query_id", "term", "mean", (F.col("times") * _idf()).alias("weight"))
    return tf.join(weight, "term").groupBy("query_id", "id").agg(F.sum(_part()).alias("score"))


def ranked(scored: DataFrame, most: int | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """With rank: best score first (to 9 decimals), ties to the smaller id."""
    scored = scored.withColumn("score", F.round("score", 9))
    rows = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")))
    return rows if most is None else rows.where(F.col("rank") <= most)


def semantic(vectors: DataFrame, queries: DataFrame, most: int = 1000, key: str = "chunk_id", vec: str = "vec", dim: int = 64) -> DataFrame:
    """query_id, id, score, rank of the chunks whose vectors are most similar to each query's (query_id, vec); exact.

    The queries are a stated set of bounded number and are sent to all tasks.
    """
    asked = [(r[0], r[1]) for r in queries.select("query_id", "vec").collect() if r[1] is not None and len(r[1]) == dim]
    return top(search(vectors, asked, most, key, vec, dim), most)


def fused_for(rankings: list[DataFrame], kappas: tuple[float, ...], name: str = "kappa {}") -> DataFrame:
    """method, query_id, id, score: fused() for several kappas in one pass."""
    rows = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("query_id", "id", "rank"))
    sums = rows.groupBy("query_id", "id").agg(*(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias(f"k{n}") for n, k in enumerate(kappas)))
    each = F.array(*(F.struct(F.lit(name.format(k)).alias("method"), F.col(f"k{n}").alias("score")) for n, k in enumerate(kappas)))
    return sums.select("query_id", "id", F.explode(each).alias("x")).select("x.method", "query_id", "id", "x.score")


def fused(rankings: list[DataFrame], kappa: float = KAPPA) -> DataFrame:
    """query_id, id, score: the sum over rankings (query_id, id, rank) of 1 / (kappa + rank); one that lacks a chunk adds nothing."""
    rows = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("query_id", "id", "rank"))
    return rows.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(float(kappa)) + F.col("rank"))).alias("score"))


def _counted(scored: DataFrame, wanted: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """query_id, id, n: how many rows of a query (query_id, id, score) come before each wanted one, per task."""
    sent = scored.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {q: np.zeros(len(s), np.int64) for q, (s, _) in sent.value.items()}
        for b in batches:
            names = b.column(0).dictionary_encode()
            at, ids, scores = names.indices.to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
            for k, q in enumerate(names.dictionary.to_pylist()):
                if q in counts:
                    counts[q] += better(scores[at == k], ids[at == k], *sent.value[q])
        for q, n in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(n), pa.string()), pa.array(sent.value[q][1]), pa.array(n)], names=["query_id", "id", "n"])

    return scored.select("query_id", "id", "score").mapInArrow(run, "query_id string, id bigint, n bigint")


def _by_query(rows: list) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((r.score, r.id))
    return {q: (np.array([s for s, _ in x], np.float64), np.array([i for _, i in x], np.int64)) for q, x in out.items()}


def rankings_for_fusion(words: DataFrame, vectors: DataFrame, asked: list[tuple[str, list[float]]], depth: int, kappa: float = KAPPA, key: str = "chunk_id", vec: str = "vec", dim: int = 64) -> list[DataFrame]:
    """query_id, id, rank by words (scored) and by vectors of all chunks that can be among the first depth of their fusion.

    The first depth of either ranking reach 1 / (kappa + depth) at least; a chunk
    beyond the first R of both reaches 2 / (kappa + R + 1) at most, less than that
    from R = kappa + 2 depth on.  So only the first R of both are candidates.
    Their places in the other ranking are counted, not sorted: every task says
    how many of its chunks come before each candidate.  At most 2 R candidates a
    stated query reach the driver.
    """
    reach = int(kappa) + 2 * depth + 1
    spark = words.sparkSession
    words = checkpointed(words.select("query_id", "id", F.round("score", 9).alias("score")))
    first = [(r.query_id, r.id) for r in ranked(words, reach).select("query_id", "id").collect()]
    listed: dict[str, set[int]] = {}
    for q, i in first:
        listed.setdefault(q, set()).add(i)
    scored = checkpointed(search(vectors, asked, reach, key, vec, dim, listed=listed).dropDuplicates(["query_id", "id"]))
    near = ranked(scored, reach).select("query_id", "id")
    candidates = F.broadcast(spark.createDataFrame(first, "query_id string, id bigint").union(near).distinct())
    wanted = [_by_query(x.join(candidates, ["query_id", "id"], "left_semi").collect()) for x in (words, scored)]
    counted = [_counted(words, wanted[0]), beaten(vectors.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).dropDuplicates([key]), asked, wanted[1], key, vec, dim)]
    return [x.groupBy("query_id", "id").agg((F.sum("n") + 1).alias("rank")) for x in counted]


#: A part of a query: a sign, then words in quotes or one without blanks.
_PART = re.compile(r'([+-]?)(?:"([^"]*)"|(\S+))')


def parse_query(text: str, stems: bool = True) -> list[tuple[str, tuple[str, ...]]]:
    """Clauses of a query: "should", "must" or "not", and the terms that stand side by side.

    Quotes and hyphens make phrases; + and AND demand, - excludes, OR changes
    nothing.  All other signs only separate words, and a quote or a bracket
    without its partner is one of these, so every text is a query.
    """
    clauses: list[tuple[str, tuple[str, ...]]] = []
    demanded = False
    for sign, quoted, plain in _PART.findall(text):
        if not sign and plain in ("AND", "OR"):
            if plain == "AND" and clauses and clauses[-1][0] == "should":
                clauses[-1] = ("must", clauses[-1][1])
            demanded = plain == "AND"
            continue
        groups = [quoted] if quoted else re.split(r"[^\w'\u2019\u2010\u2011-]+", plain)
        occur = "not" if sign == "-" else "must" if sign == "+" or demanded else "should"
        demanded = False
        for group in groups:
            found = [w for w in regex.findall(r"[\p{L}\p{N}]+", group.lower()) if len(w.encode()) <= 40]
            if found:
                clauses.append((occur, tuple(stem(w) if stems else w for w in found)))
    return clauses


def _runs(words: Column, n: int) -> Column:
    """All n neighbouring words, as one string each."""
    some = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda k: F.array_join(F.slice(words, k, n), " "))
    return F.when(F.size(words) >= n, some).otherwise(F.array().cast("array<string>"))


def bm25_parsed(chunks: DataFrame, queries: list[tuple[str, str]], key: str = "id", stems: bool = True) -> DataFrame:
    """query_id, id, score as by bm25(), for queries (id, text) with phrases, demanded and excluded parts.

    A phrase counts like a term whose idf is the sum of its terms'.  A chunk must
    hold every demanded part, no excluded one, and something that scores.
    """
    spark = chunks.sparkSession
    clauses = [(q, n, occur, " ".join(words), w) for q, text in queries for n, (occur, words) in enumerate(parse_query(text, stems)) for w in words]
    rows = spark.createDataFrame(clauses, "query_id string, clause int, occur string, term string, word string")
    needed = spark.createDataFrame([(q, sum(o == "must" for o, _ in parse_query(text, stems))) for q, text in queries], "query_id string, needed int")
    lengths = sorted({len(t.split(" ")) for _, _, _, t, _ in clauses} - {1})
    plain = stemmed_terms if stems else terms

    wanted = rows.select("term").union(rows.select("word")).distinct()  # parts of the stated queries
    tf = postings(chunks, wanted, key, plain, lengths)
    df, corpus = _parts(tf)
    df = df.withColumnRenamed("term", "word")
    weight = rows.join(df, "word").crossJoin(F.broadcast(corpus)).groupBy("query_id", "clause", "occur", "term", "mean").agg(F.sum(_idf()).alias("weight"))  # one row
    part = _part()
    found = tf.join(weight, "term").groupBy("query_id", "id").agg(
        F.sum(F.when(F.col("occur") != "not", part)).alias("score"), F.countDistinct(F.when(F.col("occur") == "must", F.col("clause"))).alias("held"), F.max(F.col("occur") == "not").alias("excluded")
    )
    return found.join(F.broadcast(needed), "query_id").where("score is not null and held = needed and not excluded").select("query_id", "id", "score")
