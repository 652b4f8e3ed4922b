"""Relevance by interval overlap, ranking metrics, paired tests and the choice of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_name
from ..session import checkpointed

#: Fixed value: ranks that count.
DEPTH = 10


def valid_spans(spans: DataFrame) -> DataFrame:
    """span_id, category, file, char_start, char_end, once each: with category and file, start before end, not before 0."""
    ok = spans.where("category is not null and file is not null and char_start >= 0 and char_start < char_end")
    return ok.select("span_id", "category", F.trim("file").alias("file"), "char_start", "char_end").distinct()


def placed_spans(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """category, doc_id, s, e of the spans whose file is a document's; of documents with one name the last id holds."""
    names = documents.select(file_name(F.col("path")).alias("file"), "doc_id").groupBy("file").agg(F.max("doc_id").alias("doc_id"))
    return valid_spans(spans).join(names, "file").select("category", "doc_id", F.col("char_start").alias("s"), F.col("char_end").alias("e"))


def merged(intervals: DataFrame, by: list[str]) -> DataFrame:
    """by, s, e: overlapping and touching intervals as one."""
    order = Window.partitionBy(*by).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    return rows.groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def judged(chunks: DataFrame, placed: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id of relevant chunks: those that hold a whole span of the query's category, or half of which merged spans cover.

    Spans and chunks meet by document; chunks without places or length are never relevant.
    """
    pieces = chunks.where("id is not null and doc_id is not null and char_start < char_end").groupBy("id").agg(*(F.min(c).alias(c) for c in ("doc_id", "char_start", "char_end")))
    whole = pieces.join(placed, "doc_id").where("char_start <= s and e <= char_end").select("category", "id")
    overlap = F.greatest(F.lit(0), F.least("char_end", "e") - F.greatest("char_start", "s"))
    half = pieces.join(merged(placed, ["category", "doc_id"]), "doc_id").where("s < char_end and e > char_start")
    half = half.groupBy("category", "id").agg(F.sum(overlap).alias("covered"), F.first(F.col("char_end") - F.col("char_start")).alias("length")).where("2 * covered >= length").select("category", "id")
    relevant = whole.unionByName(half).distinct()
    return queries.select(F.col("id").alias("query_id"), "category").distinct().join(relevant, "category").select("query_id", F.col("id").alias("chunk_id"))


def metrics(run: DataFrame, qrels: DataFrame, queries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """method, query_id, ndcg, mrr, r_precision of every query for every method of a run (method, query_id, id, rank); 0 without relevant or found chunks."""
    total = qrels.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("r"))
    hits = run.join(qrels.select("query_id", F.col("chunk_id").alias("id"), F.lit(1).alias("hit")).distinct(), ["query_id", "id"])
    hits = hits.join(total, "query_id").groupBy("method", "query_id").agg(
        F.sum(F.when(F.col("rank") <= depth, 1 / F.log2(F.col("rank") + 1))).alias("gain"),
        F.min(F.when(F.col("rank") <= depth, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= F.col("r"), 1).otherwise(0)).alias("early"),
    )
    every = run.select("method").distinct().crossJoin(F.broadcast(queries.select(F.col("id").alias("query_id")).distinct()))  # methods by the stated queries
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(depth), F.col("r")).cast("int")), F.lit(0.0), lambda s, k: s + 1 / F.log2(k + 1.0))
    rows = every.join(total, "query_id", "left").join(hits, ["method", "query_id"], "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.select("method", "query_id", zero(F.col("gain") / F.when(F.col("r") > 0, ideal)).alias("ndcg"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("early") / F.col("r")).alias("r_precision"))


def group_means(scores: DataFrame, queries: DataFrame) -> DataFrame:
    """method, kind ('all' for all), queries and mean metrics, by grouping sets."""
    kinds = queries.select(F.col("id").alias("query_id"), "kind").distinct()
    rows = scores.join(kinds, "query_id").rollup("method", "kind").agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "mrr", "r_precision")), F.grouping("kind").alias("over"))
    return rows.where("method is not null").withColumn("kind", F.when(F.col("over") == 1, "all").otherwise(F.col("kind"))).drop("over")


def signed_ranks(scores: DataFrame, pairs: list[tuple[str, str]], value: str = "ndcg") -> DataFrame:
    """method_a, method_b, n, w_plus, w_minus, ties: what the signed-rank test needs; ranks of equal differences are shared."""
    spark = scores.sparkSession
    wanted = F.broadcast(spark.createDataFrame(pairs, "method_a string, method_b string"))
    a, b = (scores.select("query_id", F.col("method").alias(f"method_{x}"), F.col(value).alias(x)) for x in "ab")
    d = wanted.join(a, "method_a").join(b, ["method_b", "query_id"]).withColumn("d", F.round(F.col("a") - F.col("b"), 6)).where("d <> 0")
    same = Window.partitionBy("method_a", "method_b", F.abs("d"))
    rows = d.withColumn("place", F.row_number().over(Window.partitionBy("method_a", "method_b").orderBy(F.abs("d"), "query_id")))
    rows = rows.withColumn("rank", F.avg("place").over(same)).withColumn("t", F.count("*").over(same))
    found = rows.groupBy("method_a", "method_b").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("ties")
    )
    zero = {"n": 0, "w_plus": 0.0, "w_minus": 0.0, "ties": 0.0}
    return wanted.join(found, ["method_a", "method_b"], "left").fillna(zero)


def cross_validated(scores: DataFrame, fold: Column, value: str = "ndcg") -> DataFrame:
    """fold, setting, held_out: per fold the setting best on all other folds (the first listed on ties) and its mean on this one.

    scores: setting, position, query_id and the value.
    """
    rows = scores.withColumn("fold", fold)
    per = rows.groupBy("setting", "position", "fold").agg(F.sum(value).alias("own"), F.avg(value).alias("mean"))
    per = per.withColumn("others", F.round(F.sum("own").over(Window.partitionBy("setting")) - F.col("own"), 6))
    best = F.row_number().over(Window.partitionBy("fold").orderBy(F.col("others").desc(), "position"))
    return per.withColumn("best", best).where("best = 1").select("fold", "setting", F.round("mean", 6).alias("held_out"))


def latency(series: DataFrame, value: str, by: str) -> DataFrame:
    """by, n, median, p95 (nearest rank) of a series of numbers; nulls don't count.

    Equal values are counted where they are; sorted ranges of them are numbered
    each for itself and shifted by what lies before, so no task holds a group.
    """
    counts = series.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ranges = counts.repartitionByRange(by, "v").sortWithinPartitions(by, "v").withColumn("part", F.spark_partition_id())
    ranges = checkpointed(ranges)
    sizes = ranges.groupBy(by, "part").agg(F.sum("c").alias("held"))
    before = sizes.withColumn("before", F.coalesce(F.sum("held").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("held")
    total = sizes.groupBy(by).agg(F.sum("held").alias("n"))
    within = F.sum("c").over(Window.partitionBy("part", by).orderBy("v"))
    rows = ranges.withColumn("within", within).join(F.broadcast(before), [by, "part"]).join(F.broadcast(total), by)
    last = F.col("before") + F.col("within")  # place of the value's last, from 1
    at = lambda place: F.max(F.when((last >= place) & (last - F.col("c") < place), F.col("v")))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return rows.groupBy(by, "n").agg(F.round((at(low) + at(high)) / 2, 6).alias("median"), F.round(at(F.ceil(F.lit(0.95) * F.col("n"))), 6).alias("p95"))


def run_lines(run: DataFrame) -> DataFrame:
    return run.select(F.format_string("%s Q0 %d %d %.9f %s", "query_id", "id", "rank", "score", "method").alias("line"))


def qrel_lines(qrels: DataFrame) -> DataFrame:
    return qrels.select(F.format_string("%s 0 %d 1", "query_id", "chunk_id").alias("line"))
