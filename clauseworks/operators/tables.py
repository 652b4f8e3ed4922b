"""Joins, samples and numberings over documents, chunks, spans and hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_name, page_at, snippet
from ..session import checkpointed
from .evaluation import valid_spans

#: Categories that say what a contract is rather than what it contains.
METADATA = ("Document Name", "Parties", "Agreement Date", "Effective Date", "Expiration Date")
SEED = "clauseworks"


def named(documents: DataFrame) -> DataFrame:
    return documents.withColumn("file", F.trim(file_name(F.col("path"))))


def span_texts(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """span_id, category, text of valid spans of known files; of files of one name the last id holds."""
    texts = named(documents).where("text is not null").groupBy("file").agg(F.max_by("text", "doc_id").alias("whole"))
    return valid_spans(spans).join(texts, "file").selectExpr("span_id", "category", "substring(whole, char_start + 1, char_end - char_start) AS text")


def enriched(hits: DataFrame, chunks: DataFrame, documents: DataFrame, length: int = 100) -> DataFrame:
    """query_id, hit_rank, chunk_id, score, file, page, snippet of every hit, once each; chunks and documents that are missing leave nulls."""
    once = hits.select("query_id", "hit_rank", "chunk_id", "score").distinct()
    rows = chunks.where("id is not null").groupBy(F.col("id").alias("chunk_id")).agg(*(F.max(c).alias(c) for c in ("doc_id", "page", "text")))
    files = named(documents).select("doc_id", "file").dropDuplicates(["doc_id"])
    joined = once.join(rows, "chunk_id", "left").join(files, "doc_id", "left")
    return joined.select("query_id", "hit_rank", "chunk_id", F.when(~F.isnan("score"), F.round(F.col("score").cast("double"), 6)).alias("score"), "file", "page", snippet(F.col("text"), length).alias("snippet"))


def evaluation_files(docs: DataFrame, spans: DataFrame) -> DataFrame:
    return docs.select(F.trim("file").alias("file")).union(spans.select(F.trim("file").alias("file"))).where("file <> ''").distinct()


def held_out(documents: DataFrame, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id and file of documents that aren't of the evaluation."""
    return named(documents).join(evaluation_files(docs, spans), "file", "left_anti").select("doc_id", "file")


def missing_files(documents: DataFrame, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Evaluation files that no document has: the check that the exclusion is complete."""
    return evaluation_files(docs, spans).join(named(documents).select("file"), "file", "left_anti")


def kept_categories(spans: DataFrame, docs: DataFrame, share: float = 0.9) -> DataFrame:
    """category and contracts with a valid span of it, for categories of content that are in at least one and at most a share of the files listed."""
    files = docs.where("trim(file) <> ''").agg(F.countDistinct(F.trim("file")).alias("files"))
    counted = valid_spans(spans).where(~F.col("category").isin(*METADATA)).groupBy("category").agg(F.countDistinct("file").alias("contracts"))
    return counted.crossJoin(F.broadcast(files)).where(F.col("contracts") <= share * F.col("files")).select("category", "contracts")  # one row


def training_pairs(spans: DataFrame, queries: DataFrame, cap: int = 20, seed: str = SEED) -> DataFrame:
    """span_id, query_id, category: spans with the query texts of their category, shuffled by a hash, cap of a category."""
    pairs = valid_spans(spans).select("span_id", "category").join(queries.select(F.col("id").alias("query_id"), "category").distinct(), "category")
    order = F.md5(F.concat_ws("|", "span_id", "query_id", F.lit(seed)))
    place = F.row_number().over(Window.partitionBy("category").orderBy(order, "span_id", "query_id"))
    return pairs.withColumn("place", place).where(F.col("place") <= cap).drop("place")


def sampled(rows: DataFrame, key: Column, n: int, seed: str = SEED) -> DataFrame:
    """n rows without replacement, the same for a seed, sorted by the key."""
    order = F.md5(F.concat_ws("|", key, F.lit(seed)))
    return rows.orderBy(order, key).limit(n).orderBy(key)


def joined_offsets(parts: DataFrame, by: str, order: str, text: str, separator: int = 2) -> DataFrame:
    """by, order, start of every part when the parts of a key are joined by a separator of that length."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(by, order, F.coalesce(F.sum(F.length(text) + separator).over(before), F.lit(0)).alias("start"))


def passage_pages(passages: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """passage_id, page on which the passage begins, by the first chunk of each page of its document; null where nothing tells."""
    starts = chunks.where("page is not null and char_start is not null").groupBy("doc_id", "page").agg(F.min("char_start").alias("off"))
    pages = starts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("off", "page"))).alias("pages"))
    files = named(documents).groupBy("file").agg(F.max("doc_id").alias("doc_id"))
    once = passages.where("passage_id is not null").groupBy("passage_id").agg(F.max(F.trim("file")).alias("file"), F.max("char_start").alias("char_start"))
    rows = once.join(files, "file", "left").join(pages, "doc_id", "left")
    return rows.select("passage_id", page_at(F.col("pages"), F.col("char_start")).alias("page"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in an order of all columns named, which must be total.

    Ranges are sorted each for itself; of every range only its size reaches the
    driver, whose running sums then shift the ranges' own numbers.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).persist()
    sizes = {r["part"]: r["count"] for r in ranges.groupBy("part").count().collect()}
    first, total = {}, 0
    for part in sorted(sizes):
        first[part], total = total, total + sizes[part]
    if not sizes:
        return rows.withColumn(name, F.lit(None).cast("bigint"))
    shift = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranges.withColumn(name, (shift[F.col("part")] + within).cast("bigint")).drop("part")


def split_by_contract(rows: DataFrame, contract: str, share: float, seed: str = SEED) -> DataFrame:
    """With part, "validation" for about a share of the contracts and "train" for the others; rows of one contract stay together."""
    place = F.conv(F.substring(F.md5(F.concat_ws("|", contract, F.lit(seed))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("part", F.when(place < share, "validation").otherwise("train"))


def numbered_within(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """Rows of each key numbered from 0 in an order.

    Keys are cut into sorted ranges, each numbered for itself and shifted by what
    lies before it, so no task holds all rows of a common key.
    """
    ranges = checkpointed(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("part", F.spark_partition_id()))
    sizes = ranges.groupBy(by, "part").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select(F.col(by).alias("shift_key"), F.col("part").alias("shift_part"), F.coalesce(before, F.lit(0)).alias("shift"))  # a row for each key and range
    within = F.row_number().over(Window.partitionBy("part", by).orderBy(*order)) - 1
    joined = ranges.withColumn(name, within).join(F.broadcast(shifts), F.col(by).eqNullSafe(F.col("shift_key")) & (F.col("part") == F.col("shift_part")))
    return joined.withColumn(name, (F.col(name) + F.col("shift")).cast("bigint")).drop("part", "shift_key", "shift_part", "shift")


def category_batches(pairs: DataFrame, category: str, order: list[str], seed: str = SEED) -> DataFrame:
    """With batch, from 0: a batch holds at most one pair of each category, in an order shuffled by a hash."""
    mixed = pairs.withColumn("mixed", F.md5(F.concat_ws("|", *order, F.lit(seed))))
    return numbered_within(mixed, category, ["mixed", *order], "batch").drop("mixed")
