"""Queries that go through files: what sinks write of the tables and sources read again."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation
from ..session import checkpointed, shared_folder, spread
from ..sources import records, sinks
from . import index


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query_file(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation queries, written a JSON object a line and read with all checks."""
    path = shared_folder(spark) / "queries.jsonl"
    rows = _t(spark, d, "queries").select("id", "category", F.col("kind").alias("type"), "text").dropDuplicates(["id"]).orderBy("id")
    path.write_text("\n\n".join(r[0] for r in rows.select(F.to_json(F.struct("*"))).collect()), "utf-8")
    return records.read_queries(spark, str(path))


def span_file(spark: SparkSession, d: str) -> DataFrame:
    """Valid spans, tab-separated without header."""
    path = str(shared_folder(spark) / "spans.tsv")
    rows = evaluation.valid_spans(_t(spark, d, "spans")).select("category", "file", F.col("char_start").cast("string"), F.col("char_end").cast("string"))
    rows.select(F.concat_ws("\t", "category", "file", "char_start", "char_end")).write.text(path)
    return records.read_spans(spark, path)


def name_file(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation files, a name a line, blanks and repeated rows as they are in the table."""
    path = str(shared_folder(spark) / "docs.txt")
    _t(spark, d, "docs").select(F.coalesce("file", F.lit(""))).write.text(path)
    return records.read_names(spark, path)


def run_file(spark: SparkSession, d: str) -> DataFrame:
    """The earlier run as a run file holds it, read again."""
    path = str(shared_folder(spark) / "run")
    rows = _t(spark, d, "hits").where("score is not null and not isnan(score)").select("query_id", F.col("chunk_id").alias("id"), F.col("hit_rank").alias("rank"), F.round(F.col("score").cast("double"), 6).alias("score"), F.lit("earlier").alias("method")).distinct()
    sinks.write_run(rows, path)
    return records.read_run(spark, path)


def qrel_file(spark: SparkSession, d: str) -> DataFrame:
    """Judgements as a file of them holds them, read again."""
    path = str(shared_folder(spark) / "qrels")
    placed = evaluation.placed_spans(_t(spark, d, "spans"), _t(spark, d, "documents"))
    sinks.write_qrels(evaluation.judged(_t(spark, d, "chunks"), placed, _t(spark, d, "queries")), path)
    return records.read_qrels(spark, path)


def vector_file(spark: SparkSession, d: str) -> DataFrame:
    """All vectors as one file of 32-bit numbers, read in ranges: row, place, value."""
    path = shared_folder(spark) / "vectors.f32"
    records.write_raw_vectors(_t(spark, d, "embeddings").orderBy("vec_id").select("embedding"), path)
    rows = records.read_raw_vectors(spark, str(path), 64)
    return rows.select("id", F.posexplode("vec").alias("place", "value")).select("id", F.col("place").cast("bigint").alias("place"), F.round(F.col("value").cast("double"), 6).alias("value"))


def _export(documents: DataFrame, folder: str) -> None:
    """Texts as files named by doc_id, written where the tasks are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                Path(folder, f"{doc}.txt").write_bytes(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], names=["n"])

    documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def index_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as text files, walked, indexed and opened: the chunks, and what stands in the file at each one's place, normalised."""
    work = shared_folder(spark)
    (work / "texts").mkdir()
    _export(spread(_t(spark, d, "documents")), str(work / "texts"))
    index.build(spark, str(work / "texts"), str(work / "index"))
    opened = index.Index(spark, str(work / "index"))
    files = opened.documents.select(F.col("id").alias("number"), F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint").alias("doc_id"))
    texts = _t(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", "^﻿", "").alias("whole"))
    rows = opened.chunks.withColumnRenamed("doc_id", "number").join(files, "number").join(texts, "doc_id")
    place = F.substring("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return rows.select("doc_id", "ord", F.md5("text").alias("md5"), F.md5(tx.normalized(place)).alias("source_md5"))


def index_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Documents, chunks and vectors of an index of the documents' texts, and whether a second look would use it again."""
    work = shared_folder(spark)
    (work / "texts").mkdir()
    _export(spread(_t(spark, d, "documents")), str(work / "texts"))
    report = index.build(spark, str(work / "texts"), str(work / "index"))
    opened = index.Index(spark, str(work / "index"))
    again = index.reusable(str(work / "index"), str(work / "texts"), index.settings_of(opened.embedder, index.ChunkConfig()))
    counted = checkpointed(opened.chunks.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.max("id").alias("last_id")))
    return counted.select("chunks", "documents", "last_id", F.lit(len(report.skipped)).cast("bigint").alias("skipped"), F.lit(again).alias("reusable"))


NAMES = "query_file span_file name_file run_file qrel_file vector_file index_chunks index_numbers"
