"""Files of the evaluation: queries, spans, runs, judgements, scores, nested contracts, raw vectors."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BadRecord(ValueError):
    """A line that breaks its format, named by its number from 1."""


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """id, category, kind, text of a JSONL file; blank lines are passed over, a missing, other than text or empty field is an error.

    A query set is small by nature: it is read on the driver so that an error can
    name its line.
    """
    rows = []
    for n, line in enumerate(Path(path).read_text("utf-8").splitlines(), 1):
        if not line.strip():
            continue
        try:
            record = json.loads(line)
        except ValueError as e:
            raise BadRecord(f"{path}, line {n}: {e}") from e
        values = [record.get(k) if isinstance(record, dict) else None for k in ("id", "category", "type", "text")]
        if not all(isinstance(v, str) for v in values):
            raise BadRecord(f"{path}, line {n}: id, category, type and text must be text")
        if values[2] not in ("matched", "paraphrased"):
            raise BadRecord(f"{path}, line {n}: unknown type {values[2]}")
        if not values[3].strip():
            raise BadRecord(f"{path}, line {n}: empty text")
        rows.append(tuple(values))
    return spark.createDataFrame(rows, "id string, category string, kind string, text string")


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """category, file, char_start, char_end of a tab-separated file without header; every line needs four fields and start before end."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parts = F.split("value", "\t")
    start, end = (F.expr(f"try_cast(try_element_at(split(value, '\t'), {k}) AS INT)") for k in (3, 4))
    good = (F.size(parts) == 4) & (start >= 0) & (start < end)
    checked = F.when(F.coalesce(good, F.lit(False)), parts).otherwise(F.raise_error(F.concat(F.lit("bad span: "), "value")))
    return lines.select(checked.alias("p")).selectExpr("p[0] AS category", "p[1] AS file", "CAST(p[2] AS INT) AS char_start", "CAST(p[3] AS INT) AS char_end")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """file: the names of a list, one a line, without outer blanks, each once."""
    return spark.read.text(path).select(F.trim("value").alias("file")).where("file <> ''").distinct()


def read_run(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", " ")
    return spark.read.text(path).select(p[0].alias("query_id"), p[2].cast("bigint").alias("id"), p[3].cast("int").alias("rank"), p[4].cast("double").alias("score"), p[5].alias("method"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", " ")
    return spark.read.text(path).where("value <> ''").select(p[0].alias("query_id"), p[2].cast("bigint").alias("chunk_id"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """method, query_id, kind, ndcg, mrr, r_precision of a table with a column for each method and metric."""
    table = spark.read.csv(path, header=True)
    methods = sorted({c.rsplit(" ", 1)[0] for c in table.columns if " " in c})
    metric = {"ndcg": "ndcg@10", "mrr": "mrr@10", "r_precision": "r-precision"}
    rows = [table.select(F.lit(m).alias("method"), F.col("query").alias("query_id"), F.col("type").alias("kind"), *(F.col(f"`{m} {c}`").cast("double").alias(k) for k, c in metric.items())) for m in methods]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def read_contracts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """title, text; and title, category, char_start, char_end: contracts and answers of a nested question file.

    The category is what follows the last "__" of a question's id; an answer that
    isn't what stands at its place is an error.
    """
    schema = "data array<struct<title:string, paragraphs:array<struct<context:string, qas:array<struct<id:string, question:string, answers:array<struct<answer_start:int, text:string>>>>>>>>"
    contracts = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("data").alias("d")).select("d.title", F.explode("d.paragraphs").alias("p"))
    answers = contracts.select("title", F.col("p.context").alias("context"), F.explode("p.qas").alias("q")).select("title", "context", F.element_at(F.split("q.id", "__"), -1).alias("category"), F.explode("q.answers").alias("a"))
    right = F.expr("substring(context, a.answer_start + 1, length(a.text))") == F.col("a.text")
    start = F.when(right, F.col("a.answer_start")).otherwise(F.raise_error(F.concat(F.lit("answer isn't in its place: "), "title")).cast("int"))
    spans = answers.select("title", "category", start.alias("char_start"), (start + F.length("a.text")).alias("char_end"))
    return contracts.select("title", F.col("p.context").alias("text")), spans


#: Rows of a raw vector file that a task reads at a time.
RAW_ROWS = 100_000


def read_raw_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """id and vec of a file of little-endian 32-bit floats, dim for each row from 0; another length is an error.

    The driver looks at the length only; tasks, which must see the file, read ranges of rows.
    """
    size = Path(path).stat().st_size
    if size % (4 * dim):
        raise BadRecord(f"{path}: {size // 4} numbers aren't rows of {dim}")
    rows = size // (4 * dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in b.column(0).to_pylist():
                n = min(RAW_ROWS, rows - first)
                values = np.fromfile(path, "<f4", n * dim, offset=4 * dim * first).astype(np.float32)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(ends, pa.array(values))], names=["id", "vec"])

    return spark.range(0, rows, RAW_ROWS).mapInArrow(run, "id bigint, vec array<float>")


def write_raw_vectors(vectors: DataFrame, path: str | Path) -> int:
    """The vectors of the only column, in their order, as one such file; the number of rows.  They pass the driver one partition at a time."""
    n = 0
    with open(path, "wb") as f:
        for row in vectors.toLocalIterator():
            f.write(np.array(row[0], "<f4").tobytes())
            n += 1
    return n
