"""Text files of the evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import qrel_lines, run_lines


def _lines(rows: DataFrame, line: str, order: list[str | Column], path: str) -> None:
    """One sorted file; for results of a stated query set, which are small."""
    rows.orderBy(*order).select(line).coalesce(1).write.mode("overwrite").text(path)


def write_run(run: DataFrame, path: str) -> None:
    rows = run_lines(run)
    parts = F.split("line", " ")
    _lines(rows, "line", [parts[0], parts[3].cast("int")], path)


def write_qrels(qrels: DataFrame, path: str) -> None:
    rows = qrel_lines(qrels)
    parts = F.split("line", " ")
    _lines(rows, "line", [parts[0], parts[2].cast("bigint")], path)


def write_scores(scores: DataFrame, path: str) -> None:
    """A row for each query and a column for each method and metric, 4 decimals."""
    wide = scores.groupBy("query_id").pivot("method").agg(*(F.format_number(F.first(c), 4).alias(c) for c in ("ndcg", "mrr", "r_precision")))
    wide.orderBy("query_id").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_timing(timing: DataFrame, path: str) -> None:
    """query, encode_ms, scan_ms, total_ms with 3 decimals."""
    rows = timing.select("query", *(F.format_string("%.3f", c).alias(c) for c in ("encode_ms", "scan_ms", "total_ms")))
    rows.orderBy("query").coalesce(1).write.mode("overwrite").csv(path, header=True)
