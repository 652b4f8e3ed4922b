"""An evaluation over an index: judgements, three runs, scores, tests and timing."""

from __future__ import annotations

import time
from dataclasses import dataclass
from pathlib import Path
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import embed_query
from ..functions.stats import nearest_rank, wilcoxon_p
from ..functions.vectors import search, top
from ..operators import evaluation, retrieval
from ..session import checkpointed
from ..sources.records import read_queries, read_spans
from ..sources.sinks import write_qrels, write_run, write_scores, write_timing
from .index import Index

DEPTH = 1000
PAIRS = [("semantic", "bm25"), ("hybrid", "bm25"), ("hybrid", "semantic")]


@dataclass
class Outcome:
    qrels: DataFrame
    run: DataFrame
    scores: DataFrame
    without_relevant: list[str]


def evaluate(spark: SparkSession, index: Index, queries: DataFrame, spans: DataFrame, kappa: float = retrieval.KAPPA, stems: bool = True) -> Outcome:
    """Rankings of all queries at once and their fusion, to DEPTH, judged and scored."""
    asked = queries.withColumnRenamed("id", "query_id")
    texts = [(r.query_id, embed_query(index.embedder, r.text).tolist()) for r in asked.select("query_id", "text").collect()]
    words = checkpointed(retrieval.bm25_parsed(index.chunks, [(r.query_id, r.text) for r in asked.select("query_id", "text").collect()], stems=stems))
    dim = index.embedder.model.dim
    near = top(search(index.vectors, texts, DEPTH, "id", "vec", dim), DEPTH)
    both = retrieval.ranked(retrieval.fused(retrieval.rankings_for_fusion(words, index.vectors, texts, DEPTH, kappa, "id", "vec", dim), kappa), DEPTH)
    parts = [x.select(F.lit(m).alias("method"), "query_id", "id", "score", "rank") for m, x in (("bm25", retrieval.ranked(words, DEPTH)), ("semantic", near), ("hybrid", both))]
    run = parts[0].unionByName(parts[1]).unionByName(parts[2])
    documents = index.documents.withColumnRenamed("id", "doc_id")
    with_ids = spans if "span_id" in spans.columns else spans.withColumn("span_id", F.concat_ws("|", "category", "file", "char_start", "char_end"))
    qrels = evaluation.judged(index.chunks, evaluation.placed_spans(with_ids, documents), queries).cache()
    scores = evaluation.metrics(run, qrels, queries).cache()
    without = queries.select(F.col("id").alias("query_id")).join(qrels, "query_id", "left_anti").orderBy("query_id").collect()
    return Outcome(qrels, run, scores, [r.query_id for r in without])


def p_values(scores: DataFrame) -> dict[tuple[str, str], float | None]:
    rows = evaluation.signed_ranks(scores, PAIRS).collect()
    return {(r.method_a, r.method_b): wilcoxon_p(r.n, r.w_plus, r.w_minus, r.ties) for r in rows}


def report(scores: DataFrame, queries: DataFrame) -> str:
    """Mean scores of each kind of query and tests between methods, as text."""
    lines = []
    means = evaluation.group_means(scores, queries).collect()
    for kind in sorted({r.kind for r in means if r.kind != "all"}) + ["all"]:
        own = sorted((r for r in means if r.kind == kind), key=lambda r: r.method)
        lines.append(f"{kind} queries ({own[0].queries})")
        lines += [f"  {r.method:<10}{r.ndcg:>10.4f}{r.mrr:>10.4f}{r.r_precision:>10.4f}" for r in own]
        part = scores if kind == "all" else scores.join(queries.where(F.col("kind") == kind).select(F.col("id").alias("query_id")), "query_id", "left_semi")
        lines += [f"    {a} vs {b}: " + ("n/a" if p is None else f"{p:.4f}") for (a, b), p in p_values(part).items()]
    return "\n".join(lines) + "\n"


def timing(spark: SparkSession, index: Index, queries: DataFrame, k: int = 10, runs: int = 5) -> DataFrame:
    """query, encode_ms, scan_ms, total_ms: medians over runs after one that doesn't count."""
    rows = []
    for r in queries.orderBy("id").collect():
        index.search(r.text, k)
        taken = [index.search(r.text, k)[1] for _ in range(runs)]
        encode, scan = (median(t[c] for t in taken) * 1000 for c in ("encode", "scan"))
        rows.append((r.id, encode, scan, median(t["encode"] + t["scan"] for t in taken) * 1000))
    return spark.createDataFrame(rows, "query string, encode_ms double, scan_ms double, total_ms double")


def percentiles(timed: DataFrame) -> dict[str, tuple[float, float]]:
    """Median and nearest-rank p95 of each part."""
    rows = timed.collect()
    return {c: (median(r[c] for r in rows), nearest_rank([r[c] for r in rows], 0.95)) for c in ("encode_ms", "scan_ms", "total_ms")}


def run_all(spark: SparkSession, index: Index, queries_path: str, spans_path: str, out: str, timed: bool = False) -> str:
    """Evaluates and writes qrels, runs, scores and, if asked, timing below a folder; returns the report."""
    queries, spans = read_queries(spark, queries_path), read_spans(spark, spans_path)
    found = evaluate(spark, index, queries, spans)
    write_qrels(found.qrels, f"{out}/qrels")
    for method in ("bm25", "semantic", "hybrid"):
        write_run(found.run.where(F.col("method") == method), f"{out}/{method}")
    write_scores(found.scores, f"{out}/per_query")
    text = report(found.scores, queries)
    began = time.strftime("%Y-%m-%d")
    Path(out, "scores.txt").write_text(f"{began}\n{text}" + "".join(f"no relevant chunk: {q}\n" for q in found.without_relevant))
    if timed:
        write_timing(timing(spark, index, queries), f"{out}/timing")
    return text
