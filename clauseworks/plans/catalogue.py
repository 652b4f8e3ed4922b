"""Named queries over the project's tables, each with the same question in DuckDB's SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import chunking, evaluation, retrieval, tables, training
from ..session import checkpointed, spread
from . import exchange

KAPPAS = (1, 5, 20, 60)
PAIRS = [("semantic", "bm25"), ("hybrid", "bm25"), ("hybrid", "semantic")]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(table) if name in ("documents", "chunks") else table


def _long(name: str) -> Column:
    """A number as SQL's functions give it."""
    return F.col(name).cast("bigint").alias(name)


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "queries").withColumnRenamed("id", "query_id")


# vectors


def _asked(spark: SparkSession, d: str, where: str) -> list[tuple[int, list[float]]]:
    """The stated query set."""
    return [(r[0], r[1]) for r in _t(spark, d, "embeddings").where(where).select("vec_id", "embedding").collect()]


def nearest_to_one(spark: SparkSession, d: str) -> DataFrame:
    found = vx.top(vx.search(_t(spark, d, "embeddings"), _asked(spark, d, "vec_id = 0"), 10, "vec_id", "embedding", 64, "bigint"), 10)
    return found.select("id", F.round("score", 6).alias("score"), _long("rank"))


def nearest_of_each(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest, itself among them, of every vector whose id is divisible by 50."""
    found = vx.top(vx.search(_t(spark, d, "embeddings"), _asked(spark, d, "vec_id % 50 = 0"), 5, "vec_id", "embedding", 64, "bigint"), 5)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), _long("rank"))


def label_recall(spark: SparkSession, d: str) -> DataFrame:
    """By label of the query, share of the ten nearest others that have it, and how often the nearest has."""
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    found = vx.top(vx.search(_t(spark, d, "embeddings"), _asked(spark, d, "vec_id % 50 = 0"), 11, "vec_id", "embedding", 64, "bigint"), 11).where("query_id <> id")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("place <= 10")
    own = labels.select(F.col("id").alias("query_id"), F.col("label").alias("own"))
    rows = found.join(labels, "id").join(own, "query_id").withColumn("same", (F.col("label") == F.col("own")).cast("double"))
    return rows.groupBy("own").agg(F.countDistinct("query_id").alias("queries"), F.round(F.avg("same"), 6).alias("recall"), F.sum(F.when(F.col("place") == 1, F.col("same"))).alias("top_1"))


def _unit_values(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", "label", F.posexplode(vx.normalized(F.col("embedding"))).alias("place", "value"))


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _unit_values(spark, d).select("vec_id", _long("place"), F.round("value", 6).alias("value"))


def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    return _unit_values(spark, d).groupBy("label", _long("place")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


def label_margin(spark: SparkSession, d: str) -> DataFrame:
    """By label, mean cosine of its vectors to others of the label less that to other labels.

    Mean cosines come from sums of unit vectors, so no pair of vectors is formed.
    """
    values = _unit_values(spark, d)
    sums = values.groupBy("label", "place").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    total = sums.groupBy("place").agg(F.sum("s").alias("all"), F.sum("n").alias("m"))
    rows = sums.join(total, "place").groupBy("label").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.sum(F.col("s") * F.col("s")).alias("own"), F.sum(F.col("s") * (F.col("all") - F.col("s"))).alias("other"))
    own = (F.col("own") - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    return rows.where("n > 1 and m > n").select("label", F.round(own - F.col("other") / (F.col("n") * (F.col("m") - F.col("n"))), 6).alias("margin"))


def vector_faults(spark: SparkSession, d: str) -> DataFrame:
    """Number of vectors by what is wrong with them."""
    v = F.col("vec")
    fault = F.when(v.isNull(), "null").when(F.size(v) != 64, "length").when(~F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), "not finite").when(~F.exists(v, lambda x: x != 0), "zero").otherwise("usable")
    return _t(spark, d, "vectors").dropDuplicates(["chunk_id"]).groupBy(fault.alias("fault")).count().withColumnRenamed("count", "n")


def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return vx.hash_embedding(_t(spark, d, "documents"), "doc_id", "text").withColumn("value", F.round("value", 6))


# text


def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text is not null").select("doc_id", F.md5(tx.normalized(F.col("text"))).alias("md5"))


def joined_hyphens(spark: SparkSession, d: str) -> DataFrame:
    pdf = _t(spark, d, "documents").where("text is not null").where(tx.file_format(F.col("path")) == "pdf")
    return pdf.select("doc_id", F.md5(tx.joined_hyphens(tx.normalized(F.col("text")))).alias("md5"))


def clause_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split(tx.normalized(F.col("text")), "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(tx.is_clause_line(F.col("line"))).alias("clauses"))


def clause_units(spark: SparkSession, d: str) -> DataFrame:
    texts = _t(spark, d, "documents").where("text is not null").select("doc_id", tx.normalized(F.col("text")).alias("text"))
    return chunking.units(texts).select("doc_id", "unit", F.md5("text").alias("md5"))


def packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    texts = _t(spark, d, "documents").where("text is not null").select("doc_id", tx.normalized(F.col("text")).alias("text"))
    return chunking.chunk_documents(texts)


def word_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.word_windows(_t(spark, d, "documents"), _t(spark, d, "chunk_config"))
    return rows.select("doc_id", "ord", "words", F.md5("text").alias("md5"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text is not null").select("doc_id", tx.snippet(F.col("text"), 100).alias("snippet"))


def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.lower(F.hex("hash")).alias("hash"))


def document_formats(spark: SparkSession, d: str) -> DataFrame:
    """Documents and declared formats by the format of the file name."""
    rows = _t(spark, d, "documents").select(tx.file_format(F.col("path")).alias("format"), "doc_format")
    return rows.groupBy("format", "doc_format").agg(F.count("*").alias("n"))


def shared_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """Queries and spans whose texts share a run of three words, and how many; an audit that should find few."""
    asked = _t(spark, d, "queries").select("id", F.explode(tx.trigrams(F.col("text"))).alias("trigram")).distinct()
    placed = tables.span_texts(_t(spark, d, "spans"), _t(spark, d, "documents")).select("span_id", F.explode(tx.trigrams(F.col("text"))).alias("trigram")).distinct()
    return asked.join(placed, "trigram").groupBy("id", "span_id").agg(F.count("*").alias("shared"))


# retrieval


def _top(rows: DataFrame) -> DataFrame:
    return retrieval.ranked(rows, 10).select("query_id", "id", F.round("score", 6).alias("score"), _long("rank"))


def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    return _top(retrieval.bm25(_t(spark, d, "documents"), _queries(spark, d), "doc_id"))


def bm25_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _top(retrieval.bm25(_t(spark, d, "chunks"), _queries(spark, d)))


def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return _top(retrieval.bm25(_t(spark, d, "chunks"), _queries(spark, d), stems=True))


def bm25_parsed(spark: SparkSession, d: str) -> DataFrame:
    """With phrases and signs of the query texts, stemmed."""
    asked = [(r.id, r.text) for r in _t(spark, d, "queries").collect()]
    return _top(retrieval.bm25_parsed(_t(spark, d, "chunks"), asked))


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.semantic(_t(spark, d, "vectors"), _queries(spark, d), 10).select("query_id", "id", F.round("score", 6).alias("score"), _long("rank"))


def _asked_vectors(spark: SparkSession, d: str) -> list[tuple[str, list[float]]]:
    return [(r.query_id, r.vec) for r in _queries(spark, d).select("query_id", "vec").collect() if r.vec is not None and len(r.vec) == 64]


def _words(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_t(spark, d, "chunks"), _queries(spark, d))


def _both(spark: SparkSession, d: str, words: DataFrame, depth: int, kappa: float) -> list[DataFrame]:
    """Places by words and by vectors of what can be among the first depth of the fusion."""
    return retrieval.rankings_for_fusion(words, _t(spark, d, "vectors"), _asked_vectors(spark, d), depth, kappa)


def hybrid_kappa_5(spark: SparkSession, d: str) -> DataFrame:
    return _top(retrieval.fused(_both(spark, d, _words(spark, d), 10, 5), 5))


def hybrid_kappa_60(spark: SparkSession, d: str) -> DataFrame:
    return _top(retrieval.fused(_both(spark, d, _words(spark, d), 10, 60), 60))


def _run(spark: SparkSession, d: str, depth: int = 1000) -> DataFrame:
    """method, query_id, id, score, rank of three methods, cut at a depth."""
    words = checkpointed(_words(spark, d))
    near = retrieval.semantic(_t(spark, d, "vectors"), _queries(spark, d), depth)
    both = retrieval.ranked(retrieval.fused(_both(spark, d, words, depth, retrieval.KAPPA)), depth)
    rows = [x.select(F.lit(m).alias("method"), "query_id", "id", "score", "rank") for m, x in (("bm25", retrieval.ranked(words, depth)), ("semantic", near), ("hybrid", both))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def hit_details(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the earlier run with file, page and snippet of their chunks."""
    return tables.enriched(_t(spark, d, "hits"), _t(spark, d, "chunks"), _t(spark, d, "documents"))


# evaluation


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.placed_spans(_t(spark, d, "spans"), _t(spark, d, "documents"))


def span_islands(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.merged(_placed(spark, d), ["category", "doc_id"])


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.judged(_t(spark, d, "chunks"), _placed(spark, d), _t(spark, d, "queries"))


def relevant_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _qrels(spark, d)


def relevance_counts(spark: SparkSession, d: str) -> DataFrame:
    """Relevant chunks of every query, also where there are none."""
    return _t(spark, d, "queries").select(F.col("id").alias("query_id")).join(_qrels(spark, d), "query_id", "left").groupBy("query_id").agg(F.count("chunk_id").alias("relevant"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics(_run(spark, d), _qrels(spark, d), _t(spark, d, "queries"))


def metrics_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def metrics_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.group_means(_scores(spark, d), _t(spark, d, "queries"))


def signed_ranks(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.signed_ranks(_scores(spark, d), PAIRS)


def _kappa_scores(spark: SparkSession, d: str) -> DataFrame:
    run = retrieval.ranked(retrieval.fused_for(_both(spark, d, _words(spark, d), 10, max(KAPPAS)), KAPPAS), 10, ("method", "query_id"))
    position = F.create_map(*(F.lit(x) for n, k in enumerate(KAPPAS) for x in (f"kappa {k}", n)))
    return evaluation.metrics(run, _qrels(spark, d), _t(spark, d, "queries")).select(F.col("method").alias("setting"), position[F.col("method")].alias("position"), "query_id", "ndcg")


def kappa_by_fold(spark: SparkSession, d: str) -> DataFrame:
    """The kappa chosen without each category's queries, and its mean on them."""
    return evaluation.cross_validated(_kappa_scores(spark, d), F.substring("query_id", 1, 3))


def kappa_votes(spark: SparkSession, d: str) -> DataFrame:
    return kappa_by_fold(spark, d).groupBy("setting").agg(F.count("*").alias("folds"))


def run_lines(spark: SparkSession, d: str) -> DataFrame:
    """All three methods at depth 1000, as run files hold them."""
    return evaluation.run_lines(_run(spark, d).withColumn("score", F.round(F.col("score") + 1e-10, 6)))


def qrel_lines(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.qrel_lines(_qrels(spark, d))


def latency_by_type(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latency(_t(spark, d, "events"), "value", "event_type")


# preparation of the evaluation set


def kept_categories(spark: SparkSession, d: str) -> DataFrame:
    return tables.kept_categories(_t(spark, d, "spans"), _t(spark, d, "docs"))


def held_out_documents(spark: SparkSession, d: str) -> DataFrame:
    return tables.held_out(_t(spark, d, "documents"), _t(spark, d, "docs"), _t(spark, d, "spans"))


def missing_evaluation_files(spark: SparkSession, d: str) -> DataFrame:
    return tables.missing_files(_t(spark, d, "documents"), _t(spark, d, "docs"), _t(spark, d, "spans"))


def training_pairs(spark: SparkSession, d: str) -> DataFrame:
    return tables.training_pairs(_t(spark, d, "spans"), _t(spark, d, "queries"))


def training_batches(spark: SparkSession, d: str) -> DataFrame:
    return tables.category_batches(training_pairs(spark, d), "category", ["span_id", "query_id"]).withColumn("batch", _long("batch"))


def contract_parts(spark: SparkSession, d: str) -> DataFrame:
    """Valid spans, a fifth of the contracts kept for validation."""
    return tables.split_by_contract(evaluation.valid_spans(_t(spark, d, "spans")).select("span_id", "file"), "file", 0.2)


def sampled_documents(spark: SparkSession, d: str) -> DataFrame:
    return tables.sampled(_t(spark, d, "documents").select("doc_id", "path"), F.col("path"), 30)


def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each chunk of a document would begin if the chunks were pages joined by a blank line."""
    return tables.joined_offsets(_t(spark, d, "chunks").where("id is not null").dropDuplicates(["id"]), "doc_id", "ord", "text")


def passage_pages(spark: SparkSession, d: str) -> DataFrame:
    return tables.passage_pages(_t(spark, d, "passages"), _t(spark, d, "documents"), _t(spark, d, "chunks"))


def dense_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Chunks numbered from 0 in the order of path and place."""
    chunks = _t(spark, d, "chunks").where("id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.min("ord").alias("ord"))
    rows = chunks.join(_t(spark, d, "documents").select("doc_id", "path").dropDuplicates(["doc_id"]), "doc_id")
    return tables.numbered(rows, ["path", "ord", "id"], "number").select("id", "number")


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents, chunks, passages: rows and distinct keys."""
    parts = [_t(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("row_count"), F.countDistinct(k).alias("keys")) for t, k in (("documents", "doc_id"), ("chunks", "id"), ("passages", "passage_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# training


TEMPERATURES = (0.02, 0.05, 0.1, 0.2)


def _vector_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring vectors as anchor and positive, in flat batches of 32."""
    rows = _t(spark, d, "embeddings").select("vec_id", "embedding")
    anchors = rows.where("vec_id % 2 = 0").select("vec_id", F.col("embedding").alias("anchor"))
    positives = rows.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("positive"))
    pairs = anchors.join(positives, "vec_id").select(F.floor(F.col("vec_id") / 2).cast("bigint").alias("pair"), "anchor", "positive")
    return training.flat_batches(pairs, F.col("pair"), 32)


def validation_loss(spark: SparkSession, d: str) -> DataFrame:
    """Loss and accuracy of the first place, by temperature."""
    return training.contrastive(_vector_pairs(spark, d), TEMPERATURES)


def best_temperature(spark: SparkSession, d: str) -> DataFrame:
    return training.best_setting(validation_loss(spark, d), "temperature")


def warm_up(spark: SparkSession, d: str) -> DataFrame:
    return training.warm_up(spark, 300, 2e-5, 100).withColumn("rate", F.round("rate", 12))


def template_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether queries are tied to their labels: margins, first hits and the sign test."""
    labels = _t(spark, d, "embeddings").select("label").distinct().count()
    return training.template_gate(label_margin(spark, d), label_recall(spark, d), labels)


_NAMES = (
    "hybrid_kappa_5 nearest_to_one nearest_of_each label_recall unit_vectors label_centroids label_margin vector_faults hash_embeddings normalized_text joined_hyphens clause_lines clause_units packed_chunks word_windows snippets text_hashes"
    " document_formats shared_trigrams bm25_documents bm25_chunks bm25_stemmed bm25_parsed semantic_chunks hybrid_kappa_60 hit_details span_islands relevant_chunks relevance_counts metrics_per_query metrics_by_kind signed_ranks kappa_by_fold kappa_votes"
    " run_lines qrel_lines latency_by_type kept_categories held_out_documents missing_evaluation_files training_pairs training_batches contract_parts sampled_documents page_offsets passage_pages dense_chunk_ids table_counts validation_loss best_temperature warm_up template_gate"
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _NAMES.split()} | {name: getattr(exchange, name) for name in exchange.NAMES.split()}
