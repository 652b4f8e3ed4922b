"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import spread
from . import forms, leaks, neardup, neighbours, overlap, packing, residue, splitting, tokens


#: White space, as in splitting.
_NOT_WHITE = f"[^{splitting.WHITE}]+"


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(table) if name in ("documents", "chunks", "vectors") else table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(*(_read(spark, d, t) for t in ("documents", "queries", "docs", "spans")))


def p1_places(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(*(_read(spark, d, t) for t in ("documents", "queries", "docs", "spans")), places=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return forms.equal_forms(_read(spark, d, "passages"), _read(spark, d, "chunks").withColumnRenamed("id", "chunk_id"), "passage_id", "chunk_id")


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Forms that passages and chunks share in several spellings, a row each."""
    return forms.form_classes(_read(spark, d, "passages"), _read(spark, d, "chunks").withColumnRenamed("id", "chunk_id"), "passage_id", "chunk_id")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    chunks = forms.with_forms(_read(spark, d, "chunks").withColumnRenamed("id", "key"), "key").withColumn("kind", F.lit("chunk"))
    passages = forms.with_forms(_read(spark, d, "passages").withColumnRenamed("passage_id", "key"), "key").withColumn("kind", F.lit("passage"))
    rows = chunks.unionByName(passages).select("kind", "key", "form", *forms.Confusables._fields, (F.col("form_hash") != F.col("text_hash")).alias("changed"))
    return rows.dropDuplicates(["kind", "key"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(_read(spark, d, "chunks"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_groups(_read(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).where("piece = 1").select("chunk_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(*(_read(spark, d, t) for t in ("chunks", "documents", "chunk_config")))


def p3_ends(spark: SparkSession, d: str) -> DataFrame:
    """Of every oversized chunk: where its pieces begin and end in the document, and how many aren't what stands there or leave out words."""
    pieces = p3_pieces(spark, d)
    chunks = _read(spark, d, "chunks").where("id is not null").groupBy(F.col("id").alias("chunk_id")).agg(F.min("doc_id").alias("doc_id"))
    texts = _read(spark, d, "documents").where("doc_id is not null").groupBy("doc_id").agg(F.first("text").alias("whole"))
    placed = pieces.join(chunks, "chunk_id").join(texts, "doc_id")
    by_piece = Window.partitionBy("chunk_id").orderBy("piece")
    gap = F.expr("substring(whole, before + 1, char_start - before)")  # between the piece before and this one, empty where they overlap
    lost = F.coalesce((F.col("before") < F.col("char_start")) & gap.rlike(_NOT_WHITE), F.lit(False))
    other = F.col("text") != F.expr("substring(whole, char_start + 1, char_end - char_start)")
    rows = placed.withColumn("before", F.lag("char_end").over(by_piece)).select("chunk_id", "char_start", "char_end", other.alias("other"), lost.alias("lost"))
    return rows.groupBy("chunk_id").agg(F.min("char_start").alias("first_start"), F.max("char_end").alias("last_end"), F.count_if(F.col("other") | F.col("lost")).alias("wrong"))


_P5 = ("documents", "chunks", "docs", "spans")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = overlap.overlaps(*(_read(spark, d, t) for t in _P5))
    return found.select(F.least("evaluation", "training").alias("doc_a"), F.greatest("evaluation", "training").alias("doc_b"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps by class of evaluation chunks, which stays small where one clause is in many documents."""
    documents, chunks, docs, spans = (_read(spark, d, t) for t in _P5)
    return overlap.overlap_classes(chunks, documents, docs, spans)


def p5_spans(spark: SparkSession, d: str) -> DataFrame:
    """Of every overlapping pair of documents with similar chunks: merged maximal matches, words in them and in the longest."""
    documents, chunks, docs, spans = (_read(spark, d, t) for t in _P5)
    return overlap.chunk_overlaps(chunks, documents, docs, spans).select("evaluation", "training", *overlap.MOST)


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_counts(*(_read(spark, d, t) for t in _P5))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.near_pairs(_read(spark, d, "vectors"))


def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar vectors of every vector whose id is divisible by 50, against all."""
    return neighbours.nearest(_read(spark, d, "vectors"), every=50)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_read(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and digest of the text decoded from its ids."""
    decoded = tokens.decode(tokens.encode(_read(spark, d, "documents")))
    return decoded.select("doc_id", F.md5("text").alias("md5"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(_read(spark, d, "documents"), _read(spark, d, "chunk_config"))


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    """Containers, parts, tokens, tokens that would have fitted besides, and containers not full."""
    boxes = p8_containers(spark, d).where("container_id is not null").groupBy("container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts"), F.max("capacity").alias("capacity"))
    free = F.col("capacity") - F.col("tokens")
    return boxes.agg(F.count("*").alias("containers"), F.sum("parts").alias("parts"), F.sum("tokens").alias("tokens"), F.sum(free).alias("unused"), F.count_if(free > 0).alias("not_full"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(_read(spark, d, "documents"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """doc_id of the corpus without residue."""
    documents = _read(spark, d, "documents")
    return documents.where("doc_id is not null").select("doc_id").distinct().join(residue.residue_documents(documents), "doc_id", "left_anti")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """What SQL can say; the other operators are held against brute force in the tests."""
    usable = "len(vec) = 64 AND list_sum(list_transform(vec, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 1 ELSE 0 END)) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0"
    return {
        "p3_found": f"""WITH c AS (SELECT id, first(doc_id) AS doc_id, max(source) AS source, len(regexp_extract_all(first(text), '{_NOT_WHITE}')) AS words FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, max(source) AS of_document FROM documents GROUP BY 1), l AS (SELECT source, min(max_tokens) AS most FROM chunk_config GROUP BY 1)
SELECT id AS chunk_id FROM c LEFT JOIN d USING (doc_id) JOIN l ON l.source = coalesce(of_document, c.source) WHERE words > most""",
        "p3_ends": f"""WITH c AS (SELECT id, first(doc_id) AS doc_id, max(source) AS source, first(text) AS text, min(char_start) AS char_start, len(regexp_extract_all(first(text), '{_NOT_WHITE}')) AS words FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, max(source) AS of_document FROM documents GROUP BY 1), l AS (SELECT source, min(max_tokens) AS most FROM chunk_config GROUP BY 1)
SELECT id AS chunk_id, (char_start + length(text) - length(regexp_replace(text, '^[{splitting.WHITE}]+', '')))::INT AS first_start, (char_start + length(regexp_replace(text, '[{splitting.WHITE}]+$', '')))::INT AS last_end, 0::BIGINT AS wrong
FROM c LEFT JOIN d USING (doc_id) JOIN l ON l.source = coalesce(of_document, c.source) WHERE words > most""",
        "p6_found": f"""WITH v AS (SELECT chunk_id AS id, CAST(first(vec) AS DOUBLE[]) AS vec FROM vectors WHERE {usable} GROUP BY 1),
pairs AS (SELECT a.id, b.id AS near, list_cosine_similarity(a.vec, b.vec) AS score FROM v a JOIN v b ON a.id <> b.id),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, near) AS place FROM pairs WHERE score >= 0.9)
SELECT DISTINCT least(id, near) AS id_a, greatest(id, near) AS id_b FROM placed WHERE place <= 10""",
        "p7_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents",
    }
