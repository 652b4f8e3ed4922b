"""Documents that arrive while the engine runs, as streams; beyond what batch indexing does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import ChunkConfig, chunk_documents

DOCUMENT = "doc_id bigint, path string, doc_format string, hash binary, mtime bigint, lang string, source string, text string, n_chars bigint, indexed_at timestamp"


def arriving_documents(spark: SparkSession, folder: str, schema: str = DOCUMENT, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def new_documents(documents: DataFrame, late: str = "2 days") -> DataFrame:
    """Each document once, however often it is delivered; deliveries later than the watermark allows are dropped as late."""
    return documents.where("doc_id is not null").withWatermark("indexed_at", late).dropDuplicatesWithinWatermark(["doc_id"])


def index_stream(documents: DataFrame, out: str, checkpoint: str, config: ChunkConfig = ChunkConfig()) -> StreamingQuery:
    """Chunks of new documents, appended to a Parquet table exactly once; takes what is there and ends."""
    chunks = chunk_documents(new_documents(documents), config)
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def arrivals(documents: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, source, documents, characters by window of arrival; a window is final when the watermark has passed it."""
    rows = documents.withWatermark("indexed_at", late).groupBy(F.window("indexed_at", window).alias("w"), "source")
    return rows.agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters")).select(F.col("w.start").alias("start"), "source", "documents", "characters")
