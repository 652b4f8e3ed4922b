"""Building, installing and opening an index: Parquet tables and a JSON file of settings that is written last."""

from __future__ import annotations

import json
import os
import re
import shutil
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import Embedder, HashEmbedder, embed_passages, embed_query
from ..functions.text import normalize, page_of
from ..functions.vectors import search, top
from ..operators.chunking import ChunkConfig, Tokenizer, chunk_text, word_tokens
from ..sources.files import read_files, walk

TABLES = ("documents", "chunks", "vectors")
META = "meta.json"
Progress = Callable[[str, int], None]
#: Tasks up to which the best k of each are merged on the driver; of more they are ranked in Spark first.
MERGED_TASKS = 1000


class IndexFault(Exception):
    """Why an index can't be built, replaced or used."""


@dataclass(frozen=True)
class Settings:
    """What an index depends on; one built with others is refused."""

    model: str
    weights: str
    dim: int
    max_tokens: int
    overlap: int


@dataclass
class Report:
    documents: int
    chunks: int
    skipped: list[tuple[str, str]]
    seconds: dict[str, float] = field(default_factory=dict)
    warning: str | None = None


def settings_of(embedder: Embedder, config: ChunkConfig) -> Settings:
    return Settings(embedder.model.id, embedder.fingerprint(), embedder.model.dim, config.max_tokens, config.overlap)


def is_replaceable(folder: Path) -> bool:
    """Whether a folder is missing or holds only what an index has."""
    return not folder.exists() or folder.is_dir() and all(e.name in TABLES and e.is_dir() or e.name == META for e in folder.iterdir())


def is_index_folder(folder: Path, index: Path) -> bool:
    """Whether a folder is the index or one that an installation makes beside it."""
    return folder.resolve().parent == index.resolve().parent and re.fullmatch(re.escape(index.name) + r"(\.partial|\.old(-\d+)?)?", folder.name) is not None


def check_places(source: Path, index: Path) -> None:
    if source.resolve().is_relative_to(index.resolve()):
        raise IndexFault(f"the documents {source} are inside the index {index}")
    for folder in (index, index.with_name(index.name + ".partial")):
        if not is_replaceable(folder):
            raise IndexFault(f"{folder} holds other files than an index")


def install(staging: Path, index: Path) -> str | None:
    """Puts a finished index in its place; what was there comes back if that fails.  A warning if the old one can't be deleted."""
    if not is_replaceable(index):
        raise IndexFault(f"{index} holds other files than an index")
    for entry in index.parent.glob(index.name + ".old*"):
        if is_index_folder(entry, index) and is_replaceable(entry):
            shutil.rmtree(entry, ignore_errors=True)
    old, n = index.with_name(index.name + ".old"), 0
    while old.exists():
        n += 1
        old = index.with_name(f"{index.name}.old-{n}")
    if index.exists():
        os.rename(index, old)
    try:
        os.rename(staging, index)
    except OSError:
        if old.exists():
            os.rename(old, index)
        raise
    try:
        if old.exists():
            shutil.rmtree(old)
    except OSError as e:
        return f"{old} couldn't be deleted: {e}"
    return None


_PASSAGES = pa.schema([("position", pa.int64()), ("ord", pa.int32()), ("text", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("page", pa.int32())])


def passages(files: DataFrame, config: ChunkConfig, tokens: Tokenizer = word_tokens) -> DataFrame:
    """position, ord, text (normalised), char_start and char_end in the text as extracted, page where the file has pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                form = normalize(r["text"], join_hyphens=r["format"] == "pdf")
                pages = [(p["off"], p["page"]) for p in r["pages"] or []]
                for n, (s, e) in enumerate(chunk_text(form.text, config, tokens)):
                    start, end = form.source_range(s, e)
                    rows.append({"position": r["position"], "ord": n, "text": form.text[s:e], "char_start": start, "char_end": end, "page": page_of(pages, start)})
            yield pa.RecordBatch.from_pylist(rows, schema=_PASSAGES)

    return files.where("text is not null").select("position", "format", "text", "pages").mapInArrow(run, "position bigint, ord int, text string, char_start int, char_end int, page int")


def build(spark: SparkSession, source: str, index: str, embedder: Embedder | None = None, config: ChunkConfig = ChunkConfig(), progress: Progress = lambda stage, n: None) -> Report:
    """Indexes a folder; the index that was there stays until the new one is complete.

    Documents are numbered in the order of the walk without those that gave no
    text, chunks in the order of documents and of place.
    """
    embedder = embedder or HashEmbedder()
    folder, target = Path(source), Path(index)
    check_places(folder, target)
    began = time.perf_counter()
    listing = walk(folder, lambda p: is_index_folder(p, target))
    progress("Preparing", len(listing.found))
    staging = target.with_name(target.name + ".partial")
    shutil.rmtree(staging, ignore_errors=True)
    work = staging / "chunks"
    files = read_files(spark, listing.found).persist()
    # a model's chunks are measured in its own tokens, so that none is cut when it is embedded
    found = passages(files, config, getattr(embedder, "tokens", word_tokens)).persist()
    # one row of each file reaches the driver: its number of chunks or its fault
    counts = dict(found.groupBy("position").count().collect())
    faults = {r.position: (r.path, r.error) for r in files.where("error is not null").select("position", "path", "error").collect()}
    kept = sorted(counts)
    skipped = listing.skipped + [faults.get(k, (f.path, "no text")) for k, f in enumerate(listing.found) if k not in counts]
    numbers, first = [], 0
    for doc, position in enumerate(kept):
        numbers.append((position, doc, first))
        first += counts[position]
    table = spark.createDataFrame(numbers, "position bigint, doc_id bigint, first bigint")
    documents = files.join(table, "position").select(F.col("doc_id").alias("id"), "path", "format", "hash", "mtime")
    documents.write.parquet(str(staging / "documents"))
    chunks = found.join(table, "position").select((F.col("first") + F.col("ord")).alias("id"), "doc_id", "ord", "text", "char_start", "char_end", "page")
    chunks.write.parquet(str(work))
    prepared = time.perf_counter()
    progress("Embedding", first)
    embed_passages(spark.read.parquet(str(work)), embedder).write.parquet(str(staging / "vectors"))
    embedded = time.perf_counter()
    meta = asdict(settings_of(embedder, config)) | {"source": str(folder.resolve()), "documents": len(kept), "chunks": first}
    (staging / META).write_text(json.dumps(meta, indent=1))
    files.unpersist()
    found.unpersist()
    warning = install(staging, target)
    return Report(len(kept), first, skipped, {"prepare": prepared - began, "embed": embedded - prepared, "total": time.perf_counter() - began}, warning)


def read_meta(index: str | Path) -> dict:
    try:
        return json.loads(Path(index, META).read_text())
    except FileNotFoundError as e:
        raise IndexFault(f"{index} is no complete index") from e
    except ValueError as e:
        raise IndexFault(f"{index} is damaged: {e}") from e


def check_settings(meta: dict, current: Settings) -> None:
    """The first setting that differs is named."""
    for name, value in asdict(current).items():
        if name not in meta:
            raise IndexFault(f"damaged: {name} is missing")
        if meta[name] != value:
            raise IndexFault(f"the index was built with {name} {meta[name]}, not {value}; index again")


class Index:
    """An opened index."""

    def __init__(self, spark: SparkSession, index: str, embedder: Embedder | None = None, config: ChunkConfig = ChunkConfig()) -> None:
        self.spark = spark
        self.embedder = embedder or HashEmbedder()
        self.meta = read_meta(index)
        check_settings(self.meta, settings_of(self.embedder, config))
        self.documents, self.chunks, self.vectors = (spark.read.parquet(str(Path(index, t))) for t in TABLES)
        if not self.vectors.count() == self.chunks.count() == self.meta["chunks"]:
            raise IndexFault("damaged: chunks and vectors differ in number")

    def chunk(self, number: int):
        return self.chunks.where(F.col("id") == number).first()

    def document(self, number: int):
        return self.documents.where(F.col("id") == number).first()

    def search(self, text: str, k: int = 10) -> tuple[DataFrame, dict[str, float]]:
        """rank, score, id, path, page, char_start, char_end, text of the k most similar chunks, and seconds of encoding and scanning."""
        if not text.strip():
            raise ValueError("empty query")
        began = time.perf_counter()
        vec = embed_query(self.embedder, text).tolist()
        encoded = time.perf_counter()
        dim = self.embedder.model.dim
        found = search(self.vectors, [("q", vec)], k, "id", "vec", dim)
        if self.vectors.rdd.getNumPartitions() > MERGED_TASKS:
            found = top(found, k)
        best = sorted({(-r.score, r.id) for r in found.select("score", "id").collect()})[:k]
        chunks = {r.id: r for r in self.chunks.where(F.col("id").isin([i for _, i in best])).collect()}
        paths = dict(self.documents.where(F.col("id").isin([r.doc_id for r in chunks.values()])).select("id", "path").collect())
        if any(i not in chunks or chunks[i].doc_id not in paths for _, i in best):
            raise IndexFault("damaged: a hit has no chunk or document")
        rows = [(n, -score, i, paths[chunks[i].doc_id], *(chunks[i][c] for c in ("page", "char_start", "char_end", "text"))) for n, (score, i) in enumerate(best, 1)]
        hits = self.spark.createDataFrame(rows, "rank int, score double, id bigint, path string, page int, char_start int, char_end int, text string")
        return hits, {"encode": encoded - began, "scan": time.perf_counter() - encoded}


def reusable(index: str, source: str, current: Settings) -> bool:
    """Whether an index was built from this folder with these settings."""
    try:
        meta = read_meta(index)
        check_settings(meta, current)
    except IndexFault:
        return False
    return meta.get("source") == str(Path(source).resolve())
