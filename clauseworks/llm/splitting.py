"""Cutting of oversized texts at natural boundaries, with overlap, and the places of the pieces in the document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The characters of Unicode's White_Space.
WHITE = "\t-\r \x85\xa0  -     　"
_WORD = re.compile(f"[^{WHITE}]+")
_LINE = re.compile("[\n\x0b\x0c\r\x85  ]")
_SECTION = re.compile(r"(?i:section|article|schedule|annex|§)\W?$|§|\d{1,3}(?:\.\d{1,3})*[.)]?$")
_CLAUSE = re.compile(r"\([^\W_]{1,4}\)|[ivxlIVXL]{1,5}[.)]$|[a-zA-Z][.)]$|[-•*–—]")
_SENTENCE = re.compile("[.!?…。！？;:][)\\]\"'”’»]*$")
#: What the last character of a sentence may be.
_ENDS = frozenset(".!?\u2026\u3002\uff01\uff1f;:)]\"'\u201d\u2019\u00bb")
#: Longest word, in characters, that split_oversized leaves whole: words of languages and addresses are shorter, so what is
#: longer has no boundary.
MAX_CHARS = 2_000
#: Boundaries from strong to weak: section, paragraph, clause or line, sentence, word.
SECTION, PARAGRAPH, CLAUSE, SENTENCE, ANY = range(5)


def atoms(text: str, max_chars: int | None = None) -> list[tuple[int, int]]:
    """Words by place; a word of more than max_chars characters in parts of that size."""
    words = [m.span() for m in _WORD.finditer(text)]
    if max_chars is None:
        return words
    return [(k, min(k + max_chars, e)) for s, e in words for k in range(s, e, max_chars)]


def _strength(text: str, left: tuple[int, int], right: tuple[int, int]) -> int:
    """How strong the boundary between two neighbouring atoms is."""
    gap = text[left[1] : right[0]]
    if gap == " " and text[left[1] - 1] not in _ENDS:
        return ANY
    if lines := len(_LINE.findall(gap.replace("\r\n", "\n"))):
        word = text[slice(*right)]
        return SECTION if _SECTION.match(word) else PARAGRAPH if lines > 1 else CLAUSE
    if _SENTENCE.search(text, *left):
        return SENTENCE if not _CLAUSE.match(text, right[0]) else CLAUSE
    return ANY


def _units(strength: list[int], start: int, end: int, level: int, limit: int) -> Iterator[tuple[int, int]]:
    """The range cut at its boundaries of a level, parts over the limit cut again a level deeper."""
    if end - start <= limit:
        yield start, end
        return
    cuts = [start, *(k for k in range(start + 1, end) if strength[k] <= level), end]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a <= limit or level == ANY:
            yield a, b
        else:
            yield from _units(strength, a, b, level + 1, limit)


def pieces(text: str, limit: int, overlap: int, max_chars: int | None = None) -> list[tuple[int, int]]:
    """Places of the pieces of a text: at most limit words each, each next one beginning with the last overlap words of the one before.

    A text within the limit is one piece, blank text none.  Words are runs
    without white space; only one longer than max_chars is cut.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    words = atoms(text, max_chars)
    if not words:
        return []
    strength = [SECTION, *(_strength(text, a, b) for a, b in zip(words, words[1:], strict=False))]
    out: list[tuple[int, int]] = []
    start = at = 0
    for a, b in _units(strength, 0, len(words), SECTION, limit - overlap) if len(words) > limit else [(0, len(words))]:
        if b - start > limit:
            out.append((start, at))
            start = max(0, at - overlap)
        at = b
    out.append((start, at))
    return [(words[a][0], words[b - 1][1]) for a, b in out]


_SEPARATORS = re.compile("[\x1c-\x1f]")


def word_count(text: str) -> int:
    """Number of runs without white space."""
    return len(text.split()) if text.isascii() and not _SEPARATORS.search(text) else len(_WORD.findall(text))


def _longer(chunks: DataFrame, most: int) -> DataFrame:
    """Chunks of more than most words, with their number; counted in Arrow batches, which took a sixth of the time of regexp_extract_all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.array([word_count(t) for t in b.column("text").to_pylist()], np.int32)
            keep = pa.array(np.flatnonzero(words > most))
            yield pa.RecordBatch.from_arrays([*(c.take(keep) for c in b.columns), pa.array(words[keep.to_numpy()])], names=[*b.schema.names, "words"])

    rows = chunks.where("id is not null and text is not null").select(F.col("id").cast("bigint").alias("id"), F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("char_start").cast("int").alias("char_start"), F.col("source").alias("own_source"))
    return rows.mapInArrow(run, "id bigint, doc_id bigint, text string, char_start int, own_source string, words int")


def oversized(chunks: DataFrame, documents: DataFrame, config: DataFrame) -> DataFrame:
    """chunk_id, text, char_start, max_tokens and overlap of every chunk over the limit of its document's source, once each.

    Where the document is unknown the chunk's own source holds; without a limit,
    id or text a chunk isn't oversized.  Only texts over the lowest limit move.
    """
    limits = config.where("source is not null and max_tokens is not null").groupBy("source").agg(F.min("max_tokens").alias("max_tokens"), F.min_by("overlap", "max_tokens").alias("overlap"))
    low = limits.agg(F.min("max_tokens")).first()[0]
    large = _longer(chunks, 1 << 30 if low is None else low)
    large = large.groupBy("id").agg(*(F.first(c).alias(c) for c in ("doc_id", "text", "char_start", "words")), F.max("own_source").alias("own_source"))
    known = documents.where("doc_id is not null").groupBy("doc_id").agg(F.max("source").alias("doc_source"))
    placed = large.join(known, "doc_id", "left").withColumn("source", F.coalesce("doc_source", "own_source"))
    return placed.join(limits, "source").where("words > max_tokens").select(F.col("id").alias("chunk_id"), "text", "char_start", "max_tokens", F.coalesce("overlap", F.lit(0)).alias("overlap"))


def split_oversized(chunks: DataFrame, documents: DataFrame, config: DataFrame) -> DataFrame:
    """chunk_id, piece (from 0), text, char_start and char_end in the document (null where the chunk's start is), words.

    An overlap that isn't under the limit counts as the limit less one.  A word of
    more than MAX_CHARS characters is cut in parts of that size, each of which
    counts as a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for chunk, text, start, limit, overlap in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k, (s, e) in enumerate(pieces(text, max(1, limit), max(0, min(overlap, limit - 1)), MAX_CHARS)):
                    rows.append((chunk, k, text[s:e], None if start is None else start + s, None if start is None else start + e, len(_WORD.findall(text, s, e))))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["chunk_id", "piece", "text", "char_start", "char_end", "words"])

    # few texts, but much work each: spread over all cores, which sizes of partitions alone would not do
    rows = oversized(chunks, documents, config).repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_id")
    return rows.mapInArrow(run, "chunk_id bigint, piece int, text string, char_start int, char_end int, words int")
