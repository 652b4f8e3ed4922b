"""Clause units, packing of units to chunks, and windows of words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BREAKS, CLAUSE_LINE, SPACES, words

_CLAUSE = regex.compile(CLAUSE_LINE)
#: What a clause line begins with, at least.
_LIKELY = re.compile(r"[0-9(]|[A-Za-z]{1,5}\.\s|(?:section|article)\s", re.IGNORECASE)
_WORD = re.compile(f"[^{BREAKS}{SPACES}]+")
#: What split() takes for white space besides.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANK = frozenset("\n\x0b\x0c\r\x85\u2028\u2029\t \xa0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
_STRIPPED = "".join(_BLANK)
#: Places of the tokens of a text.
Tokenizer = Callable[[str], list[tuple[int, int]]]


@dataclass(frozen=True)
class ChunkConfig:
    """Tokens of a chunk at most, and tokens that windows of an overlong unit share."""

    max_tokens: int = 200
    overlap: int = 40

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.max_tokens:
            raise ValueError(f"overlap {self.overlap} must be less than max_tokens {self.max_tokens}")


def word_tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def word_count(text: str) -> int:
    """len(word_tokens(text)), without the places."""
    return len(text.split()) if text.isascii() and not _SEPARATORS.search(text) else len(_WORD.findall(text))


def split_units(text: str) -> list[tuple[int, int]]:
    """Places of the units of a normalised text: paragraphs, cut before every clause line, without blank ends; blank ones dropped."""
    units: list[tuple[int, int]] = []
    start: int | None = None
    end = at = 0
    for line in text.split("\n"):
        blank = not line or line[0] in _BLANK and not line.strip(_STRIPPED)
        if start is not None and (blank or _LIKELY.match(line) and _CLAUSE.match(line)):
            units.append((start, end))
            start = None
        if not blank:
            start = at if start is None else start
            end = at + len(line if line[-1] not in _BLANK else line.rstrip(_STRIPPED))
        at += len(line) + 1
    if start is not None:
        units.append((start, end))
    return units


def windows(count: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges of windows of a size that overlap; the last one reaches the end and none begins after it."""
    out = []
    for start in range(0, max(1, count), size - overlap):
        out.append((start, min(start + size, count)))
        if start + size >= count:
            break
    return out


def chunk_text(text: str, config: ChunkConfig = ChunkConfig(), tokens: Tokenizer = word_tokens) -> list[tuple[int, int]]:
    """Places of chunks: units packed as far as their own token counts add up to max_tokens; a longer unit is cut into windows by itself."""
    out: list[tuple[int, int]] = []
    start, end, held = 0, 0, 0
    count = word_count if tokens is word_tokens else lambda t: len(tokens(t))
    for a, b in split_units(text):
        unit = text[a:b]
        n = count(unit)
        if held and held + n > config.max_tokens:
            out.append((start, end))
            held = 0
        if n > config.max_tokens:
            own = tokens(unit)
            out += [(a + own[s][0], a + own[e - 1][1]) for s, e in windows(n, config.max_tokens, config.overlap)]
        elif n:
            start, end, held = (start if held else a), b, held + n
    if held:
        out.append((start, end))
    return out


def chunk_documents(documents: DataFrame, config: ChunkConfig = ChunkConfig(), tokens: Tokenizer = word_tokens, key: str = "doc_id") -> DataFrame:
    """key, ord, text, char_start, char_end of the chunks of normalised texts; nothing for null and blank ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, n, t[s:e], s, e) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for n, (s, e) in enumerate(chunk_text(t, config, tokens))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[key, "ord", "text", "char_start", "char_end"])

    # not filtered by text here: on a computed column the filter would be pushed down as all of its expression
    return documents.select(F.col(key).cast("bigint").alias(key), "text").mapInArrow(run, f"{key} bigint, ord int, text string, char_start int, char_end int")


#: A break before a clause line of normalised text, where white space is a space or a break; what may follow to the line's end is left out.
_BEFORE_CLAUSE = (
    r"(?m)\n(?=[0-9(SsAa]|[A-Za-z]{1,5}\.)(?="
    + CLAUSE_LINE[1:].replace(r"\s[^\p{Ll}\s].*$", r"\s[^\p{Ll}\s]").replace(r"(\s.*)?$", "(?: |$)").replace(r"\s.*", r"\s").replace(r"[^\p{Ll}\s].*$", r"[^\p{Ll}\s]").replace(r"[^\p{Ll}\s]", r"[^\p{Ll} \n]").replace(r"[^\s\p{L}]", r"[^ \n\p{L}]").replace(r"\s", " ")
    + ")"
)
_MARK = "\x1e"


def units(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, unit (from 0), text of the clause units of normalised texts.

    A mark is put before every clause line and texts are split at marks and blank
    lines, so no line becomes a row and nothing is shuffled.
    """
    marked = F.regexp_replace(F.replace("text", F.lit(_MARK), F.lit(" ")), _BEFORE_CLAUSE, _MARK)
    parts = F.transform(F.split(marked, f"\n\n|{_MARK}"), lambda u: F.regexp_replace(u, f"[{BREAKS}{SPACES}]+$", ""))
    return documents.select(key, F.posexplode(F.filter(parts, lambda u: u != "")).alias("unit", "text"))


def word_windows(documents: DataFrame, limits: DataFrame | None = None, size: int = 200, overlap: int = 40, key: str = "doc_id") -> DataFrame:
    """key, ord, words, text of windows over the words of each text, by the limits (source, max_tokens, overlap) of its source if given.

    A text within the size has one window, a blank one none.
    """
    rows = documents.where(F.col("text").rlike(f"[^{BREAKS}{SPACES}]")).withColumn("all", words(F.col("text")))
    if limits is None:
        rows = rows.select(key, "all", F.lit(size).alias("size"), F.lit(size - overlap).alias("step"))
    else:
        rows = rows.join(limits.groupBy("source").agg(F.min("max_tokens").alias("size"), (F.min("max_tokens") - F.min_by("overlap", "max_tokens")).alias("step")), "source").select(key, "all", "size", "step")
    last = F.greatest(F.lit(0), F.ceil((F.size("all") - F.col("size")) / F.col("step"))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("all", k * F.col("step") + 1, F.col("size")))
    texts = F.transform(parts, lambda w: F.struct(F.size(w).alias("words"), F.array_join(w, " ").alias("text")))
    return rows.select(key, F.posexplode(texts).alias("ord", "window")).select(key, "ord", "window.words", "window.text")
