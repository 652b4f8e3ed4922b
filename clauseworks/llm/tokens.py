"""Ids of texts by a public tokenizer, through a table of the distinct words of the corpus.

Texts are split into the words of the tokenizer's pattern, in blocks of some
millions of characters.  A block keeps its distinct words and, for every place in
its texts, the number of the word there; only the distinct words of blocks are
shuffled, a few hundredths of the text.  Each distinct word of the corpus is
encoded once; its ids are joined back to the blocks and put where the word's
number stands.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern of the tokenizer, with its classes written out; the first for text in ASCII.
_SPACE = "\t-\r \x85\xa0  -     　"
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
_ASCII = re.compile(_CONTRACTED + "| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_FULL = regex.compile(rf"{_CONTRACTED}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Characters of a block of texts; a longer text is a block by itself.
BLOCK_CHARS = 16_000_000
#: Words in a worker's table of sizes, about 100 bytes each; a fuller one is begun anew.
MOST_WORDS = 400_000


def split_words(text: str) -> list[str]:
    return (_ASCII if text.isascii() else _FULL).findall(text)


def ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def word_encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """Ids of one word: an encoding whose pattern takes any text as a single piece."""
    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks(vocabulary), special_tokens={}).encode_ordinary


class WordTable(dict):
    """Word to its number of ids, found when the word is first met."""

    def __init__(self, vocabulary: str) -> None:
        self._encode = word_encoder(vocabulary)

    def __missing__(self, word: str) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        n = self[word] = len(self._encode(word))
        return n


_TABLES: dict[str, WordTable] = {}


def word_table(vocabulary: str) -> WordTable:
    if vocabulary not in _TABLES:
        _TABLES[vocabulary] = WordTable(vocabulary)
    return _TABLES[vocabulary]


class _Numbers(dict):
    """Words in the order in which they were met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _blocks(texts: DataFrame, chars: int) -> DataFrame:
    """block, ids (doc_id and number of words of each text), places (word numbers, packed) and words of blocks of texts."""

    def flush(docs: list[int | None], places: list[np.ndarray], words: _Numbers) -> pa.RecordBatch:
        flat = np.concatenate(places) if places else np.empty(0, np.uint32)
        block = uuid.uuid4().hex
        lists = [pa.array([x], t) for x, t in ((docs, pa.list_(pa.int64())), ([len(p) for p in places], pa.list_(pa.int32())))]
        return pa.RecordBatch.from_arrays([pa.array([block]), *lists, pa.array([zlib.compress(_planes(flat), 1)], pa.binary()), pa.array([list(words)], pa.list_(pa.string()))], names=["block", "docs", "counts", "places", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, places, words, held = [], [], _Numbers(), 0
        for b in batches:
            for doc, scalar in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = scalar.as_py() or ""
                found = split_words(text)
                docs.append(doc)
                places.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                held += len(text)
                if held > chars:
                    yield flush(docs, places, words)
                    docs, places, words, held = [], [], _Numbers(), 0
        if docs:
            yield flush(docs, places, words)

    return texts.mapInArrow(run, "block string, docs array<bigint>, counts array<int>, places binary, words array<string>")


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte, the lowest bytes first: the upper ones are mostly zero."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def encoded_words(words: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """word and ids of every distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(encode, b.column(0).to_pylist())), pa.list_(pa.int32()))], names=["word", "ids"])

    return words.select("word").distinct().mapInArrow(run, "word string, ids array<int>")


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and ids of every row, an empty list for empty and for null text; rows that occur again stay, further columns are dropped."""
    blocks = checkpointed(_blocks(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), chars))
    words = blocks.select("block", F.posexplode("words").alias("number", "word"))
    table = encoded_words(words, vocabulary)
    found = words.join(table, "word").groupBy("block").agg(F.collect_list(F.struct("number", "ids")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                rows = b.column(3).slice(k, 1).flatten()
                number, ids = rows.field(0).to_numpy(), rows.field(1)
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                size, first = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
                size[number] = ids.value_lengths().to_numpy(zero_copy_only=False)
                first[number] = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))[:-1]]) if len(number) else 0
                places = _numbers(zlib.decompress(b.column(2)[k].as_py()))
                counts = b.column(1)[k].values.to_numpy()
                sizes = size[places]
                ends = np.concatenate([[0], np.cumsum(sizes)])
                at = np.repeat(first[places] - ends[:-1], sizes) + np.arange(ends[-1])
                limits = ends[np.concatenate([[0], np.cumsum(counts)])]
                out = flat[at].astype(np.int32) if len(at) else np.empty(0, np.int32)
                docs = b.column(0)[k].values
                step = max(1, len(docs) * 1_000_000 // max(1, len(out)))  # some MB at a time
                for s in range(0, len(docs), step):
                    own = limits[s : s + step + 1]
                    lists = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(out[own[0] : own[-1]]))
                    yield pa.RecordBatch.from_arrays([docs.slice(s, step), lists], names=["doc_id", "ids"])

    return blocks.join(found, "block", "left").select("docs", "counts", "places", "found").mapInArrow(run, "doc_id bigint, ids array<int>")


def pieces(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """id and piece (binary) of the whole vocabulary, whose size is fixed."""
    return spark.createDataFrame([(n, bytearray(p)) for p, n in ranks(vocabulary).items()], "id int, piece binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of every doc_id, from its ids by a join with the pieces; no ids give the empty text.

    Rows are spread by doc_id before they are exploded, so that only ids move
    and the pieces of a text meet where they are.  doc_id must be unique.
    """
    placed = encoded.repartition("doc_id").selectExpr("doc_id", "posexplode_outer(ids) AS (at, id)")
    joined = placed.join(F.broadcast(pieces(encoded.sparkSession, vocabulary)), "id", "left")
    texts = joined.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "piece")))).alias("parts"))
    return texts.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["piece"])), "")), "UTF-8").alias("text"))


def size(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Number of ids of a text."""
    return sum(map(word_table(vocabulary).__getitem__, split_words(text))) if text else 0
