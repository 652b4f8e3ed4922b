"""Evaluation texts that stand in training text: an Aho-Corasick automaton over word blocks of the items.

A run of RUN words of an item holds a whole block of BLOCK words that begins at a
multiple of RUN - BLOCK + 1 words, wherever the run begins.  So the automaton
needs only these blocks of each item, about one word of pattern per word of item,
and each block that a document holds is widened in both directions, word by word,
until the texts differ.  The automaton reads word numbers, not letters.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .evaluation import evaluation_files, file_name, sized, trimmed
from .forms import form_words, word_offsets

RUN, BLOCK = 10, 6
#: Words of items in one automaton (about 100 bytes each in a worker); more items make more automata, each of which reads the text.
MOST_WORDS = 2_000_000


def span_items(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """item, text of every span with start before end and a known file; a span beyond the text's end is cut there.

    Repeated rows count once; spans with a null among id, file, start or end are none.
    """
    places = spans.where("span_id is not null and char_start < char_end and char_end > 0").select(F.col("span_id").alias("item"), trimmed(F.col("file")).alias("file"), F.greatest("char_start", F.lit(0)).alias("s"), F.col("char_end").alias("e")).dropDuplicates(["item"])
    names = sized(places.select("file").distinct())
    held = documents.where("text is not null").select(file_name(F.col("path")).alias("file"), "text").join(names, "file", "left_semi")
    return places.join(held, "file").selectExpr("item", "substring(text, s + 1, e - s) AS text").dropDuplicates(["item"])


def _item_words(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [form_words(t) for t in b.column(1).to_pylist()]
            keep = [k for k, w in enumerate(words) if len(w) >= RUN]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([" ".join(words[k]) for k in keep], pa.string()), pa.array([len(words[k]) for k in keep], pa.int32())], names=["item", "words", "n"])

    return items.select("item", "text").mapInArrow(run, "item string, words string, n int")


class _Items:
    """The automaton of some items and what widening a hit needs."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.ids: dict[str, int] = {}
        self.names: list[str] = []
        self.words: list[list[int]] = []
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for name, text in rows:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in text.split(" ")]
            for at in range(0, len(own) - BLOCK + 1, RUN - BLOCK + 1):
                places.setdefault(tuple(own[at : at + BLOCK]), []).append((len(self.names), at))
            self.names.append(name)
            self.words.append(own)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block, at in places.items():
            self.auto.add_word(block, at)
        self.auto.make_automaton()

    def runs(self, words: list[str]) -> dict[int, set[tuple[int, int]]]:
        """Of each item found: first word and end of every longest shared run of RUN words or more."""
        get = self.ids.get
        text = tuple([get(w, 0) for w in words])
        found: dict[int, set[tuple[int, int]]] = {}
        for last, places in self.auto.iter(text):
            for item, at in places:
                own, a, b = self.words[item], last - BLOCK + 1, last + 1
                p, q = at, at + BLOCK
                while p and a and own[p - 1] == text[a - 1]:
                    p, a = p - 1, a - 1
                while q < len(own) and b < len(text) and own[q] == text[b]:
                    q, b = q + 1, b + 1
                if b - a >= RUN:
                    found.setdefault(item, set()).add((a, b))
        return found


_READY: dict[str, _Items] = {}


def leaks(training: DataFrame, items: DataFrame, places: bool = False, most_words: int = MOST_WORDS) -> DataFrame:
    """item and doc_id of every training document that holds RUN or more consecutive words of the item.

    With places also char_start and char_end of every longest shared run in the
    text as stored (null where words can't be told apart there).  Null texts hold
    nothing; items of fewer than RUN words can't be found; repeated rows count
    once; further columns are ignored.  Items are read in blocks of at most
    most_words words (an item isn't split), so that what is broadcast is bounded.
    """
    spark = training.sparkSession
    prepared = _item_words(items).dropDuplicates(["item"]).persist()
    total = prepared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // most_words))
    prepared = prepared.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    texts = training.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    for k in range(blocks):
        rows = [(r.item, r.words) for r in prepared.where(F.col("block") == k).select("item", "words").toLocalIterator()]
        sent = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(rows), 1))
        part = _scan(texts, sent, bool(rows), places)
        if blocks > 1:  # one block after the other: its hits are written and its automaton let go before the next is made
            part = checkpointed(part)
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    if blocks > 1:
        prepared.unpersist()
    return out.distinct()


def _scan(texts: DataFrame, sent: Broadcast, some: bool, places: bool) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (own := _READY.get(key)) is None:
            _READY.clear()
            own = _READY[key] = _Items(pickle.loads(zlib.decompress(sent.value)))
        for b in batches:
            names, ids, starts, ends = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(words := form_words(text)) < RUN or not (found := own.runs(words)):
                    continue
                offsets = word_offsets(text) if places else None
                for item, runs in found.items():
                    for x, y in sorted(runs) if places else [(0, 0)]:
                        names.append(own.names[item])
                        ids.append(doc)
                        starts.append(offsets[x][0] if offsets else None)
                        ends.append(offsets[y - 1][1] if offsets else None)
            columns = [pa.array(names, pa.string()), pa.array(ids, pa.int64()), *[pa.array(starts, pa.int32()), pa.array(ends, pa.int32())] * places]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", *["char_start", "char_end"] * places])

    if not some:
        return texts.sparkSession.createDataFrame([], "item string, doc_id bigint" + ", char_start int, char_end int" * places)
    return texts.mapInArrow(run, "item string, doc_id bigint" + ", char_start int, char_end int" * places)


def training_documents(documents: DataFrame, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents whose file name is in neither list; a null path is no evaluation file."""
    files = sized(evaluation_files(docs, spans).select("file"))
    return documents.withColumn("file", F.coalesce(file_name(F.col("path")), F.lit(""))).join(files, "file", "left_anti").drop("file")


def leaked_items(documents: DataFrame, queries: DataFrame, docs: DataFrame, spans: DataFrame, places: bool = False) -> DataFrame:
    asked = queries.where("id is not null").select(F.col("id").alias("item"), "text")
    items = asked.unionByName(span_items(documents, spans))
    return leaks(training_documents(documents.select("doc_id", "path", "text"), docs, spans), items, places)
