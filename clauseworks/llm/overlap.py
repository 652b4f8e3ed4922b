"""Records of the evaluation that occur again in training: a full-text index of the evaluation, read by backward search.

The chunks of the evaluation documents, as words, make up shards; each shard has
an index of the kind of an FM-index: the rows of its Burrows-Wheeler transform,
grouped by word, and its suffix array.  One backward step for word w maps a row i
to the number of entries below (w, i) in that grouping, so a step for many
positions at once is one binary search over the shard's rows.

Only shards that can hold something similar to a training chunk are asked for it,
so the work follows the text and not training text times shards.  Rare positional
bytes of both sides, as for near-duplicates, meet in buckets; a filter that counts
the trigrams of all evaluation text keeps most of the training side's at home.
What is chosen is a superset, the index decides.

Of each training chunk that is sent to a shard, all trigrams are looked up there;
if a chunk is similar to an evaluation chunk at Jaccard t, at most n - t * n
of its n trigrams are missing there, so those that occur least often in the
shard contain enough shared ones, and only these are located.  Pairs that reach
the minimum are compared on their whole sets.  Of the pairs found, the maximal
matches, runs of words that both texts hold and that can't be made longer on
either side, are obtained on the diagonals of their shared trigrams, merged where
they overlap in the training text, and counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .evaluation import evaluation_files, file_name, sized
from .forms import form_words
from .neardup import _AT_ONCE, _TALLY_TYPE, BATCH, HASHES, THRESHOLD, WORDS, _entries, _joined, _tallied, _unpack, least_shared, near_rows, set_hash, shingle_hashes, shingle_sets, tallied, word_hashes

#: Characters of evaluation text in a shard, and those beyond which the filter of trigrams grows no more (it has one or two counters a character).
SHARD_CHARS, ROUND_CHARS = 8_000_000, 48_000_000
#: Counters of the filter added up at a time, and training texts that an index is sent in one task.
FILTER_PART, PART = 1 << 20, 50_000


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling of the compared length."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    order = np.argsort(rank, kind="stable")
    while n:
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = rank[step:] + 1
        pair = rank * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


class Shard:
    """Index of texts with distinct sets, the class of each in rows of equal number."""

    def __init__(self, classes: list[int], texts: list[str]) -> None:
        self.classes = np.array(classes, np.int64)
        lists = [form_words(t) for t in texts]
        self.words: dict[str, int] = {}
        # numbers from 2 on; 1 ends a chunk, 0 the text, unknown words are 0, too
        text = np.array([k for w in lists for k in [*(self.words.setdefault(x, len(self.words) + 2) for x in w), 1]] + [0], np.int32)
        self.starts = np.cumsum([0, *(len(w) + 1 for w in lists)])
        self.text, self.size = text, len(text)
        order = suffix_array(text)
        self.suffixes = order.astype(np.int32)
        last = text[order - 1]
        self.rows = np.argsort(last, kind="stable").astype(np.int32)
        self.counts = np.bincount(last, minlength=len(self.words) + 2)

    def ready(self) -> Shard:
        """With the keys of backward search and the sets of the texts."""
        self.keys = np.repeat(np.arange(len(self.counts), dtype=np.int64), self.counts) * (self.size + 1) + self.rows
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        hashes = np.zeros(len(self.counts), np.uint64)
        hashes[2:] = [HASHES[w] for w in self.words]
        hashes = hashes[self.text]
        self.sets = [np.unique(shingle_hashes(hashes[a : b - 1])) for a, b in zip(self.starts, self.starts[1:], strict=False)]
        return self

    def ranges(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with words[k : k + n], from and to, for every k; equal where there is none."""
        count = len(words) - n + 1
        last = words[n - 1 :]
        low, high = self.first[last], self.first[last + 1]
        alive = np.flatnonzero(last > 1)
        for i in range(n - 2, -1, -1):
            word = words[i : i + count][alive]
            key = word * (self.size + 1)
            from_, to = np.searchsorted(self.keys, key + low[alive]), np.searchsorted(self.keys, key + high[alive])
            some = (from_ < to) & (word > 1)
            alive = alive[some]
            low[alive], high[alive] = from_[some], to[some]
        found = np.zeros(count, bool)
        found[alive] = True
        high[~found] = low[~found]
        return low, high


def maximal_matches(a: np.ndarray, b: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, start in b and words of every run of n or more equal words that can't be made longer."""
    none = (np.empty(0, np.int64),) * 3
    if len(a) < n or len(b) < n:
        return none
    x, y = (np.stack([w[i : len(w) - n + 1 + i] for i in range(n)], axis=1) for w in (a, b))
    both = np.unique(np.concatenate([x, y]), axis=0, return_inverse=True)[1].ravel()
    x, y = both[: len(x)], both[len(x) :]
    order = np.argsort(y, kind="stable")
    low, high = np.searchsorted(y[order], x), np.searchsorted(y[order], x, side="right")
    count = high - low
    if not count.any():
        return none
    i = np.repeat(np.arange(len(x)), count)
    j = order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
    line = np.lexsort((i, j - i))
    i, j = i[line], j[line]
    new = np.concatenate([[True], (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)])
    first = np.flatnonzero(new)
    return i[first], j[first], np.diff(np.append(first, len(i))) + n - 1


def _merged(starts: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Number and words of the spans that overlapping and touching spans make up."""
    if not len(starts):
        return 0, 0
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate((starts + words)[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return int(new.sum()), int((ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)] - starts[new]).sum())


def matches(shard: Shard, texts: list[str], threshold: float = THRESHOLD, n: int = WORDS) -> Iterator[tuple[int, int, float, int, int, int]]:
    """Text, row of the shard, similarity, maximal matches merged in the text, words in them and in the longest, of all pairs that reach the threshold."""
    get = shard.words.get
    lists = [form_words(t) for t in texts]
    lengths = np.array([len(w) for w in lists], np.int64)
    if short := {k: set_hash(np.empty(0, np.uint64), texts[k]) for k in np.flatnonzero(lengths < n)}:
        row = {int(c): k for k, c in enumerate(shard.classes)}
        yield from ((int(k), row[c], 1.0, 0, 0, 0) for k, c in short.items() if c in row)
    flat = [x for w in lists for x in w]
    if len(flat) < n:
        return
    words = np.array([get(x, 0) for x in flat], np.int64)
    hashes = shingle_hashes(np.fromiter(map(HASHES.__getitem__, flat), np.uint64, len(flat)), n)
    low, high = shard.ranges(words, n)
    often = high - low
    starts = np.cumsum([0, *lengths])
    some = np.concatenate([[0], np.cumsum(often > 0)])
    for k in np.flatnonzero(lengths >= n):
        a, b = int(starts[k]), int(starts[k + 1]) - n + 1
        if some[b] == some[a]:
            continue
        own = np.unique(hashes[a:b])
        size = len(own)
        least = math.ceil(threshold * size - 1e-9)
        present = a + np.flatnonzero(often[a:b])
        rows, at = np.unique(low[present], return_index=True)
        if len(rows) < least:
            continue
        asked = least_shared(size, threshold)
        counts = often[present[at]]
        chosen = np.argsort(counts, kind="stable")[: len(rows) - least + asked]
        counts = counts[chosen]
        offsets = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        chunk = np.searchsorted(shard.starts, shard.suffixes[np.repeat(rows[chosen], counts) + offsets], side="right") - 1
        both = np.unique(chunk * np.int64(len(chosen)) + np.repeat(np.arange(len(chosen)), counts))
        found, tally = np.unique(both // len(chosen), return_counts=True)
        for c in found[tally >= asked]:
            other = shard.sets[c]
            if min(size, len(other)) < threshold * max(size, len(other)) - 1e-9:
                continue
            shared = len(np.intersect1d(own, other, assume_unique=True))
            if (near := shared / (size + len(other) - shared)) >= threshold - 1e-12:
                start, _, length = maximal_matches(words[a : b + n - 1], shard.text[shard.starts[c] : shard.starts[c + 1] - 1], n)
                yield int(k), int(c), near, *_merged(start, length), int(length.max(initial=0))


def _with_class(chunks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(word_hashes(t))) for t in b.column(1).to_pylist()]
            classes = [set_hash(x, t) for x, t in zip(sets, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(classes, pa.int64()), b.column(1), pa.array(list(map(len, sets)), pa.int32())], names=["doc_id", "class", "text", "size"])

    return chunks.select("doc_id", "text").mapInArrow(run, "doc_id bigint, class bigint, text string, size int")


def _filter(texts: DataFrame, counters: int) -> np.ndarray:
    """How many of the texts, up to 255, hold a trigram of each counter."""
    width = min(counters, FILTER_PART)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), BATCH):
                places = np.sort((shingle_sets(b.column(0).slice(k, BATCH).to_pylist())[0] % np.uint64(counters)).astype(np.int64))
                parts, at = np.unique(places // width, return_index=True)
                rows = [(p % width).astype("<u4").tobytes() for p in np.split(places, at[1:])] if len(parts) else []
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(rows, pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(width, np.uint32)
        for b in batches:
            for part, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if part != at and at is not None:
                    yield summed(at, total)
                    total[:] = 0
                at = part
                np.add.at(total, np.frombuffer(places, "<u4"), np.uint32(1))
        if at is not None:
            yield summed(at, total)

    def summed(part: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.minimum(total, 255).astype(np.uint8).tobytes()], pa.binary())], names=["part", "counts"])

    kind = "part bigint, counts binary"
    out = np.zeros(counters, np.uint8)
    for r in texts.select("text").mapInArrow(held, kind).repartition("part").sortWithinPartitions("part").mapInArrow(add, kind).collect():
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(r.counts, np.uint8)
    return out


def _between(entries: DataFrame, threshold: float) -> DataFrame:
    """key (training text) and class (evaluation text) that share the guaranteed minimum, by size, place and signature able to reach the threshold.

    Of a bucket only the evaluation's entries are held; those of training pass by.
    """

    def paired(held: tuple[np.ndarray, ...], new: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        first = len(held[0])
        both = _joined([held, new])
        low, high = np.searchsorted(held[0], new[0]), np.searchsorted(held[0], new[0], side="right")
        some = np.flatnonzero(high > low)
        low, count = low[some], (high - low)[some]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        for start in range(0, total, _AT_ONCE):
            k = np.arange(start, min(start + _AT_ONCE, total))
            of = np.searchsorted(ends, k, side="right")
            x, y, asked = near_rows(threshold, both, low[of] + k - (ends - count)[of], first + some[of])
            yield _tallied([np.stack([both[3][y], both[3][x], asked], axis=1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for b in batches:
            for bucket, training, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if bucket != at:
                    at, parts, held = bucket, [], None
                if not training:
                    parts.append(_unpack(blob.as_py()))
                elif parts or held:
                    if held is None:
                        keys, places, rows, *texts = _joined(parts)
                        order = np.argsort(keys, kind="stable")
                        held, parts = (keys[order], places[order], rows[order], *texts), []
                    yield from paired(held, _unpack(blob.as_py()))

    pairs = entries.repartition("bucket").sortWithinPartitions("bucket", "training").mapInArrow(run, _TALLY_TYPE)
    return tallied(pairs).select(F.col("class_a").alias("key"), F.col("class_b").alias("class"))


def _located(rows: DataFrame, threshold: float, batch: int = 2000) -> DataFrame:
    """What the index of each shard and part finds of the training texts that follow the evaluation's."""
    names = ["doc_id", "class", "similarity", "matches", "words", "longest"]
    types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, texts, index, waiting = None, [], None, []

        def found() -> pa.RecordBatch:
            rows = [(waiting[k][0], int(index.classes[c]), *more) for k, c, *more in matches(index, [t for _, t in waiting], threshold)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for b in batches:
            for shard, part, training, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (shard, part) != at:
                    if waiting:
                        yield found()
                    at, texts, index = (shard, part), [], None
                if not training:
                    texts.append((key, text))
                    continue
                if index is None:
                    texts.sort()
                    index, texts = Shard([c for c, _ in texts], [t for _, t in texts]).ready(), []
                waiting.append((key, text))
                if len(waiting) == batch:
                    yield found()
        if waiting:
            yield found()

    rows = rows.select("shard", "part", "training", "key", "text").repartition("shard", "part").sortWithinPartitions("shard", "part", "training")
    return rows.mapInArrow(run, "doc_id bigint, class bigint, similarity double, matches int, words int, longest int")


MOST = ("similarity", "matches", "words", "longest")


def evaluation_ids(documents: DataFrame, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id and split of every evaluation document."""
    files = evaluation_files(docs, spans)
    named = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), file_name(F.col("path")).alias("file"))
    return named.join(files, "file").groupBy("doc_id").agg(F.max("split").alias("split"))


def class_overlaps(chunks: DataFrame, documents: DataFrame, docs: DataFrame, spans: DataFrame, threshold: float = THRESHOLD, shard_chars: int = SHARD_CHARS, round_chars: int = ROUND_CHARS) -> tuple[DataFrame, DataFrame]:
    """Two tables: training (document), class and the most of each measure; doc_id, class, text, size of the evaluation chunks.

    Null ids and texts have none, repeated rows count once, a chunk of an unknown
    document belongs to neither side.  The training side is read twice, however
    much evaluation text there is; what is broadcast is the filter, at most two
    counters for each of round_chars characters.
    """
    ids = checkpointed(evaluation_ids(documents, docs, spans).select("doc_id"))
    chunks = chunks.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    held = _with_class(chunks.join(sized(ids), "doc_id", "left_semi")).persist(StorageLevel.DISK_ONLY)
    # a text's own number, for which no word of it is read
    training = chunks.join(sized(ids), "doc_id", "left_anti").withColumn("key", F.xxhash64("text"))
    evaluation = checkpointed(held.groupBy("class").agg(F.min("text").alias("text"), F.min("size").alias("size")))
    total = evaluation.agg(F.sum(F.length("text"))).first()[0]
    if total is None:
        return chunks.sparkSession.createDataFrame([], "training bigint, class bigint, similarity double, matches int, words int, longest int"), held
    counts = _filter(evaluation, 1 << max(10, min(total, round_chars).bit_length()))
    number, buckets = max(1, -(-total // shard_chars)), max(1, 4 * total // shard_chars)
    sides = [(evaluation.select(F.col("class").alias("id"), "text"), False), (training.select(F.col("key").alias("id"), "text"), True)]
    entries = [_entries(t, counts, threshold, WORDS, buckets, own=True).withColumn("training", F.lit(x)).select("bucket", "training", "entries") for t, x in sides]
    near = _between(entries[0].unionByName(entries[1]), threshold)
    # texts without a trigram are equal as stored or not at all
    equal = evaluation.where("size = 0").select(F.xxhash64("text").alias("key"), "class")
    shard = F.pmod("class", F.lit(number)).cast("bigint").alias("shard")
    routes = checkpointed(near.unionByName(equal).select("key", shard).distinct())
    # the texts of a shard that very much is sent to are indexed in several tasks
    most = routes.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    parts = -(-most // PART) or 1
    indexed = evaluation.select(shard, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("training"), F.col("class").alias("key"), "text")
    sent = training.join(sized(routes), "key").select("shard", F.pmod(F.hash("doc_id"), F.lit(parts)).alias("part"), F.lit(True).alias("training"), F.col("doc_id").alias("key"), "text")
    out = _located(indexed.unionByName(sent), threshold)
    most = [F.max(c).alias(c) for c in MOST]
    known = documents.select(F.col("doc_id").alias("training")).distinct()
    return out.join(known, out.doc_id == known.training, "left_semi").groupBy(F.col("doc_id").alias("training"), "class").agg(*most), held


def chunk_overlaps(chunks: DataFrame, documents: DataFrame, docs: DataFrame, spans: DataFrame, threshold: float = THRESHOLD, shard_chars: int = SHARD_CHARS, round_chars: int = ROUND_CHARS) -> DataFrame:
    """evaluation, training (document ids), similarity, matches, words, longest: the most of each, of all document pairs with similar chunks."""
    classes, held = class_overlaps(chunks, documents, docs, spans, threshold, shard_chars, round_chars)
    owners = held.select(F.col("doc_id").alias("evaluation"), "class").distinct()
    return classes.join(owners, "class").groupBy("evaluation", "training").agg(*(F.max(c).alias(c) for c in MOST)).select("evaluation", "training", *MOST)


def overlap_classes(chunks: DataFrame, documents: DataFrame, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """class (of evaluation chunks with equal words), evaluation and training: numbers of documents that hold it and one similar to it.

    A clause that a third of all documents share is one row here, where
    chunk_overlaps has a row for each pair of its documents.
    """
    classes, held = class_overlaps(chunks, documents, docs, spans)
    owners = held.groupBy("class").agg(F.countDistinct("doc_id").alias("evaluation"))
    return classes.groupBy("class").agg(F.count("*").alias("training"), F.max("longest").alias("longest")).join(owners, "class").select("class", "evaluation", "training", "longest")


def hash_overlaps(documents: DataFrame, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """evaluation, training: documents of equal hash; a null hash equals none."""
    files = sized(evaluation_files(docs, spans).select("file", F.lit(True).alias("listed")))
    rows = documents.where("doc_id is not null and hash is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "hash", F.coalesce(file_name(F.col("path")), F.lit("")).alias("file"))
    rows = rows.join(files, "file", "left").select("doc_id", "hash", F.coalesce("listed", F.lit(False)).alias("listed"))
    held = rows.where("listed").select(F.col("doc_id").alias("evaluation"), "hash")
    return held.join(rows.where("not listed").select(F.col("doc_id").alias("training"), "hash"), "hash").select("evaluation", "training").distinct()


def overlaps(documents: DataFrame, chunks: DataFrame, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """evaluation, training, by_hash, similarity (null without similar chunks) of every overlapping pair of documents."""
    near = chunk_overlaps(chunks, documents, docs, spans).select("evaluation", "training", F.lit(False).alias("by_hash"), "similarity")
    same = hash_overlaps(documents, docs, spans).withColumn("by_hash", F.lit(True)).withColumn("similarity", F.lit(None).cast("double"))
    return near.unionByName(same).groupBy("evaluation", "training").agg(F.max("by_hash").alias("by_hash"), F.max("similarity").alias("similarity"))


def overlap_counts(documents: DataFrame, chunks: DataFrame, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """split (of the evaluation document, '' where only spans names it), source (of the training document), pairs, by_hash, near."""
    found = overlaps(documents, chunks, docs, spans)
    splits = evaluation_ids(documents, docs, spans).withColumnRenamed("doc_id", "evaluation")
    sources = documents.groupBy(F.col("doc_id").alias("training")).agg(F.max("source").alias("source"))
    return found.join(splits, "evaluation").join(sources, "training").groupBy("split", "source").agg(F.count("*").alias("pairs"), F.count_if("by_hash").alias("by_hash"), F.count("similarity").alias("near"))
