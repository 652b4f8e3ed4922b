"""Near-duplicate texts: a byte-position inverted index with count filtering, then verification.

A text is the set of its word trigrams.  The hash of a trigram, 40 bits, names a
position (its upper 32 bits) and the byte that stands there (its lowest eight); a
text is a sparse string of bytes at positions, and two texts share as many
positional bytes as they share trigrams, or, once in some 10^9 comparisons, one more by collision.
The key of the index is a position with its byte.

With texts of a and b trigrams at Jaccard similarity t, at least t * max(a, b)
are shared.  So if all texts order their positions alike, the first
n - ceil(t * n) + m of each contain at least m shared ones.  The index holds only
these, rare positions first; pairs are tallied over them, those that reach the
guaranteed minimum m are verified on their whole sets.  The order comes from a
sketch of fixed size that counts the positions of all texts.  A signature of 32
bytes travels with a text's entries: every trigram flips one bit, so two texts
differ in at least as many trigrams as their signatures in bits, and pairs that
differ in too many never leave the task that met them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .evaluation import sized
from .forms import form_words

THRESHOLD, WORDS = 0.6, 3
#: Counters of the sketch and the slices in which it is added up.
COUNTERS, SLICES = 1 << 21, 8
#: Bits of a text's signature.
SIGNATURE = 256
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: Bits of a trigram's hash: a position of 32 and the byte there.
BITS = 40
#: Texts taken at a time, and entries of a bucket of the index.
BATCH, BUCKET = 4096, 1_200_000
#: Entries of one key that are paired in the task of their bucket, and entries that task holds before it passes such keys on.
HOT, MOST_HELD = 4000, 3 * BUCKET
#: Tasks whose sketches are added up in one.
FAN_IN = 64


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = _WordHashes()


def word_hashes(text: str) -> np.ndarray:
    words = form_words(text)
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hashes of all runs of n words, in order, as positional bytes; none for fewer words."""
    k = len(words) - n + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(k, np.uint64)
    for i in range(n):
        h = (h ^ words[i : i + k]) * _MULTIPLIERS[i % 8]
        h ^= h >> np.uint64(29)
    return h >> np.uint64(64 - BITS)


def shingle_sets(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of at most BATCH texts one after the other, ascending, and the ends of each text's part (from 0)."""
    lists = [form_words(t) for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(map(HASHES.__getitem__, chain.from_iterable(lists)), np.uint64, int(lengths.sum()))
    if len(flat) < n:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    text = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    keys = shingle_hashes(flat, n) | text[: len(flat) - n + 1] << np.uint64(BITS)
    keys = np.sort(keys[text[: len(flat) - n + 1] == text[n - 1 :]])
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    ends = np.searchsorted(keys >> np.uint64(BITS), np.arange(len(texts) + 1, dtype=np.uint64))
    return keys & np.uint64((1 << BITS) - 1), ends


def set_hash(hashes: np.ndarray, text: str) -> int:
    """Number of a set; texts without a trigram are told apart by their stored form."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes() if len(hashes) else b"\0" + text.encode("utf-8", "surrogatepass")) - (1 << 63)


def least_shared(n: int, threshold: float) -> int:
    """The guaranteed minimum of shared positional bytes that is asked of a text of n: what the threshold asks for, at most 1 to 3."""
    return min(1 if n < 12 else 2 if n < 60 else 3, max(1, math.ceil(threshold * n - 1e-9)))


def prefix(n: int, threshold: float) -> int:
    return min(n, n - math.ceil(threshold * n - 1e-9) + least_shared(n, threshold)) if n else 0


def _keyed(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """Rows of two kinds: id, class and size of each text; slices of the task's sketch (class: slice, counts in counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(COUNTERS, np.uint32)
        names = ["id", "class", "size", "counts"]
        for b in _cut(batches):
            texts = b.column(1).to_pylist()
            hashes, ends = shingle_sets(texts, n)
            np.add.at(sketch, (hashes % np.uint64(COUNTERS)).astype(np.int64), np.uint32(1))
            classes = [set_hash(hashes[x:y], t) for x, y, t in zip(ends[:-1], ends[1:], texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(classes, pa.int64()), pa.array(np.diff(ends).astype(np.int32)), pa.nulls(len(b), pa.binary())], names=names)
        # the order only has to be the same for all texts, so counts of a task may end at 255
        parts = np.minimum(sketch, 255).astype(np.uint8).reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int64()), pa.nulls(SLICES, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    return texts.mapInArrow(run, "id bigint, class bigint, size int, counts binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(k, BATCH) for b in batches for k in range(0, len(b), BATCH))


def _sketch(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches: COUNTERS numbers, whatever the data."""

    def add(batches: Iterator[pa.RecordBatch], out: str, of: str = "u1") -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(counts, of).astype(np.uint64)
                total[k] = total[k] + own if k in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([np.minimum(x, np.iinfo(out).max).astype(out).tobytes() for x in total.values()], pa.binary())], names=["class", "counts"])

    # in a tree: no task adds up more than FAN_IN sketches at first
    groups = -(-rows.rdd.getNumPartitions() // FAN_IN)
    parts = rows.where("counts is not null").select("class", "counts", F.pmod(F.spark_partition_id(), F.lit(groups)).alias("part"))
    if groups > 1:
        parts = parts.repartition(SLICES * groups, "class", "part").mapInArrow(lambda x: add(x, "<u4"), "class bigint, counts binary")
        slices = parts.repartition(SLICES, "class").mapInArrow(lambda x: add(x, "<u2", "<u4"), "class bigint, counts binary").collect()
    else:
        slices = parts.repartition(SLICES, "class").mapInArrow(lambda x: add(x, "<u2"), "class bigint, counts binary").collect()
    out = np.zeros((SLICES, COUNTERS // SLICES), np.uint16)
    for r in slices:
        out[r["class"]] = np.frombuffer(r.counts, "<u2")
    return out.ravel()


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte: first all lowest bytes and so on, of which the upper ones then take next to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def signatures(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of SIGNATURE bits, as four numbers, of each text's part."""
    texts = len(ends) - 1
    bits = np.repeat(np.arange(texts, dtype=np.int64), np.diff(ends)) * SIGNATURE + (hashes >> np.uint64(8)).astype(np.int64) % SIGNATURE
    return np.packbits((np.bincount(bits, minlength=texts * SIGNATURE) & 1).astype(np.uint8).reshape(texts, SIGNATURE), axis=1).view(np.uint64)


def _pack(keys: np.ndarray, places: np.ndarray, rows: np.ndarray, classes: np.ndarray, sizes: np.ndarray, signs: np.ndarray) -> bytes:
    """Entries (key, place, row of the text) and their texts (class, size, signature)."""
    used, rows = np.unique(rows, return_inverse=True)
    head = np.array([len(keys), len(used)], "<u4").tobytes()
    return b"".join([head, (keys >> np.uint64(8)).astype("<u4").tobytes(), (keys & np.uint64(255)).astype(np.uint8).tobytes(), _planes(places), _planes(rows), classes[used].tobytes(), _planes(sizes[used]), signs[used].tobytes()])


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n, m = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    plain = lambda at, k: np.frombuffer(blob, np.uint8, 4 * k, at).reshape(4, k).T.copy().view("<u4").ravel().astype(np.int64)
    keys = np.frombuffer(blob, "<u4", n, 8).astype(np.uint64) << np.uint64(8) | np.frombuffer(blob, np.uint8, n, 8 + 4 * n).astype(np.uint64)
    at = 8 + 13 * n
    return keys, plain(8 + 5 * n, n), plain(8 + 9 * n, n), np.frombuffer(blob, np.int64, m, at), plain(at + 8 * m, m), np.frombuffer(blob, np.uint64, 4 * m, at + 12 * m).reshape(m, 4)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    first = np.cumsum([0, *(len(p[3]) for p in parts)])
    keys, places, rows, classes, sizes, signs = zip(*parts, strict=True)
    return tuple(map(np.concatenate, (keys, places, [r + f for r, f in zip(rows, first[:-1], strict=True)], classes, sizes, signs)))


def _entries(texts: DataFrame, sketch: np.ndarray, threshold: float, n: int, buckets: int, own: bool = False) -> DataFrame:
    """bucket and entries of the index, packed: key (position and byte), place in the text's order, and the text.

    A task writes a class once, however many copies it reads.  With own, the id is
    the class and the sketch is that of the other side: what it doesn't hold comes
    first in the order and has no entry, nor has a text too much of which isn't there.
    """
    counts = texts.sparkSession.sparkContext.broadcast(sketch)

    def flush(parts: list[tuple[np.ndarray, ...]], held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        keys, places, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
        texts = [np.concatenate(x) for x in zip(*held, strict=True)]
        bucket = (keys * _MULTIPLIERS[1] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, at = np.unique(bucket[order], return_index=True)
        pieces = [np.split(c[order], at[1:]) if len(at) else [] for c in (keys, places, rows)]
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array([_pack(*x, *texts) for x in zip(*pieces, strict=True)], pa.binary())], names=["bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        parts: list[tuple[np.ndarray, ...]] = []
        held: list[tuple[np.ndarray, ...]] = []
        first = 0
        for b in _cut(batches):
            if own:  # copies are told by their ids, before their words are read
                ids = b.column(0).to_pylist()
                fresh = [k for k, c in enumerate(ids) if c not in known and not known.add(c)]
                b = b.take(pa.array(fresh, pa.int64()))
                if not fresh:
                    continue
            texts = b.column(1).to_pylist()
            hashes, ends = shingle_sets(texts, n)
            sizes = np.diff(ends)
            if own:
                classes = np.array(b.column(0).to_pylist(), np.int64)
            else:
                classes = np.array([set_hash(hashes[x:y], t) for x, y, t in zip(ends[:-1], ends[1:], texts, strict=True)], np.int64)
            take = np.array([prefix(int(k), threshold) for k in sizes], np.int64)
            for k, c in enumerate(() if own else classes.tolist()):
                if c in known:
                    take[k] = 0
                known.add(c)
            text = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
            often = counts.value[(hashes % np.uint64(len(counts.value))).astype(np.int64)].astype(np.uint64)
            # rare first within a text, ties in a mixed order that is alike for all texts
            order = np.argsort(text << np.uint64(52) | often << np.uint64(32) | hashes * _MULTIPLIERS[0] >> np.uint64(32))
            places = np.arange(len(hashes)) - np.repeat(ends[:-1], sizes)
            if own:
                there = np.concatenate([[0], np.cumsum(often > 0)])[ends]
                take[np.diff(there) < np.ceil(threshold * sizes - 1e-9)] = 0
            keep = places < np.repeat(take, sizes)
            if own:
                keep &= often[order] > 0
            parts.append((hashes[order][keep], places[keep], text[keep].astype(np.int64) + first))
            held.append((classes, sizes, signatures(hashes, ends)))
            first += len(texts)
            if first > 8 * BATCH:
                yield flush(parts, held)
                parts, held, first = [], [], 0
        if held:
            yield flush(parts, held)

    return texts.select("id", "text").mapInArrow(run, "bucket bigint, entries binary")


def near_rows(threshold: float, entries: tuple[np.ndarray, ...], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts (rows) of entries of one key each, left and right, that by place, size and signature can reach the threshold, and the minimum asked of them."""
    _, places, rows, _, sizes, signs = entries
    a, b = sizes[rows[left]], sizes[rows[right]]
    needed = np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9).astype(np.int64)
    within = np.minimum(places[left], places[right]) + np.minimum(a - places[left], b - places[right])
    small = np.minimum(a, b)
    asked = np.minimum(1 + (small >= 12) + (small >= 60), needed)
    # of two similar texts, the first m shared bytes stand among the first a - needed + m and b - needed + m
    early = (places[left] < a - needed + asked) & (places[right] < b - needed + asked)
    keep = np.flatnonzero(early & (within >= needed) & (small >= needed))
    x, y = rows[left[keep]], rows[right[keep]]
    differ = np.bitwise_count(signs[x] ^ signs[y]).sum(axis=1, dtype=np.int64)
    near = differ <= (a + b - 2 * needed)[keep]
    return x[near], y[near], asked[keep][near]


def _pairs(threshold: float, entries: tuple[np.ndarray, ...], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Those of different classes as rows (class, class, asked)."""
    x, y, asked = near_rows(threshold, entries, left, right)
    x, y = entries[3][x], entries[3][y]
    rows = np.stack([np.minimum(x, y), np.maximum(x, y), asked], axis=1)
    return rows[x != y]


def _tallied(pairs: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.concatenate(pairs) if pairs else np.empty((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])) if len(rows) else np.empty(0, np.int64)
    shared = np.diff(np.concatenate([new, [len(rows)]])) if len(rows) else new
    rows = rows[new]
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(shared.astype(np.int32)), pa.array(rows[:, 2].astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=_TALLY)


def _block(key: int, number: int, entries: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    none = pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32())
    return pa.RecordBatch.from_arrays([*none, pa.array([key], pa.int64()), pa.array([number], pa.int32()), pa.array([_pack(*entries)], pa.binary())], names=_TALLY)


_TALLY = ["class_a", "class_b", "shared", "asked", "key", "block", "entries"]
_TALLY_TYPE = "class_a bigint, class_b bigint, shared int, asked int, key bigint, block int, entries binary"
#: Pairs of entries taken at a time.
_AT_ONCE = 2_000_000


class _Bucket:
    """Entries of a bucket as they arrive.

    A key of more than HOT entries is passed on in blocks of HOT, each written
    once, to be paired by other tasks.  That happens as soon as MOST_HELD entries
    are held, so one key may have any number.
    """

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.held: list[tuple[np.ndarray, ...]] = []
        self.number = 0
        self.waiting: dict[int, tuple[list[tuple[np.ndarray, ...]], int]] = {}
        self.blocks: dict[int, int] = {}

    def add(self, blob: bytes) -> Iterator[pa.RecordBatch]:
        entries = _unpack(blob)
        self.held.append(entries)
        self.number += len(entries[0])
        if self.number > MOST_HELD:
            yield from self._pass_on()

    def _sorted(self) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
        keys, places, rows, *texts = _joined(self.held)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        return (keys, places[order], rows[order], *texts), starts, np.append(starts[1:], len(keys))[: len(starts)]

    def _pass_on(self) -> Iterator[pa.RecordBatch]:
        (keys, places, rows, *texts), starts, ends = self._sorted()
        hot = (ends - starts > HOT) | np.isin(keys[starts].astype(np.int64), np.array(list(self.waiting), np.int64))
        for s, e in zip(starts[hot], ends[hot], strict=True):
            key = int(keys[s])
            lists, n = self.waiting.get(key, ([], 0))
            lists.append(tuple(c[s:e] for c in (keys, places, rows)) + tuple(texts))
            lists[-1] = _alone(lists[-1])
            self.waiting[key] = lists, n + int(e - s)
            yield from self._emit(key, False)
        stay = np.repeat(~hot, ends - starts)
        self.held = [_alone((keys[stay], places[stay], rows[stay], *texts))]
        self.number = int(stay.sum())

    def _emit(self, key: int, last: bool) -> Iterator[pa.RecordBatch]:
        lists, n = self.waiting[key]
        if n < HOT and not last:
            return
        keys, places, rows, *texts = _joined(lists)
        whole = n if last else n - n % HOT
        for s in range(0, whole, HOT):
            e = min(s + HOT, whole)
            yield _block(key, self.blocks.get(key, 0), (keys[s:e], places[s:e], rows[s:e], *texts))
            self.blocks[key] = self.blocks.get(key, 0) + 1
        rest = (keys[whole:], places[whole:], rows[whole:], *texts)
        self.waiting[key] = ([_alone(rest)] if whole < n else []), n - whole

    def finish(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        if self.waiting or any(len(e[0]) for e in self.held):
            _, starts, ends = self._sorted()
            if self.waiting or (ends - starts > HOT).any():
                yield from self._pass_on()
        for key, (_, n) in self.waiting.items():
            if n:
                yield from self._emit(key, True)
        entries, starts, ends = self._sorted()
        yield from _all_pairs(entries, starts, ends, self.threshold)


def _alone(entries: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Entries with only the texts they name."""
    keys, places, rows, *texts = entries
    used, rows = np.unique(rows, return_inverse=True)
    return (keys, places, rows, *(t[used] for t in texts))


def _all_pairs(entries: tuple[np.ndarray, ...], starts: np.ndarray, ends: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Tally of all pairs of entries of one key."""
    tally: list[np.ndarray] = []
    held = 0
    # the k-th follower of every entry of the same key, for every k
    last = np.repeat(ends, ends - starts)
    at = np.flatnonzero(np.repeat(ends - starts > 1, ends - starts))
    step = 1
    while len(at := at[at + step < last[at]]):
        tally.append(_pairs(threshold, entries, at, at + step))
        held += len(tally[-1])
        if held > _AT_ONCE:
            yield _tallied(tally)
            tally, held = [], 0
        step += 1
    yield _tallied(tally)


def _paired_blocks(table: pa.Table, threshold: float) -> pa.Table:
    """Tally of one block of a key with itself, or of two with each other."""
    blobs = table.column("entries").to_pylist()
    parts = [_unpack(b) for b in blobs]
    entries = _joined(parts)
    n, all_ = len(parts[0][0]), len(entries[0])
    out = []
    for k in range(n):
        right = np.arange(n if len(parts) > 1 else k + 1, all_)
        out.append(_pairs(threshold, entries, np.full(len(right), k), right))
    return pa.Table.from_batches([_tallied(out)])


def _candidates(entries: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes a < b that share the guaranteed minimum, by size and place able to reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket = None, _Bucket(threshold)
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != at:
                    yield from bucket.finish()
                    at, bucket = k, _Bucket(threshold)
                yield from bucket.add(blob.as_py())
        yield from bucket.finish()

    # written, since both branches below would else pair at the same time
    first = checkpointed(entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _TALLY_TYPE))
    blocks = first.where("entries is not null").select("key", "block", "entries")
    number = blocks.groupBy("key").agg(F.max("block").alias("last"))
    # spread before they are copied: the blocks of one key lie in one task's output
    grid = blocks.repartition("key", "block").join(number, "key").select("key", "entries", "block", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    grid = grid.select("key", "entries", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    more = grid.groupBy("key", "i", "j").applyInArrow(lambda t: _paired_blocks(t, threshold), _TALLY_TYPE)
    rows = first.where("entries is null").unionByName(more).select("class_a", "class_b", "shared", "asked")
    return tallied(rows)


def tallied(rows: DataFrame) -> DataFrame:
    """class_a and class_b that share what is asked of them, over all buckets."""
    tally = rows.groupBy("class_a", "class_b").agg(F.sum("shared").alias("shared"), F.first("asked").alias("asked"))
    return tally.where("shared >= asked").select("class_a", "class_b")


def _forty(packed: bytes) -> np.ndarray:
    """Numbers of 40 bits."""
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _verified(candidates: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """class_a, class_b and similarity of the candidates that reach the threshold; reads one text of each class concerned."""
    concerned = candidates.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    ids = classes.join(concerned, "class", "left_semi").groupBy("class").agg(F.min("id").alias("id"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches):
            hashes, ends = shingle_sets(b.column(1).to_pylist(), n)
            five = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
            sets = [five[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["class", "set"])

    sets = texts.join(sized(ids), "id").select("class", "text").mapInArrow(hashed, "class bigint, set binary").groupBy("class").agg(F.first("set").alias("set"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = _forty(x), _forty(y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(shared / (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.float64())], names=["class_a", "class_b", "similarity"])

    a, b = (sets.select(*(F.col(c).alias(f"{c}_{x}") for c in ("class", "set"))) for x in "ab")
    pairs = candidates.join(a, "class_a").join(b, "class_b").select("class_a", "class_b", "set_a", "set_b")
    return pairs.mapInArrow(compare, "class_a bigint, class_b bigint, similarity double").where(F.col("similarity") >= F.lit(threshold - 1e-12))


def similar_classes(df: DataFrame, key: str = "id", text: str = "text", threshold: float = THRESHOLD, n: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Two tables: class of every id (texts with equal sets share one), and class_a < class_b, similarity of all similar classes.

    Null ids and null texts are left out, repeated rows count once.  Texts with
    fewer than n words are similar only where they are equal as stored.
    """
    texts = _keyed(df, key, text)
    rows = _sets(texts, n).persist(StorageLevel.DISK_ONLY)
    sketch = _sketch(rows)
    classes = rows.where("id is not null").groupBy("id").agg(F.min("class").alias("class"))
    sizes = rows.where("size > 0").groupBy("size").count().collect()
    buckets = max(1, sum(prefix(r["size"], threshold) * r["count"] for r in sizes) // BUCKET)
    candidates = checkpointed(_candidates(_entries(texts, sketch, threshold, n, buckets), threshold))
    return classes, _verified(candidates, classes, texts, threshold, n)


def similar_pairs(df: DataFrame, key: str = "id", text: str = "text", threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """id_a < id_b of all texts whose similarity reaches the threshold, copies spelled out as pairs."""
    classes, near = similar_classes(df, key, text, threshold, n)
    near = near.select("class_a", "class_b").unionByName(near.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    copied = classes.groupBy("class").count().where("count > 1").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"))
    a, b = (classes.select(F.col("id").alias(f"id_{x}"), F.col("class").alias(f"class_{x}")) for x in "ab")
    return near.unionByName(copied).join(a, "class_a").join(b, "class_b").where("id_a < id_b").select("id_a", "id_b")


def components(edges: DataFrame) -> DataFrame:
    """node and group (the smallest node it is linked to, over any number of links) of every node of the edges a, b.

    Each round takes every node's smallest neighbour's group and then the group of
    that group; both are joins on the node, cut off by a checkpoint.  It ends when
    no group changes.
    """
    links = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    groups = checkpointed(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("group")).select(F.col("a").alias("node"), "group"))
    while True:
        reach = links.join(groups.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("group").alias("near"))
        hooked = groups.join(reach.withColumnRenamed("a", "node"), "node").select("node", F.least("group", "near").alias("group"), F.col("group").alias("before"))
        jump = hooked.select(F.col("node").alias("group"), F.col("group").alias("further"))
        new = checkpointed(hooked.join(jump, "group", "left").select("node", F.least("group", "further").alias("group"), "before"))
        if new.where("group <> before").limit(1).count() == 0:
            return new.select("node", "group")
        groups = new.select("node", "group")


def similar_groups(df: DataFrame, key: str = "id", text: str = "text", threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """id, class, group and links of every text: its group over all links (its class where it has none) and the number of other classes it is similar to."""
    classes, near = similar_classes(df, key, text, threshold, n)
    near = checkpointed(near.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    groups = components(near)
    links = near.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    out = classes.join(groups.withColumnRenamed("node", "class"), "class", "left").join(links, "class", "left")
    return out.select("id", "class", F.coalesce("group", "class").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
