"""Filling of containers with texts by minimum bin slack.

Each container begins with the longest text left; a subset-sum table over the
other lengths, a bit for each sum, then finds the fullest combination that fits.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import VOCABULARY, size

#: Texts that wait at most before containers are filled, and that are left waiting for the next ones.
MOST_WAITING, LEAST_WAITING = 6000, 2000


class Packer:
    """Containers of one capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.waiting: dict[int, list[tuple]] = {}
        self.lengths: list[int] = []
        self.number = 0

    def add(self, item: tuple, length: int) -> None:
        if length not in self.waiting:
            self.waiting[length] = []
            insort(self.lengths, length)
        self.waiting[length].append(item)
        self.number += 1

    def _take(self, length: int) -> tuple[tuple, int]:
        items = self.waiting[length]
        item = items.pop(), length
        if not items:
            del self.waiting[length]
            self.lengths.remove(length)
        self.number -= 1
        return item

    def _fullest(self, room: int) -> list[int]:
        """Lengths of the waiting texts that fill the room best, longest first among equal sums."""
        reached, full, steps = 1, (1 << (room + 1)) - 1, []
        for length in reversed(self.lengths):
            if length > room:
                continue
            for _ in range(min(len(self.waiting[length]), room // length)):
                more = (reached | reached << length) & full
                if more == reached:
                    break
                steps.append((length, reached))
                reached = more
            if reached >> room:
                break
        best, chosen = reached.bit_length() - 1, []
        for length, before in reversed(steps):
            if not before >> best & 1:
                chosen.append(length)
                best -= length
        return chosen

    def filled(self, leave: int) -> Iterator[list[tuple[tuple, int]]]:
        """Containers, until no more than leave texts wait."""
        while self.number > leave:
            longest = self.lengths[-1]
            box = [self._take(longest)]
            box += [self._take(n) for n in self._fullest(self.capacity - longest)]
            yield box


def fill(documents: DataFrame, config: DataFrame, vocabulary: str = VOCABULARY, default_capacity: int = 2048) -> DataFrame:
    """container_id, doc_id, part, token_start, tokens, capacity: every text in one container, one over the capacity in parts.

    Parts are as long as the capacity, the last one takes what is left.  Null and
    empty texts have no tokens and the container null.  The capacity is that of
    the document's source, default_capacity where it has none.  Each task fills
    containers from its own texts, some thousands at a time, so nothing is
    shuffled and only the last containers of a task and capacity, when few texts are left, are filled badly.
    A task sees at most MOST_WAITING texts of a capacity at a time, so which texts
    share a container depends on how the table is partitioned.  Repeated rows are
    placed each for itself.
    """
    capacities = {r.source: r.capacity for r in config.where("source is not null and capacity > 0").groupBy("source").agg(F.min("capacity").alias("capacity")).collect()}
    names = ["container_id", "doc_id", "part", "token_start", "tokens", "capacity"]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers: dict[int, Packer] = {}
        first = TaskContext.get().partitionId() << 32
        number = 0
        for b in batches:
            rows: list[tuple] = []
            for doc, text, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                capacity = capacities.get(source, default_capacity)
                packer = packers.setdefault(capacity, Packer(capacity))
                tokens = size(text, vocabulary)
                if not tokens:
                    rows.append((None, doc, 0, 0, 0, capacity))
                for part, start in enumerate(range(0, tokens, capacity)):
                    packer.add((doc, part, start), min(capacity, tokens - start))
            for packer in packers.values():
                if packer.number > MOST_WAITING:
                    for box in packer.filled(LEAST_WAITING):
                        rows += [(first + number, *item, n, packer.capacity) for item, n in box]
                        number += 1
            yield table(rows)
        rows = []
        for packer in packers.values():
            for box in packer.filled(0):
                rows += [(first + number, *item, n, packer.capacity) for item, n in box]
                number += 1
        yield table(rows)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source").mapInArrow(run, "container_id bigint, doc_id bigint, part int, token_start int, tokens int, capacity int")
