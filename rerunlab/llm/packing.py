"""Best-fit decreasing packing with a segment tree over remaining capacities.

Lengths are whole numbers up to the capacity, so the counts of pieces by length, at
most ``capacity`` numbers, decide the packing. The driver runs best-fit decreasing
over these counts: for each length, longest first, a segment tree over remaining
capacities finds the tightest open sequence in logarithmic time, and all pieces that
meet the same answer are placed by one step. The result is the packing that placing
single documents would give, as a list of steps: so many pieces of a length, from
this rank on, into sequences from this number on, at this place. Ranks are dealt
without gathering a length in one task, and each task looks its pieces up in the
steps, whose number depends on the lengths that occur and not on the documents.

Defined results: a null text counts as empty; every document ends with ``end_id``, so
none has no tokens. Only documents over the capacity are cut, every capacity tokens.
Repeated rows are packed each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, gapless, with_row_id
from .vocab import WORD_BPE, word_encoder

CAPACITY = 4096


class Capacities:
    """A segment tree over capacities 0 to ``most``: which have open sequences."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.open = [0] * (2 * self.size)

    def set(self, capacity: int, some: bool) -> None:
        at = capacity + self.size
        self.open[at] = int(some)
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, length: int) -> int:
        """The least capacity >= ``length`` that is open, or -1."""
        at = length + self.size
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return -1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, pieces, first sequence, offset, pieces in each
    sequence) of best-fit decreasing over ``counts`` (pieces by length)."""
    tree, ranges = Capacities(capacity), defaultdict(list)  # capacity left -> [first sequence, sequences]
    steps, opened = [], 0

    def add(left: int, first: int, n: int) -> None:
        if n:
            if left:
                tree.set(left, True)
                ranges[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            left = tree.tightest(length)
            if left < 0:
                left = capacity
                need = -(-rest // (capacity // length))
                first, n = opened, need
                opened += need
            else:
                first, n = ranges[left].pop()
                if not ranges[left]:
                    tree.set(left, False)
            each = left // length
            full = min(n, rest // each)
            if full:
                steps.append((length, rank, full * each, first, capacity - left, each))
                rank, rest = rank + full * each, rest - full * each
                add(left - each * length, first, full)
            if rest and full < n:  # fewer than a sequence takes are left
                steps.append((length, rank, rest, first + full, capacity - left, rest))
                add(left - rest * length, first + full, 1)
                rank, rest, full = rank + rest, 0, full + 1
            add(left, first + full, n - full)
    return steps


def cut(docs: DataFrame, vocabulary: str = WORD_BPE, end_id: int = 1, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """rid, doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(vocabulary).ids, np.array([end_id], np.uint32)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for rid, doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.concatenate([encode(t.as_py() or ""), end]).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for column, x in zip(out, (rid, doc_id, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], ["rid", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = with_row_id(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "rid")
    return rows.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (unique by rid and piece, with length) with sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    steps = sorted(plan(counts, capacity))
    table = np.array(steps, np.int64).reshape(-1, 6)
    starts = (table[:, 0] << 44) + table[:, 1]
    where = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            step = table[np.searchsorted(starts, (length << 44) + rank, "right") - 1]
            i = rank - step[:, 1]
            sequence, offset = step[:, 3] + i // step[:, 5], step[:, 4] + i % step[:, 5] * length
            kept = [batch.column(batch.schema.get_field_index(c)) for c in where]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*where, "sequence_id", "offset"])

    ranked = gapless(pieces, ["length"], ["rid", "piece"], "rank", sum(counts.values()), sizes=counts)
    kinds = ", ".join(f"`{n}` {k}" for n, k in pieces.dtypes)
    return ranked.select(*where, "rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = Table(cut(docs, **how)).df
    return pack(pieces, how.get("capacity", CAPACITY)).drop("rid")
