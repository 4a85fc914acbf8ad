"""Repeated passages by sparse suffix arrays.

Of the suffixes of a text, those are kept that start at minimisers: among any
``window`` neighbouring runs of ``gram`` words the run whose hash is least. Which
suffixes are kept depends on the content alone, and a passage of
``gram + window - 1`` words holds one of them wherever it stands. So two texts that
share such a passage share a kept suffix's beginning.

Suffixes whose first ``gram`` words occur in more than one document are sorted by
content: the words from there on, then the words before it, backwards. Neighbours in
this order, and in the order that compares backwards first, are compared and the
match extended left and right word by word. A match of ``least`` words or more is kept.
Extensions reach ``window`` words back and ``least`` words on, which is as far as the
next kept suffix of the passage, so the matches of its suffixes join to the whole of it.
A row is such a whole passage, in which every word stands in a run of ``least`` words that
another document has; its ``parts`` say which document has which words of it in one piece.

Where a suffix's best match ahead and its best match back are with different texts, a
third text, no neighbour in either order, might share a run of ``least`` words that
neither has; the runs in doubt are then compared as wholes over all suffixes of that
beginning, by 128-bit hashes, so that no match is lost.

Sorted rows are dealt by ranges that may split one beginning, or one whole context,
over tasks. Each range names its outermost rows of two documents at either end, four rows;
from these every range learns its neighbours, and the rows of its first and last document
are compared with them where they lie. No group is gathered.

Words are runs of other than ASCII white space, as they stand. Defined results: a null
text counts as empty. Texts under ``least`` words have no passage. What repeats only
within one document is none. Repeated rows are different documents. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, join_hot, settled, with_row_id

LEAST, GRAM = 50, 20
#: Bytes of texts whose words are hashed at once.
SLICE = 1 << 20
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Words(dict):
    """word -> its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 600_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _sliding(a: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over each ``width`` neighbours, by doubling."""
    done = 1
    out = a
    while 2 * done <= width:
        out = f(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return f(out[: len(out) - rest], out[rest:]) if rest else out


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """The polynomial hash of each ``width`` neighbours, by doubling."""
    power = [pow(int(_MUL), k, 1 << 64) for k in range(width + 1)]
    out, done, part, size = None, 0, hashes, 1  # part: hashes of ``size`` neighbours
    while True:
        if width & size:  # ``done`` neighbours, then ``size`` more
            out = part if out is None else out[: len(hashes) - done - size + 1] * np.array(power[size], np.uint64) + part[done:]
            done += size
        if 2 * size > width:
            return out
        part = part[:-size] * np.array(power[size], np.uint64) + part[size:]
        size *= 2


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_INVERSE = pow(int(_MUL), -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.multiply.accumulate(factors)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, power: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts ``data[starts:ends]``, which lie one after the
    other, and the text it is in. A word's bytes are the coefficients of a polynomial."""
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[starts] = first[ends] = True  # no word spans two texts
    begin = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | first[1:-1]]) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & np.r_[~inside[1:] | first[1:-1], True]) + 1 if len(data) else begin
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    value = (total[end] - total[begin]) * inverse[begin]
    value ^= value >> np.uint64(32)
    return value * _MIX, np.searchsorted(starts, begin, "right") - 1


def minimisers(hashes: np.ndarray, text: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept suffixes among the words and the hashes of their first ``gram``
    words. ``text``, ascending: the text of each word; no run goes over two of them."""
    n = len(hashes) - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = _rolled(hashes, gram)
    value = (value ^ (value >> np.uint64(29))) * _MIX
    value ^= value >> np.uint64(32)
    value |= np.uint64(1)  # never zero, as windows over two texts are
    least = _sliding(value, window, np.minimum)
    least[text[: len(least)] != text[gram + window - 2 :]] = 0
    pad = np.zeros(window - 1, np.uint64)
    best = _sliding(np.concatenate([pad, least, pad]), window, np.maximum)
    at = np.flatnonzero(best == value)
    return at, value[at]


def kept_suffixes(rows: DataFrame, gram: int, window: int) -> DataFrame:
    """h, rid, pos of every kept suffix. ``rows``: rid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = inverse = np.zeros(0, np.uint64)
        for batch in batches:
            rid, column = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).fill_null(b"")
            offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
            at = 0
            while at < len(rid):
                # some whole texts, a bounded number of bytes unless one text alone has more
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
                data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[at] : offsets[to]]
                if len(data) > len(power):
                    power, inverse = _powers(int(_MUL), len(data)), _powers(_INVERSE, len(data))
                starts = offsets[at:to] - offsets[at]
                hashes, text = word_hashes(data, starts, offsets[at + 1 : to + 1] - offsets[at], power, inverse)
                place, h = minimisers(hashes, text, gram, window)
                before = np.searchsorted(text, np.arange(to - at))  # words of the texts before
                where = text[place]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rid[at:to][where]), pa.array((place - before[where]).astype(np.int32))], ["h", "rid", "pos"])
                at = to

    return rows.select("rid", "text").mapInArrow(run, "h long, rid long, pos int")


def with_context(rows: DataFrame, back: int, ahead: int) -> DataFrame:
    """h, rid, doc_id, pos, ahead (words from pos on), back (words before pos, nearest
    first) for each place in ``rows``: rid, doc_id, text, places (pos, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "rid", "doc_id", "pos", "ahead", "back"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for rid, doc_id, t, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                words = t.as_py().split()
                for place in places.as_py():
                    p = place["pos"]
                    row = (place["h"], rid, doc_id, p, b" ".join(words[p : p + ahead]), b" ".join(words[max(0, p - back) : p][::-1]))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                if len(out[0]) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], names)
                    out = [[] for _ in names]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], names)

    return rows.select("rid", "doc_id", "text", "places").mapInArrow(run, "h long, rid long, doc_id long, pos int, ahead binary, back binary")


def common_words(a: bytes, b: bytes) -> int:
    """How many words two blank-separated texts share from their start."""
    if a == b:
        return a.count(b" ") + 1 if a else 0
    low, high = 0, min(len(a), len(b))
    while low < high:  # the shared bytes, by halving
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    whole = low and (low == len(a) or a[low] == 32) and (low == len(b) or b[low] == 32)
    return a.count(b" ", 0, low) + bool(whole)


_ROW = "h long, rid long, doc_id long, pos int, ahead binary, back binary"
FOUND = f"{_ROW}, left_words int, right_words int, other_id long, other_rid long, shift int, state string, part int"
MATCH, OPEN = "match", "open"
#: Rows of a range's first and last document, to be compared with the ranges before and after.
BEFORE, AFTER, BOTH = "before", "after", "both"
#: A range's first row and first one of a second document; its last row, and the last of another.
FIRST, SECOND, LAST, OTHER = "first", "second", "last", "other"
_NAMES = [c.split()[0] for c in FOUND.split(", ")]
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


class Comparison:
    """Best matches of rows and what comes out of comparing them."""

    def __init__(self, least: int, forwards: bool, part: int):
        self.least, self.forwards, self.part, self.out = least, forwards, part, []

    def match(self, row: list, b: tuple, known: tuple[int, int] | None = None) -> tuple[int, int] | None:
        """``row`` (its values, best match so far) takes what it shares with the values ``b``:
        words ahead and back, ``known`` if these two were compared before."""
        a = row[0]
        if a[0] != b[0]:
            return None
        right, left = known or (common_words(a[4], b[4]), common_words(a[5], b[5]))
        row[1] = max(row[1], (right, left) if self.forwards else (left, right))
        if left + right >= self.least:
            self.out.append((*a[:4], None, None, left, right, b[2], b[1], b[3] - a[3], MATCH, self.part))
        return right, left

    def release(self, row: list) -> None:
        """Passes the row on as open if its best match is less than all it has."""
        a, best = row[:2]
        if best[0] < 0:
            return
        right, left = best if self.forwards else best[::-1]
        if right < a[4].count(b" ") + bool(a[4]) or left < a[5].count(b" ") + bool(a[5]):
            self.out.append((*a[:4], None, None, left, right, None, None, None, OPEN, self.part))

    def keep(self, row: list, state: str) -> None:
        """Passes the whole row on, with its best match so far."""
        right, left = row[1] if self.forwards else row[1][::-1]
        self.out.append((*row[0], left, right, None, None, None, state, self.part))


def _neighbours(least: int, forwards: bool):
    """Compare each sorted row of a range with the nearest rows of another document, both
    ways. Passes on matches, open rows, the rows of the first and last document, and the
    range's outermost rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Comparison(least, forwards, TaskContext.get().partitionId())
        first = last = other = None  # the first row, the last, and the last of another document than that
        held: list[list] = []  # rows of the last document, waiting for one of another
        second, known = False, None

        def settle(rows):
            for row in rows:
                c.keep(row, BEFORE) if row[2] else c.release(row)

        for batch in batches:
            for values in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if first is None:
                    first = values
                    c.keep([values, (-1, -1)], FIRST)
                elif last[1] != values[1]:
                    other = last
                    if not second:
                        second = True
                        c.keep([values, (-1, -1)], SECOND)
                    known = None
                    for row in held:
                        known = c.match(row, values)
                    settle(held)
                    held = []
                elif held and held[-1][0][0] != values[0]:  # nothing of their beginning follows
                    settle(held)
                    held = []
                row = [values, (-1, -1), not second]  # the last: whether of the first document
                if other is not None:
                    c.match(row, other, known)  # known: the last row held was ``other``
                known = None
                held.append(row)
                last = values
            if len(c.out) >= 5000:
                yield _batch(c.out)
                c.out.clear()
        for row in held:
            c.keep(row, BOTH if row[2] else AFTER)
        if last is not None:
            c.keep([last, (-1, -1)], LAST)
        if other is not None:
            c.keep([other, (-1, -1)], OTHER)
        if c.out:
            yield _batch(c.out)

    return run


_BESIDE = pa.schema([("part", pa.int32()), ("before", pa.list_(pa.struct(list(zip(_NAMES[:6], _TYPES[:6], strict=True))))), ("after", pa.list_(pa.struct(list(zip(_NAMES[:6], _TYPES[:6], strict=True)))))])


def _beside(group: pa.Table) -> pa.Table:
    """For each range the nearest row before it of another document than its first one, and
    the nearest after it of another than its last one, from four rows of each range."""
    ends: dict[int, dict] = {}
    for r in group.select([*_NAMES[:6], "state", "part"]).to_pylist():
        ends.setdefault(r["part"], {})[r["state"]] = {n: r[n] for n in _NAMES[:6]}
    order = sorted(ends)
    found: dict[int, list] = {p: [[], []] for p in order}
    for side, parts, near, far, out in ((0, order, FIRST, SECOND, (LAST, OTHER)), (1, order[::-1], LAST, OTHER, (FIRST, SECOND))):
        x = y = None  # the nearest row so far, and the nearest of another document than that
        for p in parts:
            e = ends[p]
            at = x if x is None or x["rid"] != e[near]["rid"] else y
            found[p][side] = [at] if at is not None else []
            one, two = e[out[0]], e.get(out[1])
            if two is None:
                two = x if x is not None and x["rid"] != one["rid"] else y
            x, y = one, two
    return pa.table({"part": pa.array(order, pa.int32()), "before": pa.array([found[p][0] for p in order], _BESIDE.types[1]), "after": pa.array([found[p][1] for p in order], _BESIDE.types[2])}, schema=_BESIDE)


def _settled_edges(least: int, forwards: bool):
    """Compare the rows of a range's first and last document with the ranges beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = Comparison(least, forwards, 0)
            for *values, left, right, state, before, after in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                row = [tuple(values), (right, left) if forwards else (left, right)]
                for some in (before if state != AFTER else None, after if state != BEFORE else None):
                    for other in some or []:
                        c.match(row, tuple(other[n] for n in _NAMES[:6]))
                c.release(row)
            if c.out:
                yield _batch(c.out)

    return run


def _matches(suffixes: DataFrame, order: list[str], least: int) -> DataFrame:
    """h, rid, doc_id, pos, left_words, right_words, other_id, other_rid, shift, state from one sorted order."""
    rows, forwards = suffixes.select(*_NAMES[:6]), order[0] == "ahead"
    keys = ["h", *order, "rid", "pos"]
    found = Table(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_neighbours(least, forwards), FOUND)).df
    ends = found.where(F.col("state").isin(FIRST, SECOND, LAST, OTHER)).withColumn("one", F.lit(True)).groupBy("one")  # four rows a range
    beside = ends.applyInArrow(_beside, f"part int, before array<struct<{_ROW.replace(' ', ':').replace(',:', ',')}>>, after array<struct<{_ROW.replace(' ', ':').replace(',:', ',')}>>")
    edge = found.where(F.col("state").isin(BEFORE, AFTER, BOTH)).join(beside, "part")
    again = edge.select(*_NAMES[:6], "left_words", "right_words", "state", "before", "after").mapInArrow(_settled_edges(least, forwards), FOUND)
    return found.where(F.col("state").isin(MATCH, OPEN)).unionByName(Table(again).df).drop("ahead", "back", "part")


def _unresolved(a: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """h, back: beginnings and numbers of words before them for which a run of ``least``
    words is in doubt. A row's best match ahead shares so much (r1) on and so much back
    (l1), its best match back r2 and l2. Runs with up to l1 words back and r1 on, or l2 and
    r2, are matched by these two; ones with over l2 back or over r1 on by nothing. Those
    in between might be matched by a third text."""
    one = a.where(F.col("state") == OPEN).groupBy("h", "rid", "pos").agg(F.max(F.struct("right_words", "left_words")).alias("x"))
    two = b.where(F.col("state") == OPEN).groupBy("h", "rid", "pos").agg(F.max(F.struct("left_words", "right_words")).alias("y"))
    low = F.greatest(F.col("x.left_words") + 1, least - F.col("x.right_words"))
    high = F.least(F.col("y.left_words"), least - 1 - F.col("y.right_words"))
    doubt = one.join(two, ["h", "rid", "pos"]).select("h", low.alias("low"), high.alias("high")).where("low <= high")
    return doubt.select("h", F.explode(F.sequence("low", "high")).alias("j")).groupBy("h").agg(F.collect_set("j").alias("backs"))


def windows_of(suffixes: DataFrame, least: int) -> DataFrame:
    """The runs of ``least`` words that start ``backs`` words before each suffix, as rid,
    doc_id, start and the words' 128-bit hash."""
    names, types = ["rid", "doc_id", "start", "content"], (pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for rid, doc_id, pos, ahead, back, backs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before = back.split(b" ")[::-1] if back else []
                words = before + ahead.split(b" ")
                joined = b" ".join(words)
                starts = [0, *accumulate(len(w) + 1 for w in words)]
                for j in backs:
                    at = len(before) - j
                    if at >= 0 and at + least <= len(words) and j <= least:
                        content = xxhash.xxh128_digest(joined[starts[at] : starts[at + least] - 1])
                        for column, x in zip(out, (rid, doc_id, pos - j, content), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], names)

    return suffixes.select("rid", "doc_id", "pos", "ahead", "back", "backs").mapInArrow(run, "rid long, doc_id long, start int, content binary")


def _shared_windows(suffixes: DataFrame, least: int) -> DataFrame:
    """rid, doc_id, a, b, other_id, other_rid, shift of the windows that two documents have."""
    rows = Table(windows_of(suffixes, least)).df
    place = F.struct("rid", "doc_id", "start")
    twice = rows.groupBy("content").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count(F.lit(1)).alias("n")).where("x.rid < y.rid")
    twice = Table(twice).df
    found = join_hot(rows, twice, "content", "n", rows.count()).withColumn("o", F.when(F.col("rid") == F.col("x.rid"), F.col("y")).otherwise(F.col("x")))
    return found.select("rid", "doc_id", F.col("start").alias("a"), (F.col("start") + least).alias("b"), F.col("o.doc_id").alias("other_id"), F.col("o.rid").alias("other_rid"), (F.col("o.start") - F.col("start")).alias("shift"))


def _runs(table: pa.Table, same: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For rows in the order of the columns ``same`` and a: the first row and the furthest end
    of each run of rows equal in ``same`` whose spans a to b overlap or touch."""
    a, b = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "b"))
    new = np.r_[True, np.any([np.diff(table.column(c).to_numpy()) != 0 for c in same], axis=0)]
    group, wide = np.cumsum(new), np.int64(1) << 32
    reach = np.maximum.accumulate(group * wide + b)  # the furthest end so far among equals
    new[1:] |= group[1:] * wide + a[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return first, np.maximum.reduceat(b, first).astype(np.int32)


def _in_runs(batches: Iterator[pa.RecordBatch], same: list[str], close) -> Iterator[pa.RecordBatch]:
    """``close(table, first, end)`` for the runs of the sorted batches, none of them cut."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if table.num_rows:
            first, end = _runs(table, same)
            held = table.slice(first[-1])
            if len(first) > 1:
                yield from close(table.slice(0, first[-1]), first[:-1], end[:-1]).combine_chunks().to_batches()
    if held is not None:
        yield from close(held, *_runs(held, same)).combine_chunks().to_batches()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans rid, doc_id, a, b, other_id, other_rid, shift: those that touch are joined where
    they lie equally shifted in one other row, which so has the joined span too."""

    def close(table, first, end):
        return table.take(first).set_column(3, "b", pa.array(end))

    return _in_runs(batches, ["rid", "other_rid", "shift"], close)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, doc_id, a, b and parts (other_id, start_word, end_word) of whole passages."""

    def close(table, first, end):
        keys = [table.column(c).to_numpy() for c in ("rid", "a", "b", "other_rid")]
        new = np.r_[True, np.any([np.diff(x) != 0 for x in keys], axis=0)]  # a part may be found more than once
        starts = np.r_[0, np.cumsum(new)][np.r_[first, table.num_rows]].astype(np.int32)
        heads, table = table.take(first), table.filter(pa.array(new)).combine_chunks()
        part = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in ("other_id", "a", "b")], ["other_id", "start_word", "end_word"])
        lists = pa.ListArray.from_arrays(pa.array(starts), part)
        return pa.table([heads.column("rid"), heads.column("doc_id"), heads.column("a"), pa.array(end), lists], ["rid", "doc_id", "a", "b", "parts"])

    return _in_runs(batches, ["rid"], close)


def repeated_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each passage of ``least`` words or more that other documents have:
    rid, doc_id, start_word, end_word (exclusive), n_words, parts (other_id, start_word,
    end_word: words of the passage that the other document has in one piece, at least
    ``least``; together they are the passage), other_id (the smallest of parts; null if all are)."""
    window = least - gram + 1
    rows = with_row_id(settled(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))), "rid")
    kept = Table(kept_suffixes(rows, gram, window))
    shared = kept.df.groupBy("h").agg(F.min("rid").alias("a"), F.max("rid").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("h", "n")
    shared = Table(shared)
    places = join_hot(kept.df, shared.df, "h", "n", kept.df.count()).groupBy("rid").agg(F.collect_list(F.struct("pos", "h")).alias("places"))
    suffixes = Table(with_context(rows.join(places, "rid"), window, least))
    kept.drop()
    shared.drop()
    ahead, back = (_matches(suffixes.df, order, least) for order in (["ahead", "back"], ["back", "ahead"]))
    spans = [
        m.where(F.col("state") == MATCH).select("rid", "doc_id", (F.col("pos") - F.col("left_words")).alias("a"), (F.col("pos") + F.col("right_words")).alias("b"), "other_id", "other_rid", "shift") for m in (ahead, back)
    ]
    rest = suffixes.df.join(Table(_unresolved(ahead, back, least)).df, "h")
    third = _shared_windows(rest, least)
    suffixes.drop()
    found = spans[0].unionByName(spans[1]).unionByName(third)
    columns = "rid long, doc_id long, a int, b int, other_id long, other_rid long, shift int"
    sorted_spans = found.select(*(c.split()[0] for c in columns.split(", "))).repartition("rid").sortWithinPartitions("rid", "other_rid", "shift", "a")
    united = sorted_spans.mapInArrow(_united, columns).sortWithinPartitions("rid", "a", "b", "other_rid")  # still all of a row in one partition
    whole = united.mapInArrow(_passages, "rid long, doc_id long, a int, b int, parts array<struct<other_id:long,start_word:int,end_word:int>>")
    return whole.select("rid", "doc_id", F.col("a").alias("start_word"), F.col("b").alias("end_word"), (F.col("b") - F.col("a")).alias("n_words"), F.array_min("parts.other_id").alias("other_id"), "parts")
