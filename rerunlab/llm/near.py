"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The wide form of the SimHash operator. Sets of n and m shingles are that similar when at
most a ninth of n + m shingles are in only one of them, a Hamming distance between the
sets. Majority bits of 64 keep too little of it (at 0.8 about ten bits differ, and blocks
for a radius that holds nearly all such pairs would have three bits), so the blocks are
cut from the set itself, as a vector with one bit for each possible shingle:

1. A shingle that one text alone has differs from every other text. A text with over a
   fifth of such shingles has no near copy and is done. Which shingles occur in one text
   only is found by ranges of their hashes, each range in a task of bounded size.
2. Pigeonhole: where at most d shingles differ, of ``d + 1`` blocks of shingles (dealt by
   their hash) one is equal. Sizes fall into classes, each 1 / 0.8 times the one before,
   so that similar texts are of one class or neighbouring ones; d is the class's bound.
   ``spare`` further blocks make up for blocks that are empty in both; texts with more
   empty blocks than that meet in a bucket of their own.
3. Texts that share a block are compared as whole sets, with them the candidates that the
   fingerprints give (``simhash.drop_similar``).

Texts with equal sets are one class and never paired. In a small bucket (texts that share
a block) all pairs are compared, in a large one every text with the first; large
buckets whose texts these links leave in several components are compared across
components: the texts of buckets that hang together once, or bucket by bucket where that
sends less, dealt into chunks by their shingles, each two chunks in a task of bounded size. A
task counts the shingles that texts share as products of matrices. No step leaves out a pair
that is similar.

Words are lower-cased (A-Z) runs of other than ASCII white space. Shingles count as equal
when their 64-bit hashes are. Defined results: a null text counts as empty; texts
without words are one class; fewer words than a shingle form one shingle. Repeated
rows share a component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, join_hot, settled, unused, with_row_id
from .graph import components
from .suffix import _MIX, _MUL, Words

SHINGLE, PERCENT = 5, 80
#: Shingles of one message chunk, and of one range of hashes (one task).
MESSAGE, RANGE = 1 << 20, 1 << 22
SEVERAL = np.uint16(0xFFFF)
SMALL = 8
#: Shingles of texts that one task compares with each other; the texts and shingles of a chunk of more.
CLUSTER, CHUNK, WEIGHT = 1 << 20, 2048, 1 << 19
#: Pairs of texts, and places of rare shingles, that a task counts at once.
HELD = 1 << 21


def shingles(text: bytes, memo: Words, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    value = np.zeros(n, np.uint64)
    for j in range(width):
        value = value * _MUL + hashes[j : j + n]
    value = (value ^ (value >> np.uint64(29))) * _MIX
    value ^= value >> np.uint64(32)
    return np.unique(value)


def similar(shared, n, m, percent: int):
    """Whether sets of n and m shingles with ``shared`` in common are similar enough."""
    return 100 * shared >= percent * (n + m - shared)


def most_alone(n, percent: int):
    """How many of n shingles a similar set may lack."""
    return n - -(-percent * n // 100)


def _messages(shingle: int, bits: int):
    """Sets of shingles as messages to the ranges of their hashes: part (the first ``bits``
    bits), chunk, the next 32 bits of each hash and the number of its text in the chunk. A
    hash that several texts of the chunk have is sent once, as SEVERAL's. One more message
    (part < 0) has the chunk's rows and how many shingles of each are known to be shared."""

    def message(rids, doc_ids, sets) -> Iterator[tuple]:
        n = np.array([len(s) for s in sets], np.int64)
        values, place = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        order = np.argsort(values, kind="stable")
        values, place = values[order], place[order]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
        runs = np.diff(np.r_[first, len(values)])
        several = np.repeat(runs > 1, runs)
        shared = np.bincount(place[several], minlength=len(sets))
        who = np.where(runs > 1, SEVERAL, place[first].astype(np.uint16)).astype(np.uint16)
        values = values[first]
        part = (values >> np.uint64(64 - bits)).astype(np.int64)
        low = (values >> np.uint64(32 - bits)).astype(np.uint32)
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True][: len(part) + 1]) if len(part) else np.zeros(1, int)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(part[a]), rids[0], low[a:b].tobytes(), who[a:b].tobytes(), None
        rows = [{"rid": r, "doc_id": d, "n": len(s), "content": xxhash.xxh128_digest(s.tobytes()), "shared": int(k)} for r, d, s, k in zip(rids, doc_ids, sets, shared, strict=True)]
        yield -1 - rids[0] % (1 << bits), rids[0], None, None, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, rids, docs, sets, size = Words(), [], [], [], 0

        def emit():
            columns = zip(*message(rids, docs, sets), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _MESSAGE.types, strict=True)], schema=_MESSAGE)

        for batch in batches:
            for rid, doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                rids.append(rid)
                docs.append(doc_id)
                sets.append(shingles(t.as_py() or b"", memo, shingle))
                size += len(sets[-1])
                if size >= MESSAGE or len(sets) >= SEVERAL:
                    yield emit()
                    rids, docs, sets, size = [], [], [], 0
        if sets:
            yield emit()

    return run


_ROW = pa.struct([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("content", pa.binary()), ("shared", pa.int32())])
_MESSAGE = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("low", pa.binary()), ("who", pa.binary()), ("rows", pa.list_(_ROW))])
_MESSAGES = "part long, chunk long, low binary, who binary, rows array<struct<rid:long,doc_id:long,n:int,content:binary,shared:int>>"


def _answers(group: pa.Table) -> pa.Table:
    """For a range of hashes: by chunk, the texts (by number, once for each shingle) whose
    shingles another chunk has too. The rows of a chunk pass unchanged."""
    if group.column("part")[0].as_py() < 0:
        return group
    low = [np.frombuffer(x, np.uint32) for x in group.column("low").to_pylist()]
    sizes = np.array([len(x) for x in low])
    _, inverse, count = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
    who = np.concatenate([np.frombuffer(x, np.uint16) for x in group.column("who").to_pylist()])
    known = (count[inverse] > 1) & (who != SEVERAL)
    ends = np.cumsum(sizes)
    told = [who[a:b][known[a:b]].tobytes() for a, b in zip(ends - sizes, ends, strict=True)]
    nothing = pa.nulls(len(told))
    return pa.table([group.column("part"), group.column("chunk"), nothing.cast(pa.binary()), pa.array(told, pa.binary()), nothing.cast(_MESSAGE.types[4])], schema=_MESSAGE)


def _judged(percent: int):
    """Rows of a chunk with ``lone``: whether too many of the shingles are in no other text."""
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("content", pa.binary()), ("lone", pa.bool_())])

    def run(group: pa.Table) -> pa.Table:
        rows = [r for x in group.column("rows").to_pylist() if x for r in x]
        told = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(x, np.uint16) for x in group.column("who").to_pylist() if x)])
        shared = np.array([r["shared"] for r in rows]) + np.bincount(told, minlength=len(rows))
        n = np.array([r["n"] for r in rows])
        columns = [[r[c] for r in rows] for c in ("rid", "doc_id", "n", "content")] + [n - shared > most_alone(n, percent)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def judged(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """rid, doc_id, n (shingles), content (hash of the set), lone (no near copy is possible)."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, (size // 6 // RANGE).bit_length())
    sent = rows.select("rid", "doc_id", "text").mapInArrow(_messages(shingle, bits), _MESSAGES)
    told = Table(sent.groupBy("part").applyInArrow(_answers, _MESSAGES))
    out = Table(told.df.groupBy("chunk").applyInArrow(_judged(percent), "rid long, doc_id long, n int, content binary, lone boolean"))
    told.drop()
    return out.df


def size_classes(n: int, percent: int) -> tuple[int, int, int]:
    """The class of a set of n shingles, its least size and that of the next class."""
    at, low, high = 0, 1, 2
    while n >= high:
        at, low, high = at + 1, high, max(high + 1, -(-100 * high // percent))
    return at, low, high


def blocks_of(values: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the blocks of a set, for its own class of sizes and the next one."""
    n, out = len(values), []
    if not n:
        return np.zeros(0, np.uint64)
    at, _, high = size_classes(n, percent)
    after = max(high + 1, -(-100 * high // percent))
    for level, end in ((at, high), (at + 1, after)):
        if level > at and 100 * n // percent < high:  # no similar set is of the next class
            continue
        differ = 2 * (100 - percent) * (end - 1) // (100 + percent)
        spare = 2 + -(-(differ + 1) // 8)
        count = differ + 1 + spare
        salted = (values + np.array([level + 1], np.uint64) * _MUL) * _MIX
        salted ^= salted >> np.uint64(31)
        salted *= _MUL
        block = ((salted >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        order = np.argsort(block, kind="stable")
        block, salted = block[order], salted[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        total = np.add.reduceat(salted ^ (salted >> np.uint64(29)), first)
        sig = (total ^ (block[first] + np.uint64(1)) * _MUL) * _MIX + np.uint64(level)
        sig ^= sig >> np.uint64(32)
        out.append(sig)
        if count - len(first) > spare:  # it may share empty blocks alone
            out.append(np.array([level], np.uint64))
    return np.concatenate(out)


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """rid, n, sig: the blocks of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            sigs = [blocks_of(x, percent) for x in items]
            sizes = [len(s) for s in sigs]
            rid, n = np.repeat(batch.column(0).to_numpy(), sizes), np.repeat([len(x) for x in items], sizes).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sigs]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(n, pa.int32()), pa.array(flat)], ["rid", "n", "sig"])

    return sets.select("rid", "items").mapInArrow(run, "rid long, n int, sig long")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            sets = [shingles(t or b"", memo, shingle).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rid", "items"])

    return rows.select("rid", "text").mapInArrow(run, "rid long, items binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b of rids whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(bool(similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    one, two = sets.select(F.col("rid").alias("a"), F.col("items").alias("x")), sets.select(F.col("rid").alias("b"), F.col("items").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _shared(rows: slice, token: np.ndarray, ends: np.ndarray, rare: np.ndarray, dense: np.ndarray, held: tuple) -> np.ndarray:
    """How many shingles each text of ``rows`` shares with each text of the group."""
    texts, (holder, start, count) = len(ends) - 1, held
    own = slice(ends[rows.start], ends[rows.stop])
    out = dense[rows] @ dense.T
    some = token[own][rare[own]]
    who = np.repeat(np.arange(rows.stop - rows.start), np.diff(ends)[rows])[rare[own]]
    many = count[some]
    if len(some) and many.sum():  # every other holder of the rare shingles
        place = np.repeat(start[some] - np.cumsum(many) + many, many) + np.arange(many.sum())
        out += np.bincount(np.repeat(who, many) * texts + holder[place], minlength=out.size).reshape(out.shape)
    return out


def _across(percent: int):
    """Links between the components of a group of texts, enough to connect what is similar.
    Texts of one ``side`` are not compared with each other unless the group has one side.
    Shared shingles are counted for all pairs of a block of texts at once: those of many
    texts as a product of matrices, the others by their holders."""

    def run(group: pa.Table) -> pa.Table:
        rid, first = np.unique(group.column("rid").to_numpy(), return_index=True)
        label = np.unique(group.column("component").to_numpy()[first], return_inverse=True)[1]
        side = group.column("side").to_numpy()[first]
        links = []
        if label.any() and len(rid):
            sets = [np.frombuffer(x, np.uint64) for x in group.column("items").take(pa.array(first)).to_pylist()]
            n = np.array([len(x) for x in sets])
            order = np.lexsort((side, n))  # similar sets are of similar sizes
            rid, label, side, n = rid[order], label[order], side[order], n[order]
            _, token, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
            del sets
            ends = np.r_[0, np.cumsum(n)]
            able = np.add.reduceat(np.r_[count[token] > 1, False].astype(np.int64), ends[:-1]) >= n - most_alone(n, percent)
            able &= n > 0
            often = count > max(SMALL, len(n) // 32)  # fewer than 32 times a text's shingles on average
            column = np.cumsum(often) - 1
            text = np.repeat(np.arange(len(n)), n)
            dense = np.zeros((len(n), int(often.sum())), np.float32)
            dense[text[often[token]], column[token[often[token]]]] = 1
            rare = ~often[token] & (count[token] > 1)
            by = np.argsort(token[rare], kind="stable")
            holders = np.bincount(token[rare], minlength=len(count))
            held = text[rare][by], np.cumsum(holders) - holders, holders
            both = side.min() != side.max()
            work = np.r_[0, np.cumsum(np.add.reduceat(np.r_[np.where(rare, holders[token], 0), 0], ends[:-1]) * (n > 0) + len(n))]
            low = 0
            while low < len(n):
                high = max(low + 1, int(np.searchsorted(work, work[low] + HELD)))
                block = slice(low, min(high, len(n)))
                shared = _shared(block, token, ends, rare, dense, held)
                close = similar(shared, n[block, None], n[None, :], percent) & able[block, None] & able[None, :]
                if both:
                    close &= side[block, None] != side[None, :]
                for i in np.flatnonzero(close.any(axis=1)):
                    near = np.flatnonzero(close[i])
                    near = near[label[near] != label[low + i]]
                    labels, at = np.unique(label[near], return_index=True)
                    links += [(rid[low + i], rid[j]) for j in near[at]]
                    if len(labels):
                        label[np.isin(label, labels)] = label[low + i]
                low = block.stop
        pair = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pair[:, 0], "b": pair[:, 1]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _fits(n, m, percent: int):
    """Sizes that similar sets may have."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def links(postings: DataFrame, sets: DataFrame, percent: int, proposed: DataFrame | None = None) -> DataFrame:
    """Links a, b of rids that connect all similar texts. ``postings``: rid, n, sig; ``sets``: rid,
    items; ``proposed``: further pairs a, b (a < b) to verify before what is left is searched."""
    dealt = postings.repartition("sig")
    sizes = dealt.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.min("rid").alias("lead")).where("m > 1")
    met = Table(dealt.join(sizes.hint("merge"), "sig"))
    large = met.df.where(F.col("m") > SMALL)
    few = met.df.where(F.col("m") <= SMALL).select("sig", "rid", "n")
    other = few.select("sig", *(F.col(c).alias(f"{c}2") for c in ("rid", "n")))
    pairs = few.join(other.hint("merge"), "sig").where((F.col("rid") < F.col("rid2")) & _fits(F.col("n"), F.col("n2"), percent)).select(F.col("rid").alias("a"), F.col("rid2").alias("b"))
    led = large.where(F.col("rid") != F.col("lead")).select(F.col("lead").alias("a"), F.col("rid").alias("b"))
    pairs = pairs.unionByName(led)
    pairs = Table((pairs.unionByName(proposed) if proposed is not None else pairs).distinct())
    first = Table(_verified(pairs.df, sets, percent)).df
    pairs.drop()
    placed = Table(large.join(components(first).withColumnRenamed("node", "rid"), "rid", "left").select("sig", "rid", "n", "m", F.coalesce("component", "rid").alias("component")))
    met.drop()
    split = placed.df.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.first("m").alias("k"), F.min("rid").alias("hub")).where("x < y").select("sig", "k", "hub")
    rest = Table(join_hot(placed.df, split, "sig", "k", placed.df.count()))
    placed.drop()
    return first.unionByName(_apart(rest.df, sets, percent))


def _apart(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components within the buckets of ``rest`` (sig, rid, n, m, component, hub).
    Texts that are together in some bucket form clusters. A cluster is compared as a whole
    unless its buckets, each for itself, send fewer shingles. What has over CLUSTER shingles is
    dealt into chunks, each two of them compared in a task."""
    joined = components(rest.select(F.col("rid").alias("a"), F.col("hub").alias("b")).distinct()).select(F.col("node").alias("rid"), F.col("component").alias("cluster"))
    texts = rest.select("rid", "n", "component").distinct().join(joined, "rid", "left").select("rid", "n", "component", F.coalesce("cluster", "rid").alias("cluster"))
    texts = Table(texts).df
    chunks = F.when(F.col("w") <= CLUSTER, 1).otherwise(F.greatest(F.ceil(F.col("k") / CHUNK), F.ceil(F.col("w") / WEIGHT))).cast("int")
    buckets = rest.groupBy("sig").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("k"), F.first("hub").alias("rid")).join(texts.select("rid", "cluster"), "rid").select("sig", "cluster", "w", chunks.alias("chunks"))
    buckets = Table(buckets).df
    sent = buckets.groupBy("cluster").agg(F.sum(F.col("w") * F.col("chunks")).alias("sent"))
    whole = texts.groupBy("cluster").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("k")).select("cluster", "w", chunks.alias("chunks")).join(sent, "cluster")
    whole = Table(whole.select("cluster", "chunks", (F.col("w") * F.col("chunks") <= F.col("sent")).alias("whole"))).df
    together = texts.join(whole.where("whole").select("cluster", "chunks"), "cluster").select(F.lit(True).alias("whole"), F.col("cluster").alias("of"), "rid", "component", "chunks")
    single = buckets.join(whole.where("not whole").select("cluster"), "cluster", "left_semi").select("sig", "chunks")
    single = rest.select("sig", "rid", "component").join(single, "sig").select(F.lit(False).alias("whole"), F.col("sig").alias("of"), "rid", "component", "chunks")
    dealt = together.unionByName(single).withColumn("side", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")
    paired = dealt.select("whole", "of", "rid", "component", "side", other).select("whole", "of", "rid", "component", "side", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"))
    return paired.join(sets, "rid").groupBy("whole", "of", "i", "j").applyInArrow(_across(percent), "a long, b long")


def similar_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT, candidates: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rid, doc_id, component_id (the smallest doc_id of those linked by similarity),
    kept (one row of each component: the one with that id). ``candidates`` gives pairs a, b of
    the rids of rows (rid, doc_id, text), one row of each set of shingles, to verify first."""
    rows = with_row_id(settled(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))), "rid")
    found = judged(rows, shingle, percent)
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid").alias("rid")))
    classes = Table(found.where("not lone").groupBy("content").agg(F.count(F.lit(1)).alias("m"), F.min("rid").alias("node"), head.alias("first"))).df
    distinct = rows.join(classes.select(F.col("node").alias("rid")), "rid", "left_semi")
    sets = Table(_sets(distinct, shingle)).df
    linked = components(links(_postings(sets, percent), sets, percent, candidates(distinct) if candidates else None))
    placed = Table(classes.join(linked, "node", "left").select("content", "m", "first", F.coalesce("component", "node").alias("component"))).df
    count, total = placed.agg(F.count(F.lit(1)), F.sum("m")).first()
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.min("first").alias("least"))
    label = join_hot(placed.select("content", "m", "component"), sizes, "component", "k", count)
    some = join_hot(found.where("not lone").select("rid", "doc_id", "content"), label.select("content", "m", "least"), "content", "m", total or 0)
    out = some.select("rid", "doc_id", F.col("least.id").alias("component_id"), (F.col("rid") == F.col("least.rid")).alias("kept"))
    return out.unionByName(found.where("lone").select("rid", "doc_id", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one row of each component; all columns stay."""
    docs = settled(docs)
    row = unused(docs, "_row")
    gone = similar_groups(docs, text, key, **how).where("not kept").select(F.col("rid").alias(unused(docs, "_gone")))
    return with_row_id(docs, row).join(gone, F.col(row) == F.col(gone.columns[0]), "left_anti").drop(row)
