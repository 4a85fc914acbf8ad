"""SimHash near-duplicates through pigeonhole blocks.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 values of a
document's word shingles. Fingerprints cut into ``blocks`` blocks that differ in at
most ``radius`` bits agree on at least ``blocks - radius`` of them, so they meet in a
bucket of some choice of that many blocks. Buckets of distinct fingerprints are
joined, Hamming distances verified, and the links' components taken.

Copies share one fingerprint and are counted, never paired. A bucket with over
SMALL fingerprints is dealt into chunks; each two chunks are compared in a task of
bounded size that returns a spanning forest of its links instead of all of them.
More blocks (longer keys) are used for more fingerprints; every setting is exact.

Defined results: a null text counts as empty; no words give fingerprint zero, linked
like any other; fewer words than a shingle form one shingle. Repeated rows share a
component. A null ``doc_id`` is never a component's id unless it is the only one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near
from .common import Table, join_hot, settled, unused, with_row_id
from .graph import components

SEED, BITS = 42, 64
SMALL, CHUNK = 32, 1024
#: Radius and blocks of the fingerprints of ``drop_similar``.
WIDE_RADIUS, WIDE_BLOCKS = 6, 8


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned fingerprint of a UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(parts), 1 << 16):
        some = parts[at : at + (1 << 16)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(SEED)), np.uint64, len(some))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * total > len(parts))
    return sum(1 << int(b) for b in set_bits)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """rid, doc_id, fp (the 64 bits as a signed long) for every row."""
    rows = with_row_id(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "rid")
    return _fingerprinted(rows, shingle)


def _fingerprinted(rows: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(t or b"", shingle) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            fp = np.array(got, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["rid", "doc_id", "fp"])

    return rows.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, fp long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """A signed 64-bit mask for each choice of ``blocks - radius`` blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _first_shared(x: Column, masks: list[int]) -> Column:
    """The first choice of blocks on which two fingerprints with xor ``x`` agree."""
    return F.coalesce(*(F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)))


def _forest(radius: int):
    def run(group: pa.Table) -> pa.Table:
        fps = np.unique(group.column("fp").to_numpy()).view(np.uint64)
        left, links = np.ones(len(fps), bool), []
        for root in range(len(fps)):
            if not left[root]:
                continue
            left[root] = False
            stack = [root]
            while stack:
                at = stack.pop()
                rest = np.flatnonzero(left)
                near = rest[np.bitwise_count(fps[rest] ^ fps[at]) <= radius]
                left[near] = False
                links += [(at, int(x)) for x in near]
                stack += near.tolist()
        pair = np.array(links, np.int64).reshape(-1, 2)
        ids = fps.view(np.int64)
        return pa.table({"a": ids[pair[:, 0]], "b": ids[pair[:, 1]]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def links(distinct: DataFrame, count: int, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """Links a, b between the ``count`` distinct fingerprints of column fp: all of a
    small bucket's, a spanning forest of a large one's chunks."""
    blocks = blocks or (radius + 2 if count < 1 << 23 else radius + 3 if count < 1 << 31 else radius + 4)
    masks = block_masks(blocks, radius)
    keys = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))
    keyed = distinct.select("fp", F.explode(keys).alias("bucket"))
    sizes = Table(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = count * len(masks)
    met = Table(join_hot(keyed, sizes.df, "bucket", "n", rows))
    few = met.df.where(F.col("n") <= SMALL).select("bucket", "fp")
    other = few.select("bucket", F.col("fp").alias("fq"))
    x = F.col("fp").bitwiseXOR(F.col("fq"))
    near = few.join(other, "bucket").where((F.col("fp") < F.col("fq")) & (F.bit_count(x) <= radius) & (_first_shared(x, masks) == F.col("bucket.t")))
    small = near.select(F.col("fp").alias("a"), F.col("fq").alias("b"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = met.df.where(F.col("n") > SMALL).select("bucket", "fp", chunks.alias("chunks"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("chunk"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "fp", F.col("bucket.t").alias("t"), F.col("bucket.k").alias("k"), F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")
    )
    large = paired.groupBy("t", "k", "i", "j").applyInArrow(_forest(radius), "a long, b long")
    return small.unionByName(large)


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """rid, doc_id, fingerprint (16 hex digits), component_id (its smallest doc_id),
    kept (one row of each component: the one with that id)."""
    rows = Table(fingerprints(docs, text, key, shingle)).df
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid").alias("rid")))
    classes = Table(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))).df
    count, total = classes.agg(F.count(F.lit(1)), F.sum("n")).first()
    found = components(links(classes.select("fp"), count, radius, blocks))
    placed = classes.join(found, classes.fp == found.node, "left").select("fp", "n", "first", F.coalesce("component", "fp").alias("component"))
    placed = Table(placed).df
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.min("first").alias("least"))
    label = join_hot(placed.select("fp", "n", "component"), sizes, "component", "m", count)
    out = join_hot(rows, label.select("fp", "n", "least"), "fp", "n", total or 0)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("rid", "doc_id", digits.alias("fingerprint"), F.col("least.id").alias("component_id"), (F.col("rid") == F.col("least.rid")).alias("kept"))


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one row of each component; all columns stay."""
    docs = settled(docs)
    row = unused(docs, "_row")
    kept = near_groups(docs, text, key, **how).where("kept").select(F.col("rid").alias(unused(docs, "_kept")))
    return with_row_id(docs, row).join(kept, F.col(row) == F.col(kept.columns[0]), "left_semi").drop(row)


def candidates(rows: DataFrame, shingle: int, radius: int, blocks: int) -> DataFrame:
    """Links a, b of the rids of ``rows`` (rid, doc_id, text) whose fingerprints differ in at most
    ``radius`` bits, enough to connect them: of equal fingerprints each with the first."""
    found = Table(_fingerprinted(rows, shingle)).df
    distinct = Table(found.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("lead"))).df
    count, total = distinct.agg(F.count(F.lit(1)), F.sum("n")).first()
    same = join_hot(found.select("rid", "fp"), distinct, "fp", "n", total or 0).where(F.col("rid") > F.col("lead")).select(F.col("lead").alias("a"), F.col("rid").alias("b"))
    one, two = (distinct.select(F.col("fp").alias(x), F.col("lead").alias(f"lead_{x}")) for x in "ab")
    near = links(distinct.select("fp"), count, radius, blocks).join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    return same.unionByName(near.select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b")))


def drop_similar(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = near.SHINGLE, percent: int = near.PERCENT, radius: int = WIDE_RADIUS, blocks: int = WIDE_BLOCKS) -> DataFrame:
    """``docs`` with one row of each group of texts linked by a Jaccard similarity of
    ``percent`` or more of their shingles; all columns stay. Texts whose fingerprints differ
    in at most ``radius`` bits are candidates, and an exact check of their shingles decides. 64
    majority bits are too few for all similar texts to be within a radius that blocks allow,
    so ``near`` finds the other pairs by blocks cut from the shingle sets, checked alike."""
    return near.drop_near_copies(docs, text, key, shingle=shingle, percent=percent, candidates=lambda rows: candidates(rows, shingle, radius, blocks))
