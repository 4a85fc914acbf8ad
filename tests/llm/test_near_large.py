"""Large families of near copies: what is compared, and how often."""

from __future__ import annotations

import random
import time

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from rerunlab.llm import near, simhash


def family(count, edits):
    rng, memo = random.Random(3), near.Words()
    base, words = [f"b{i}" for i in range(400)], [f"w{i}" for i in range(300)]
    out = []
    for _ in range(count):
        text = list(base)
        for _ in range(rng.randrange(1, edits)):
            text[rng.randrange(400)] = rng.choice(words)
        out.append(near.shingles(" ".join(text).encode(), memo))
    return out


def linked(sets, side):
    n = len(sets)
    group = pa.table({"rid": pa.array(range(n), pa.int64()), "component": pa.array(range(n), pa.int64()), "side": pa.array(side, pa.int32()), "items": pa.array([s.tobytes() for s in sets], pa.binary())})
    found = near._across(near.PERCENT)(group)
    return list(zip(found.column("a").to_pylist(), found.column("b").to_pylist(), strict=True))


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_links_of_a_task_are_exact(monkeypatch):
    monkeypatch.setattr(near, "HELD", 3000)  # several blocks
    sets = [*family(120, 16), near.shingles(b"one two", near.Words()), near.shingles(b"", near.Words())]
    for side in ([0] * len(sets), [i % 2 for i in range(len(sets))]):
        close = [(i, j) for i in range(len(sets)) for j in range(i) if (side[i] != side[j] or not any(side)) and len(sets[i]) and near.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), near.PERCENT)]
        links = linked(sets, side)
        assert all((max(x), min(x)) in close for x in links)
        assert roots(len(sets), links) == roots(len(sets), close)
        assert len(set(roots(len(sets), close))) > 10


def test_a_large_family_ends():
    """Pairs in a loop took over a minute."""
    sets, began = family(2600, 16), time.process_time()
    assert linked(sets, [0] * len(sets))
    assert time.process_time() - began < 30


def test_texts_of_many_buckets_are_sent_once(spark, monkeypatch):
    """40 texts that share 30 blocks, past the bound of a task: two chunks, not 30 times two."""

    def counted(percent):
        def run(group):
            return pa.table({"a": pa.array([group.num_rows], pa.int64()), "b": pa.array([0], pa.int64())})

        return run

    for name, value in (("_across", counted), ("CLUSTER", 0), ("CHUNK", 20)):
        monkeypatch.setattr(near, name, value)
    rest = spark.range(40).crossJoin(spark.range(30).withColumnRenamed("id", "sig")).select("sig", F.col("id").alias("rid"), F.lit(100).alias("n"), F.lit(40).cast("long").alias("m"), F.col("id").alias("component"), F.lit(0).cast("long").alias("hub"))
    sets = spark.range(40).select(F.col("id").alias("rid"), F.lit(b"").alias("items"))
    assert near._apart(rest, sets, near.PERCENT).agg(F.sum("a")).first()[0] == 80


def test_fingerprints_propose_links(spark):
    """The stage's fingerprints: five words, links within the radius, whatever the blocks find."""
    rng = random.Random(4)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 300)))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "edited"
            texts.append(" ".join(words))
    texts += [texts[0].upper(), texts[0], "", ""]
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    radius = simhash.WIDE_RADIUS
    close = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").withColumn("doc_id", F.col("rid"))
    got = [(r["a"], r["b"]) for r in simhash.candidates(rows, 5, radius, simhash.WIDE_BLOCKS).collect()]
    assert all(a < b and (b, a) in close for a, b in got)
    assert roots(len(texts), got) == roots(len(texts), close)


def test_the_stage_goes_through_fingerprints(spark, monkeypatch):
    asked = []

    def candidates(rows, shingle, *how, real=simhash.candidates):
        asked.append(shingle)
        return real(rows, shingle, *how)

    monkeypatch.setattr(simhash, "candidates", candidates)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:30], "edited", *words[31:]])), (3, "else")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near(spark, docs, "").collect()) == [1, 3]
    assert asked == [5]
