"""Every labelled row is learned from, in shards whose changes are averaged."""

from __future__ import annotations

import random
import time
import zlib

import numpy as np
from pyspark.sql import functions as F
from rerunlab.llm import toxicity


def learned(i):
    return zlib.crc32(str(i).encode()) % 5 != 0


def corpus(spark, count):
    rng, texts = random.Random(6), []
    for i in range(count):
        words = [f"word{chr(97 + rng.randrange(20))}" for _ in range(rng.randrange(8, 30))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["vile", "foul"])
        texts.append((i, " ".join(words), "en" if i % 2 else None))
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    return docs, docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))


def test_all_labelled_rows_are_learned_from(spark):
    docs, labels = corpus(spark, 9000)
    rows = toxicity.training_rows(docs.unionByName(docs.limit(50)), labels)
    assert rows.count() == sum(map(learned, range(9000)))
    assert rows.where("held").count() > 1000


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_WORDS", 5000)
    docs, labels = corpus(spark, 1200)
    model = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(7), labels.repartition(3))
    assert all(np.array_equal(x, vars(again)[n]) for n, x in vars(model).items())
    got = toxicity.with_score(docs, model).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got if not learned(r["doc_id"])]) > 0.9


def test_texts_are_not_shuffled(spark, monkeypatch):
    docs, labels = corpus(spark, 2000)
    labels = labels.where("doc_id % 3 = 0")
    want = sorted(i for i in range(0, 2000, 3) if learned(i))
    for marks in (toxicity.MARKS, 1 << 15):  # in the second, marks of other ids are met as well
        monkeypatch.setattr(toxicity, "MARKS", marks)
        rows = toxicity.training_rows(docs, labels)
        assert rows.count() == len(want)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.index("MapInArrow")  # words are coded below the join


def test_files_of_a_round_go(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_WORDS", 5000)
    docs, labels = corpus(spark, 1200)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    run, left = toxicity._round, []

    def shuffled():
        return disk.getAllFiles().mkString("\n").count("/shuffle_")

    def watched(*args):
        found, end = run(*args), time.time() + 5
        while left and shuffled() > left[0] and time.time() < end:  # the cleaner takes its time
            time.sleep(0.2)
        left.append(shuffled())
        return found

    monkeypatch.setattr(toxicity, "_round", watched)
    toxicity.train(docs, labels)
    assert len(left) == toxicity.ROUNDS and left[-1] <= left[0]  # Spark holds those of the last step


def test_changes_are_averaged_by_weight():
    import pyarrow as pa

    rows = [("table 0", 1, [0, 2], [1.0, 3.0], [[1.0, 1.0], [2.0, 0.0]]), ("table 0", 0, [2], [1.0], [[6.0, 4.0]])]
    columns = zip(*((k, s, np.array(i, np.int32).tobytes(), np.array(w).tobytes(), np.array(v, np.float32).tobytes()) for k, s, i, w, v in rows), strict=True)
    out = toxicity._averaged(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, toxicity._CHANGES.types, strict=True)], schema=toxicity._CHANGES)).to_pylist()[0]
    assert np.frombuffer(out["ids"], np.int32).tolist() == [0, 2]
    assert np.frombuffer(out["value"], np.float32).tolist() == [1.0, 1.0, 3.0, 1.0]


def test_threshold():
    assert toxicity._threshold(np.array([-1.0, 0.0, 1.0]), np.array([20, 2, 0]), np.array([0, 3, 20])) in (-0.5, 0.5)
    assert toxicity._threshold(np.array([-1.0, 0.0, 1.0, 2.0]), np.array([20, 1, 0, 0]), np.array([0, 5, 9, 9])) == -0.5
    assert toxicity._threshold(np.array([0.0]), np.array([30]), np.array([11])) is None
