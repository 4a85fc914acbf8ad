"""Passages with the documents that have them."""

from __future__ import annotations

import collections
import random

import numpy as np
from rerunlab.llm import suffix


def test_each_passage_is_in_its_other_document(spark):
    def text(name, n):
        return [f"{name}{i}" for i in range(n)]

    a, b = text("a", 60), text("b", 60)
    texts = {1: a + text("x", 20), 2: text("y", 20) + b, 3: b + text("z", 20), 4: a + b, 5: a + text("v", 10) + b}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    rows = suffix.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in rows} == {(1, 0, 60), (2, 20, 80), (3, 0, 60), (4, 0, 120), (5, 0, 60), (5, 70, 130)}
    check(rows, texts, 50)
    (four,) = [r for r in rows if r["doc_id"] == 4]
    assert {(p["other_id"], p["start_word"], p["end_word"]) for p in four["parts"]} & {(i, 60, 120) for i in (2, 3, 5)}


def check(rows, texts, least):
    """Every part is in its other document in one piece, and the parts make up the row."""
    assert len(rows) == len({(r["doc_id"], r["start_word"]) for r in rows})
    for r in rows:
        assert r["n_words"] == r["end_word"] - r["start_word"] >= least
        assert r["other_id"] == min(p["other_id"] for p in r["parts"])
        assert {k for p in r["parts"] for k in range(p["start_word"], p["end_word"])} == set(range(r["start_word"], r["end_word"]))
        for p in r["parts"]:
            passage = " ".join(texts[r["doc_id"]][p["start_word"] : p["end_word"]])
            assert p["end_word"] - p["start_word"] >= least and p["other_id"] != r["doc_id"]
            assert f" {passage} " in f" {' '.join(texts[p['other_id']])} "


def test_rows_at_the_edges_of_ranges(spark):
    """Many ranges, some of them rows of one document alone: every word in a window of 12
    that another document has is covered, and each row is in its other documents."""
    r = random.Random(4)
    loop = "p q r s t u".split() * 40
    parts = [[f"w{i}{j}" for j in range(r.randint(6, 30))] for i in range(8)]
    texts = [loop, loop[3:], loop[:60] + ["x"] + loop[:30]]
    texts += [[w for _ in range(r.randint(1, 5)) for w in r.choice(parts)] for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    least, before, adaptive = 12, spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    owners = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for j in range(len(t) - least + 1):
            owners[tuple(t[j : j + least])].add(i)
    want = {(i, k) for i, t in enumerate(texts) for j in range(len(t) - least + 1) if len(owners[tuple(t[j : j + least])]) > 1 for k in range(j, j + least)}
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = suffix.repeated_passages(docs, least=least, gram=4).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert {(x["doc_id"], k) for x in rows for k in range(x["start_word"], x["end_word"])} == want
    check(rows, texts, least)


def test_rolled_hashes():
    h = np.random.default_rng(0).integers(0, 1 << 63, 90).astype(np.uint64)
    for width in range(1, 33):
        value = np.zeros(len(h) - width + 1, np.uint64)
        for j in range(width):
            value = value * suffix._MUL + h[j : j + len(value)]
        assert np.array_equal(suffix._rolled(h, width), value)


def test_word_hashes_tell_words_apart():
    r = random.Random(2)
    texts = ["", " ", "a", "ab ba", "x" * 3000, *(" ".join("".join(r.choices("ab\u00e9", k=r.randint(1, 9))) + r.choice(["", "\t", "\n \r"]) for _ in range(r.randint(0, 40))) for _ in range(300))]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(t) for t in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    power, inverse = suffix._powers(int(suffix._MUL), len(data)), suffix._powers(suffix._INVERSE, len(data))
    got, text = suffix.word_hashes(data, ends - [len(t) for t in raw], ends, power, inverse)
    words = [(i, w) for i, t in enumerate(raw) for w in t.split()]
    assert text.tolist() == [i for i, _ in words]
    of = {}
    for h, (_, w) in zip(got.tolist(), words, strict=True):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)
