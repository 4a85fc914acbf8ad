"""Near copies by exact similarity, against brute force."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from rerunlab.llm import near


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """The smallest id (place in ``texts``) of each component."""
    sets, root = [sets_of(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 100 * both >= 80 * either:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def planted():
    rng = random.Random(5)
    texts = [None, "", " ", "one two", "ONE two", "one two three"]
    for size in (30, 60, 100, 300):
        for edits in range(5):
            words = [f"w{rng.randrange(5000)}" for _ in range(size)]
            texts.append(" ".join(words))
            for _ in range(edits):
                words[rng.randrange(size)] = f"e{rng.randrange(5000)}"
            texts.append(" ".join(words))
    line = " ".join(f"common{i}" for i in range(12))
    texts += [f"{line} {' '.join(f'q{rng.randrange(5000)}' for _ in range(rng.choice((4, 40))))}" for _ in range(120)]
    base = [f"b{i}" for i in range(80)]
    for i in range(60):  # near copies of one text, not all of each other
        words = list(base)
        words[rng.randrange(80)] = f"x{i}"
        words[rng.randrange(80)] = f"y{i}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("small, chunk, cluster", [(8, 512, 1 << 22), (200, 512, 1 << 22), (3, 7, 1 << 22), (3, 7, 0), (3, 7, 2000)])
def test_planted_edits(spark, monkeypatch, small, chunk, cluster):
    monkeypatch.setattr(near, "CLUSTER", cluster)
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "CHUNK", chunk)
    texts = planted()
    want = brute(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).cache()
    got = {r["doc_id"]: r for r in near.similar_groups(docs).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert {i for i, r in got.items() if r["kept"]} == set(want)
    assert near.similar_groups(docs.limit(0)).collect() == []


def test_pipeline_stage_drops_edited_copies(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(60)]
    edited = list(words)
    edited[30] = "edited"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[:30] + ["other"] * 30))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near(spark, docs, "").collect()) == [1, 3]
