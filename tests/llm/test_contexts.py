"""Learned identifiers against plain Python, and texts that are dear to search."""

from __future__ import annotations

import random
import time

from rerunlab.llm import pii


def brute_contexts(seen, support, confidence, rounds):
    """Trusted (kind, words) of ``seen``: (kind, seed, value, contexts)."""
    edges, seed = set(), {}
    for kind, s, value, contexts in seen:
        for w in contexts:
            edges.add(((kind, w), (kind, value)))
        if contexts:
            seed[kind, value] = seed.get((kind, value), False) or s
    good, sure = {i: float(s) for i, s in seed.items()}, dict(seed)
    for _ in range(rounds):
        of = {}
        for c, i in edges:
            of.setdefault(c, []).append(i)
        reliable = {c: sum(good[i] for i in x) / len(x) for c, x in of.items()}
        seeds = {c: sum(sure[i] for i in x) for c, x in of.items()}
        trusted = {c for c in of if seeds[c] >= support and reliable[c] >= confidence}
        for i in seed:
            if not seed[i]:
                known = [c for c, x in edges if x == i and seeds[c] >= support]
                good[i] = sum(reliable[c] * seeds[c] for c in known) / sum(seeds[c] for c in known) if known else 0.0
                sure[i] = any(c in trusted for c in known) and good[i] >= confidence
    return trusted


def corpus():
    r = random.Random(3)
    texts = [f"please contact u{i}@mail{r.randrange(9)}.org soon" for i in range(40)]
    texts += [f"please contact m{i}@localhost soon then kindly reach m{i}@localhost today" for i in range(9)]
    texts += ["kindly reach z@intranet today", "see x@nowhere instead"]
    texts += [f"call +49 30 123{i:04d} now" for i in range(12)] + ["call 030 7654321 now", "order 030 7654321 units"]
    return texts


def test_accepted_identifiers_seed_the_next_round(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x for x in pii.find(docs).collect()}
    seen = [(k, s, v, c) for t in texts for k, s, _, _, v, c in pii.occurrences(t, pii.base_spans(t))]
    for rounds in (1, 2, 3):
        want = brute_contexts(seen, pii.SUPPORT, pii.CONFIDENCE, rounds)
        rows = spark.createDataFrame(seen, "kind int, seed boolean, value string, contexts array<string>")
        found = {(x["context"]["kind"], x["context"]["words"]) for x in pii.reliable_contexts(rows, rounds=rounds).collect()}
        assert found == want, rounds
        assert ((0, "reach _") in want) == (rounds == 3)
    trusted = brute_contexts(seen, pii.SUPPORT, pii.CONFIDENCE, pii.ROUNDS)
    for i, t in enumerate(texts):
        base = pii.base_spans(t)
        learned = {(k, a, b) for k, s, a, b, _, c in pii.occurrences(t, base) if not s and any((k, w) in trusted for w in c)}
        assert {(f["kind"], f["start"], f["end"]) for f in got[i]["found"]} == set(base) | learned
    assert got[49]["spans"] == "email:13:23" and got[50]["spans"] == ""
    assert "phone:5:16" in got[63]["spans"] and got[64]["spans"] == ""


def test_spans_of_one_place_keep_the_better():
    assert pii.apart([(0.8, 0, 2, 14), (0.9, 4, 3, 14), (0.7, 14, 3, 20), (0.9, 30, 3, 31), (0.9, 30, 1, 31)]) == [(3, 4, 14), (3, 14, 20), (1, 30, 31)]


def test_whole_words_beside():
    long = "x" * 300
    (kind, seed, a, b, value, contexts), *_ = pii.occurrences(f"one {long} 442079460958 end", [])
    assert value == "442079460958" and f"{long} _" in contexts and f"one {long} _" in contexts


def test_ip_runs_equal_the_pattern():
    r = random.Random(7)
    for _ in range(20_000):
        t = "".join(r.choices("0123.. ", k=r.randint(0, 25)))
        assert [m.span() for m in pii.IP_RUNS.finditer(t)] == [m.span() for m in pii.IP.finditer(t)], t


def test_long_texts_take_linear_time():
    start = time.time()
    for t in ("1234567 " * 60_000, "1" * 400_000, "@" * 100_000 + "a" * 100_000, "1.1." * 80_000, "a1234567," * 40_000, "+1 (" * 80_000):
        base = pii.base_spans(t)
        assert len(pii.occurrences(t, base)) >= len(base)
    assert time.time() - start < 60
