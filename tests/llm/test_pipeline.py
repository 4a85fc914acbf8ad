"""The pipeline, stage by stage, against plain Python."""

from __future__ import annotations

import collections
import zlib

import corpus_pipeline
import numpy as np
from rerunlab.llm import pii, toxicity, vocab
from test_near import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "pii", "packing"]
    steps, current = [docs], docs
    for _, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, SF)
        steps.append(current)
    start = rows(docs)

    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    memo, ids = toxicity.Hashes(), sorted(start)
    score = model.scores([toxicity.hashed(start[i][1] or "", memo) for i in ids])
    want = {i: start[i] for i, s in zip(ids, score, strict=True) if s < 0.5}
    assert steps[1].columns == docs.columns and rows(steps[1]) == want

    best = {}
    for i, r in want.items():
        best[r[1] or ""] = max(i, best.get(r[1] or "", i))
    want = {i: want[i] for i in best.values()}
    assert steps[2].columns == docs.columns and rows(steps[2]) == want

    ids = sorted(want)
    least = brute([want[i][1] for i in ids])
    want = {ids[i]: want[ids[i]] for i in range(len(ids)) if least[i] == i}
    assert steps[3].columns == docs.columns and rows(steps[3]) == want

    got = rows(steps[4])
    assert steps[4].columns == docs.columns and set(got) == set(want)
    spans = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["found"]] for r in pii.find(steps[3]).collect()}
    for i, r in want.items():
        text, out, at = r[1] or "", "", 0
        assert {(a, b, k) for k, a, b in pii.base_spans(text)} <= set(spans[i])
        for a, b, k in sorted(spans[i]):
            if a >= at:
                out, at = out + text[at:a] + f"[{pii.KINDS[k].upper()}]", b
        out += text[at:]
        assert got[i] == (i, out if spans[i] else r[1], r[2], r[3], len(out))

    encode, pieces = vocab.word_encoder().ids, collections.Counter()
    for i, r in got.items():
        t = np.append(encode(r[1] or ""), np.uint32(1)).astype("<u4")
        for p, s in enumerate(range(0, len(t), 4096)):
            pieces[i, p, s, len(t[s : s + 4096]), zlib.crc32(t[s : s + 4096].tobytes())] += 1
    packed = steps[5].collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == pieces
    ends = collections.Counter()
    for r in packed:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096
    run = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in run) == collections.Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)
