"""Overlapping identifiers are blanked whole."""

from __future__ import annotations

from pyspark.sql import functions as F
from rerunlab.llm import exact_dedup, pii, simhash, toxicity


def test_overlapping_spans_are_united(spark):
    texts = ["mail +1234567890@x.com now", "at 10.0.0.1 4111 1111 1111 1111 end", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for i, text in enumerate(texts):
        covered = {j for _, a, b in pii.base_spans(text) for j in range(a, b)}
        rest = "".join(c for j, c in enumerate(text) if j not in covered)
        out = got[i]
        for kind in pii.KINDS:
            out = out.replace(f"[{kind.upper()}]", "")
        assert out == rest
    assert got[0] == "mail [PHONE] now"


def test_helper_columns_do_not_clash(spark):
    """Columns named as the operators' own helpers stay as they are."""
    names = ["_row", "_kept", "_gone", "_rid", "_found", "_toxicity", "_row_rid"]
    columns = ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame([(i, f"mail a{i % 3}@b.cd one two three four", *[f"{c}{i}" for c in names]) for i in range(6)], f"doc_id long, text string, {columns}").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    for got in (exact_dedup.drop_exact_copies(docs), simhash.drop_near_copies(docs), simhash.drop_similar(docs), pii.redact(docs), toxicity.drop_toxic(docs, labels)):
        rows = got.collect()
        assert got.columns == docs.columns and rows
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names)
