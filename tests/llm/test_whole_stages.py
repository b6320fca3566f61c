"""Rows of the dedup stage with null and repeated ids."""

import random

import pytest


def test_dedup_stage_decides_per_row(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(9999)}" for _ in range(40)) for _ in range(5))
    rows = [
        (None, a), (None, b), (None, b), (1, a), (2, c), (2, c), (2, c), (5, a), (5, d), (6, e), (4, e),
        (7, ""), (7, ""), (8, None), (9, a + " more"),
    ]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r["doc_id"], r["text"]) for r in pipeline.minhash_dedup_stage(spark, docs.repartition(4), small).collect()]
    want = [(None, a), (None, b), (None, b), (1, a), (2, c), (5, d), (4, e), (7, ""), (8, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
