"""Joins of like texts and vectors against brute force, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgraph.llm import minhash, pivots


def closed(ids, links):
    """Smallest id reachable."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_texts(texts, threshold=0.8):
    sets = {i: set(minhash.strips(t).tolist()) for i, t in texts.items()}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])
    ]
    return closed(ids, links)


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = {}
    for g in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 30, 200]))]
        for c in range(rng.choice([1, 2, 30])):
            texts[len(texts)] = " ".join(edited(rng, words, rng.choice([0, 0.005, 0.02, 0.05])))
    texts[len(texts)], texts[len(texts) + 1], texts[len(texts) + 2] = "", None, "same same same same same same same"
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    want = brute_texts(texts)
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(kept == (i == c) for i, (c, kept) in got.items())


def test_near_duplicates_of_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_texts({r["doc_id"]: r["text"] for r in docs.collect()})


def test_darts_estimate_the_weighted_similarity():
    rng = random.Random(1)
    words = [f"w{rng.randrange(30)}" for _ in range(400)]
    a, b = minhash.strips(" ".join(words)), minhash.strips(" ".join(words[60:] + [f"x{i}" for i in range(60)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    agree = (minhash.signature(a, 4096) == minhash.signature(b, 4096)).mean()
    assert abs(agree - true) < 0.04
    for n in (1, 2, 7, 40000):
        assert len(minhash.signature(minhash.strips(" ".join(f"t{i}" for i in range(n))), 160)) == 160
    assert len(minhash.strips("a b c d e a b c d e a b c d e")) == 11  # repeated shingles count


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, k1 string, vector string, rep string")


def run(spark, data):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "clash", "clash", "clash") for i, v in data]
    return {r["vec_id"]: r for r in pivots.near_vectors(vectors(spark, rows)).collect()}


def brute_vectors(data, threshold=0.9):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in data]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    links = [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(hit)) if a < b]
    return dict(zip([i for i, _ in good], hit.sum(axis=1).tolist())), closed([i for i, _ in good], links)


def test_vectors_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(pivots, "BLOCK", 16)
    data = []
    for size in (1, 1, 2, 5, 60):
        center = rng.normal(size=32)
        for _ in range(size):
            data.append((len(data), center + rng.normal(size=32) * 0.12))
    data += [(len(data) + k, data[-1][1]) for k in range(20)]  # exact copies
    got, (links, comp) = run(spark, data), brute_vectors(data)
    assert sum(got[i]["n_links"] for i in got) >= 0.97 * sum(links.values())
    assert all(got[i]["n_links"] <= links[i] for i in got)
    assert {i: r["component_id"] for i, r in got.items()} == comp
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_vectors_recall(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 64))
    noise = rng.normal(size=(400, 64)) * 0.35  # cosines around 0.94
    data = list(enumerate(np.vstack([base, base + noise])))
    links, _ = brute_vectors(data)
    found = sum(r["n_links"] for r in run(spark, data).values())
    assert sum(links.values()) > 500 and found >= 0.9 * sum(links.values())


def test_unsound_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    got = run(spark, data)
    assert {i for i, r in got.items() if r["n_links"]} == {7, 8}
    assert got[8]["component_id"] == 7 and not got[8]["kept"] and got[3]["component_id"] == 3 and got[None]["component_id"] is None
    assert run(spark, data[:3])[1]["n_links"] == 0
    assert pivots.near_vectors(vectors(spark, [])).count() == 0


def test_pipeline_against_operators(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    from riskgraph.llm import cotraining, packing, quality_rules, secrets

    docs = spark.read.parquet(f"{small}/documents.parquet")
    known = spark.read.parquet(f"{small}/labels.parquet")
    judged = quality_rules.quality_rules(docs).where("kept").select("doc_id", "clean_text", "n_lines_removed")
    cut = F.col("n_lines_removed") > 0
    a = docs.join(judged, "doc_id").select(
        "doc_id", F.when(cut, F.col("clean_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(cut, F.length("clean_text")).otherwise(F.col("n_chars")).cast("bigint").alias("n_chars"),
    )
    b = a.join(cotraining.score_quality(a, known).where("kept"), "doc_id", "left_semi")
    alone = {i for i, c in brute_texts({r["doc_id"]: r["text"] for r in b.collect()}).items() if i == c}
    c = b.where(F.col("doc_id").isin(*alone))
    want = packing.pack_documents(secrets.mask_documents(c))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = pipeline.run(spark, small)
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_stages_keep_columns(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, None, None, None, None, "x"), (2, "", None, None, None, "x"), (2, "", None, None, None, "x")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, odd, small).columns == pipeline.COLUMNS
        assert stage(spark, odd.limit(0), small).count() == 0
    assert pipeline.STAGES[-1][1](spark, odd, small).count() == 3
