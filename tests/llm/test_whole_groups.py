"""Near-duplicates of short texts."""

from riskgraph.llm import minhash


def test_long_signatures_of_few_shingles():
    for n in range(40):
        for words in (3, 5, 6):
            s = minhash.strips(" ".join(f"t{n}x{i}" for i in range(words)))
            assert (minhash.signature(s, minhash.LONG) != 0).all()
    a, b = (minhash.strips(f"page not found on server {x}") for x in "ab")
    agree = (minhash.signature(a, 1 << 14) == minhash.signature(b, 1 << 14)).mean()
    assert abs(agree - 1 / 3) < 0.02


def test_large_bucket_of_short_texts(spark):
    texts = [(i, f"page not found on server s{i}") for i in range(400)] + [(400, "page not found on server s7")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == {i: i for i in range(400)} | {400: 7}
