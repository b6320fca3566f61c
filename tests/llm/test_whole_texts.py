"""Text operators on the parts that a narrower search would leave out."""

from riskgraph.llm import secrets

KEY = "aB3" + "xYz7Q" * 8


def linked(text):
    low = text.lower()
    return [(k, text[s:e]) for k, s, e in secrets.linked_spans(text, low, secrets.base_spans(text, low), secrets.LinkRules())]


def test_weak_secret_beside_an_endpoint(spark):
    url = "https://api.example.com/v1"
    text = f"{url}\n{KEY}\n"
    assert linked(text) == [("secret", KEY), ("endpoint", url)]
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id bigint, text string, n_chars bigint")
    assert secrets.mask_documents(docs).first()["text"] == f"{url}\n[SECRET]\n"


def test_another_scope_decides_nothing():
    # parts of another scope decide nothing
    assert linked(f"user: bob99\n\n{KEY}") == []
    assert linked(f"user: bob99\n\n{KEY}\nhttps://a.example.com/x") == [("secret", KEY), ("endpoint", "https://a.example.com/x")]
    assert linked(f"{KEY}\n\nhttps://a.example.com/x\nuser: bob99") == []
    # a long path is no secret beside its own endpoint
    assert linked("https://a.example.com/Some/Path2/WithMoreThanThirtyTwoCharacters/In/It") == []
