"""The methods' own rules: scoring of pages, license markup, pseudonyms by kind, views of the classifier, recall of the index."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskgraph.llm import cotraining, html_extract, license_texts, licenses, minhash, packing, pii, pivots, quality_rules

# html

PARA = "A sentence, with commas, that is long enough to count as content. " * 4
OTHER = "Other words, for the second, of two such articles on a page. " * 4
P, Q = f"<p>{PARA}</p>", f"<p>{OTHER}</p>"
BOTH = [PARA.strip(), OTHER.strip()]


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><article>{P}</article><article>{Q}</article></body>", BOTH),
        (f"<body><div><article>{P}</article></div><div class=text>{Q}</div></body>", BOTH),
        (f"<body><div class='elementor-widget'>{P}{Q}</div></body>", BOTH),
        (f"<body><div class='content widget'>{P}{Q}</div></body>", BOTH),
        (f"<body><form>{P}{Q}<input></form></body>", BOTH),
        (f"<!-->{P}<!-- gone --!>{Q}<!--->", BOTH),
        (f"<article><div class='article-header'><h1>Title</h1></div>{P}</article>", ["Title", BOTH[0]]),
        (f"<article>{P}<p class='social'>Short.</p><div class='legal-notice-text'>Legal.</div><div class='notice'>Gone.</div><div class='post-share'>Gone.</div></article>", [BOTH[0], "Short.", "Legal."]),
        (f"<div><div class=text>{P}{Q}</div>Closing <b>sentence</b>.<p>Short end.</p><ul><li>one</li></ul></div>", [*BOTH, "Closing sentence.", "Short end.", "one"]),
        (f"<h1>Head</h1><article>{P}</article><h2>More</h2><ul><li><a href=x>link</a></li></ul>", ["Head", BOTH[0]]),
        ("<div class=ad>Buy now, or never, or later.</div><article><h1>A</h1><p>Tiny.</p></article>", ["A", "Tiny."]),
        (f"<div>{P}</div><div>{P}</div>", [BOTH[0]] * 2),  # a tie: the first is the best, the other its sibling
    ],
)
def test_pages(page, want):
    assert html_extract.main_text(page).split("\n\n") == want


# licenses


def plain(markup):
    """A text that a template accepts: no optional regions, two words for replaceable ones."""
    markup = re.sub(r"\{\{\d+\}\}", "Some Holder", markup)
    while "[[" in markup:
        markup = re.sub(r"\[\[[^\[\]]*\]\]", "", markup)
    return markup


BY = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)


def labels(text):
    return set(filter(None, licenses.scan(text, BY)[5].split(",")))


@pytest.mark.parametrize("label", sorted(license_texts.WHOLE))
def test_whole_licenses(label):
    text = plain(license_texts.WHOLE[label])
    assert labels(text) == {label}
    words = text.split()
    rng = random.Random(label)
    for _ in range(5):  # one word of the wording changed, left out or put in
        at = rng.randrange(len(words))
        if words[at] in ("Some", "Holder"):
            continue
        assert label not in labels(" ".join([*words[:at], "changed", *words[at + 1 :]]))
        assert label not in labels(" ".join([*words[:at], *words[at + 1 :]]))


def test_changed_conditions():
    mit = plain(license_texts.WHOLE["mit"])
    assert labels(mit.replace('"AS IS"', "“AS IS”")) == {"mit"}
    assert labels(mit.replace("subject to", "provided you pay the author, subject to")) == set()
    assert labels("Permission is hereby granted, free of charge, to deal in the Software without restriction, provided you pay.") == set()
    assert labels("Licensed under CC BY-NC-SA 4.0") == {"cc-by-nc", "cc-by-nc-sa"}  # the base phrase and the longer name
    assert labels("Licensed under CC BY.") == {"cc-by"}
    for label, (name, version) in license_texts.GNU_LICENSES.items():
        assert labels(license_texts.GNU.format(name=name, version=version)) == {label}


def test_nested_regions():
    a = licenses.Automaton("alpha [[beta [[gamma]] delta]] end [[of it]]")
    run = lambda s: a.match(s.split(), 0)
    assert [run(s.encode())[0] for s in ("alpha end", "alpha beta delta end", "alpha beta gamma delta end of it all", "alpha beta end")] == [2, 4, 7, -1]
    for broken in ("a [[b", "a ]] b"):
        with pytest.raises(ValueError):
            licenses.Automaton(broken)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=8))
def test_automaton_property(words):
    # against a regular expression of the same language
    a = licenses.Automaton("a [[b [[a]] b]] {{2}} b")
    text = " ".join(words)
    want = re.match(r"a( b( a)? b)?( \w){0,2} b(?= |$)", text)
    assert (a.match(text.encode().split(), 0)[0] >= 0) == bool(want)


# quality rules


def lines(n):
    return [" ".join(f"wört{i}x{k}" for k in range(9)) + "." for i in range(n)]


def test_lines_of_any_language():
    prose = lines(9)
    menu = ["Ofertas", "Noticias locales", "Deportes", "Cultura y ocio"]
    rest = ["© 2024 Firma GmbH", "https://www.example.org/a/b", "Tous droits réservés."]
    judged = quality_rules.judge("\n".join([*menu, *prose, *rest, prose[0]]), quality_rules.LineRules(), True)
    assert judged[9].split("\n") == prose and judged[6] and judged[8] == len(menu) + len(rest) + 1
    heading = "\n".join(["Eine Überschrift", *prose])
    assert quality_rules.judge(heading, quality_rules.LineRules(), True)[9] == heading
    assert quality_rules.judge("\n\n".join(prose), quality_rules.LineRules(), True)[9] == "\n".join(prose)


def test_cleaned_texts_go_on(spark):
    prose = "\n".join(lines(9))
    rows = [(1, prose + "\nAll rights reserved.", 7), (2, prose + "\n\n", None), (None, prose + "\nAll rights reserved.", 7), (3, None, 0), (3, "few", 0)]
    got = quality_rules.keep_documents(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, prose, len(prose)), (2, prose + "\n\n", None), (None, prose, len(prose))], key=str)


# classifier


def test_scores_match_the_model(spark, small):
    docs, known = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    cfg = cotraining.Settings()
    features = cotraining.featurize(docs)
    model = cotraining.fit_model(features, known, cfg)
    assert model.exchanged > 0
    got = {r["doc_id"]: r for r in cotraining.score_quality(docs, known, settings=cfg).collect()}
    rows = docs.collect()
    for r in rows:
        content = np.float32(cotraining.content_view(r["text"])).astype(float)
        meta = np.float32(cotraining.meta_view(r["lang"], r["source"], r["n_chars"])).astype(float)
        parts = []
        for view, x in ((model.content, content), (model.meta, meta)):
            raw = sum(float(a) * float(b) for a, b in zip(x, view.weights, strict=True)) + view.bias
            parts.append(min(12.0, max(-12.0, view.slope * raw + view.shift)))
        want = 1 / (1 + math.exp(-(parts[0] + parts[1] - model.prior)))
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-6)
        assert got[r["doc_id"]]["kept"] == (got[r["doc_id"]]["score"] >= cfg.keep_at)
    clash = ["content_0", "meta_0", "kept", "score", "content", "a"]  # further columns go through, whatever their names
    more = docs.select("*", *(F.lit(c).alias(c) for c in clash))
    kept = cotraining.keep_quality(more, known, settings=cfg)
    assert kept.columns == more.columns
    assert sorted(map(tuple, kept.collect())) == sorted((*r, *clash) for r in rows if got[r["doc_id"]]["kept"])


def test_the_pool_is_the_whole_table(spark):
    # confident rows are found wherever they are, at most so many of a class, none twice and none that is taken
    rows = [(i, [float(i)], [0.0]) for i in range(-50, 51)] + [(None, [99.0], [0.0])]
    features = spark.createDataFrame(rows, "doc_id bigint, content array<float>, meta array<float>").repartition(5)
    pool = cotraining.surest(features, spark.createDataFrame([(50,)], "doc_id bigint"), cotraining.Settings())
    view = cotraining.View(np.array([0.2]), 0.0)
    got = pool("content", view, {0.0: 3, 1.0: 2}, {49, -50})
    assert sorted((k, c) for k, c, _, _ in got) == [(-49, 0.0), (-48, 0.0), (-47, 0.0), (47, 1.0), (48, 1.0)]
    assert pool("content", cotraining.View(np.array([0.0]), 0.0), {0.0: 3, 1.0: 2}, set()) == []


def test_only_labels_of_documents_at_hand_count(spark):
    features = spark.createDataFrame([(i, [0.0] * cotraining.VIEWS["content"], [0.0] * cotraining.VIEWS["meta"]) for i in range(30)], "doc_id bigint, content array<float>, meta array<float>")
    labels = spark.createDataFrame([(i, i % 10 and 1) for i in range(20, 400)] + [(25, 0), (26, None)], "doc_id bigint, quality int")
    (x, y), ids = cotraining.labelled_rows(features, labels, cotraining.Settings(labelled=6, rare=1))
    assert len(y) == 7 - 1 and set(y) == {0.0, 1.0} and x["content"].shape == (6, cotraining.VIEWS["content"])
    assert all(20 <= r["doc_id"] < 30 and r["doc_id"] != 25 for r in ids.collect())


# near-duplicates


def test_bucket_of_over_a_thousand(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(40)]
    texts = []
    for k in range(1100):  # a shared half, so that all meet in some band, and an own half
        own = [f"g{k // 2}x{i}" for i in range(40)]
        texts.append(" ".join(base + own + ([f"t{k}"] if k % 2 else [])))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {k: k - k % 2 for k in range(1100)}


# vectors


def brute(x, threshold=0.9):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    return hit


@pytest.mark.parametrize("dim", [64, 384, 768])
def test_recall_just_above_the_threshold(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(400, dim))
    base /= np.linalg.norm(base, axis=1)[:, None]
    off = rng.normal(size=(400, dim))
    off -= (off * base).sum(axis=1)[:, None] * base
    off /= np.linalg.norm(off, axis=1)[:, None]
    cos = rng.uniform(0.9005, 0.92, size=(400, 1))
    x = np.vstack([base, cos * base + np.sqrt(1 - cos**2) * off])
    hit = brute(x)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in pivots.near_vectors(rows).collect()}
    assert all(got[i] <= hit[i].sum() for i in got)
    assert sum(got.values()) >= 0.93 * hit.sum() >= 0.93 * 800


@pytest.mark.parametrize("n", [10_000, 400_000, 1_000_000])
def test_recall_with_more_pivots(n):
    # the rule of the lists alone, for the pivots that so many vectors would have
    rng = np.random.default_rng(4)
    count, dim = pivots.pivot_count(n), 96
    x = rng.normal(size=(300, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    off = rng.normal(size=(300, dim))
    off -= (off * x).sum(axis=1)[:, None] * x
    y = 0.905 * x + math.sqrt(1 - 0.905**2) * off / np.linalg.norm(off, axis=1)[:, None]
    lists = [pivots._random(dim, count, 0)]
    a, b = (pivots.nearest_pivots(v, lists, pivots.nearest_count(count)) for v in (x, y))
    shared = (a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1)
    assert (shared >= pivots.SHARED).mean() >= 0.92
    assert (np.unpackbits(pivots.sketch(x) ^ pivots.sketch(y), axis=1).sum(axis=1) <= pivots.sign_limit(0.9)).all()


def test_vectors_of_any_size_and_repeated_ids(spark):
    rows = [(1, [3e300, 4e300]), (2, [3e-300, 4e-300]), (3, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])]
    got = pivots.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (3, 2, 3), (4, 2, 3), (4, 2, 3)]


# packing


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", "'s", " ", "  ", "\n", "\t", "don't", "12", "½", "ß", "é", "é", "‍", "\x00", "\x85", "　", "a" * 40, "'LL", "中文", "🎉"]), max_size=10).map("".join))
def test_pieces_are_the_library_ids(text):
    b = packing.load(packing.default_vocabulary())
    text = text.encode("utf-8", "ignore").decode()
    assert b.encode(text) == b.whole(text)


# pseudonyms


def pseudonyms(spark, texts, key="key"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["text"] for r in pii.pseudonymize(docs, key).orderBy("doc_id").collect()]


def digits(s):
    return re.sub(r"\D", "", s)


def test_spellings_are_linked(spark):
    phones = ["+14565552186", "+1 456 555 2186", "+1 (456) 555-2186", "456-555-2186", "(456) 555-2186", "tel: 4565552186"]
    assert len({digits(x)[-10:] for x in pseudonyms(spark, phones)}) == 1
    french = ["06 12 34 56 78", "0612345678", "+33 6 12 34 56 78", "+33612345678", "+33 (0)6 12 34 56 78"]
    out = pseudonyms(spark, french)
    assert len({digits(x)[-9:] for x in out}) == 1 and digits(out[0])[-9:] != "612345678" and out[0].startswith("06")
    ibans = pseudonyms(spark, ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00 EUR"])
    assert len({x.replace(" ", "")[:22] for x in ibans}) == 1 and ibans[2].endswith(" EUR") and ibans[0] != "DE89370400440532013000"
    six = pseudonyms(spark, ["2001:db8::ff00:42:8329", "2001:0DB8:0000:0000:0000:ff00:0042:8329"])
    assert six[0] == six[1] and re.fullmatch(r"([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}", six[0]) and "2001:db8" not in six[0]


def test_candidates_that_are_no_data_stay(spark):
    stay = ["666-12-3456 000-12-3456 900-12-3456 123-00-4567 123-45-0000", "::1 std::abc a::b ::", "4565552186 1700000000", "0000-01-01 2023-02-30", "DE00370400440532013000", "10:30:15"]
    assert pseudonyms(spark, stay) == stay


def test_every_kind_is_a_permutation_of_valid_values(spark):
    rng = random.Random(1)
    ssn = sorted({f"{rng.choice([*range(1, 666), *range(667, 900)]):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10000):04}" for _ in range(3000)})
    out = pseudonyms(spark, ssn)
    assert len(set(out)) == len(ssn)
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in out)
    phones = [f"({rng.randrange(200, 1000)}) {rng.randrange(200, 1000)}-{rng.randrange(10000):04}" for _ in range(1500)]
    phones = sorted(set(phones + [f"({rng.randrange(1000):03}) {rng.randrange(1000):03}-{rng.randrange(10000):04}" for _ in range(1500)]))
    out = pseudonyms(spark, phones)
    assert len(set(out)) == len(phones)
    plan = re.compile(r"\([2-9]\d\d\) [2-9]\d\d-\d{4}")
    assert [bool(plan.fullmatch(x)) for x in out] == [bool(plan.fullmatch(x)) for x in phones]
    days = [dt.date(1, 1, 1) + dt.timedelta(days=rng.randrange(3652059)) for _ in range(2000)] + [dt.date(1899, 12, 31), dt.date(1900, 1, 1), dt.date(2099, 12, 31), dt.date(2100, 1, 1), dt.date(9999, 12, 31)]
    days = sorted(set(days))
    out = [dt.date.fromisoformat(x) for x in pseudonyms(spark, [d.isoformat() for d in days])]
    assert len(set(out)) == len(days)
    for old, new in zip(days, out, strict=True):
        assert (old.year < 1900, old.year > 2099) == (new.year < 1900, new.year > 2099)
    six = sorted({":".join(f"{rng.randrange(1, 65536):x}" for _ in range(8)) for _ in range(1000)})
    assert len(set(pseudonyms(spark, six))) == len(six)
    mails = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 3, 24, 25, 60]))) + "@a.b.c.d.e.f.g.h.i.j.k.l.org" for _ in range(800)})
    out = pseudonyms(spark, mails)
    assert len(set(out)) == len(mails) and all(len(a) == len(b) and b.endswith("@a.b.c.d.e.f.g.h.i.j.k.l.org") for a, b in zip(mails, out, strict=True))


def test_the_key_is_not_in_the_plan(spark):
    secret = "very-secret-key-4711"
    df = pii.pseudonymize(spark.createDataFrame([(1, "a@b.org 123-45-6789")], "doc_id bigint, text string"), secret)
    df.collect()
    assert secret not in df._jdf.queryExecution().toString() and secret not in df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
