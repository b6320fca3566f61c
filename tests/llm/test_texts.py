"""Row-wise operators: brute force on fixtures and on the smallest table, and the defined cases."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskgraph.llm import bpe, cotraining, html_extract, licenses, minhash, packing, pii, queries, quality_rules, secrets

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, kept string, k1 string, page string, part int, size string, found string"
LONG = "word " * 30000 + "x" * 50000


def docs(spark, texts, repeat=True):
    rows = [(i, t, None, None, None, 1, "clash", "clash", "clash", 7, "clash", "clash") for i, t in enumerate(texts)]
    if repeat and rows:
        rows.append(rows[0])
        rows.append((None, None) + rows[0][2:])
    return spark.createDataFrame(rows, DOCS)


ODD = ["", None, " ", "one", "a b c d e", LONG, "tab\tand\nlines\n\n", "é ß 中文 ͸ 🎉", "password = hunter22", "MIT License"]


def labels(spark):
    return spark.createDataFrame([(3, 1), (4, None), (5, 0), (None, 1)], "doc_id bigint, quality int")


OPERATORS = {
    "op2": lambda d: secrets.find_secrets(d),
    "op3": lambda d: cotraining.score_quality(d, labels(d.sparkSession)),
    "op4": lambda d: licenses.scan_licenses(d),
    "op5": lambda d: minhash.near_duplicates(d),
    "op6": lambda d: quality_rules.quality_rules(d),
    "op8": lambda d: bpe.encode_documents(d),
    "op9": lambda d: pii.pseudonymize(d, "k"),
    "op10": lambda d: packing.pack_documents(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_defined_cases(spark, name):
    d = docs(spark, ODD)
    out = OPERATORS[name](d).collect()
    ids = [r["doc_id"] for r in out]
    assert set(ids) == {None, *range(len(ODD))}
    if name == "op5":
        assert ids.count(0) == 1  # a repeated doc_id is one document
    elif name != "op10":
        assert len(out) == d.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](docs(spark, [], repeat=False)).collect() == []


def table_texts(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()


# secrets


def naive_secrets(text):
    text = text or ""
    out = [("assign", m) for m in re.finditer(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text) if len(m[2]) >= 6]
    out += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in sorted(out, key=lambda x: (x[1].start(), order[x[0]])))


def test_secrets_base_matches_brute_force(spark, small):
    got = {r["doc_id"]: r for r in queries.op2_secret_scan(spark, small).collect()}
    for i, text in table_texts(spark, small):
        want = naive_secrets(text)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert got[i]["n_assign"] == want.count("assign:") and got[i]["n_hex"] == want.count("hex:")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "=", ":", " ", "abc", "secret", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef" * 2, "\n", "KEY", "api_key", "ſ", "'"]), max_size=14))
def test_secrets_base_property(parts):
    text = "".join(parts)
    base = secrets.base_spans(text, text.lower())
    assert secrets._text(base) == naive_secrets(text)


def test_weak_parts_need_a_complement():
    def kinds(text):
        return {s.split(":")[0] for s in secrets.scan(text, secrets.LinkRules(), False)[4].split(",") if s}

    weak = "aB3" * 12
    assert kinds("user: alice") == set() and kinds(weak) == set() and kinds("see https://db.example.org/x") == set()
    assert kinds(f"user: alice\nkey {weak}") == {"id", "secret"}
    assert kinds(f"user: alice\n\nkey {weak}") == set()  # another scope
    assert kinds(f"user: alice{' ' * 300}{weak}") == set()  # out of reach
    assert kinds("password = hunter22 at https://db.example.org/x") == {"assign", "endpoint"}


def test_masking(spark):
    d = docs(spark, ["a password = hunter22 b", None, "clean"], repeat=False)
    out = {r["doc_id"]: r for r in secrets.mask_documents(d).collect()}
    assert out[0]["text"] == "a [SECRET] b" and out[0]["n_chars"] == 12
    assert out[1]["text"] is None and out[2]["text"] == "clean" and out[2]["n_chars"] is None and out[0]["kept"] == "clash"


# licenses


def test_license_base_matches_brute_force(spark, small):
    got = {r["doc_id"]: r for r in queries.op4_license_scan(spark, small).collect()}
    for i, text in table_texts(spark, small):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for k in range(len(words)) for p, label in licenses.PHRASES.items() if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert r["n_words"] == len(words) and r["n_base"] == len(places)
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_template_regions():
    a = licenses.Automaton("alpha [[beta gamma]] {{2}} delta")
    run = lambda s: a.run(s.encode().split(), 0)
    assert run("alpha delta")[0] and run("alpha beta gamma delta")[0] and run("alpha x y delta")[0]
    assert not run("alpha x y z delta")[0] and run("alpha x") == (False, 1) and not run("alpha")[0]
    by = licenses.Scanner({}, licenses.TEMPLATES)
    scan = lambda t: licenses.scan(t, by)
    assert scan("This work is licensed under the GNU General Public License, version 3.")[5] == "gpl-3"
    assert scan("licensed under the GNU Public License, version 3")[5] == ""
    own = licenses.Scanner({"do as you wish": "free"}, {"open": ("open [[and free]] for {{2}} use",)})
    got = licenses.scan("Do as you wish: open for all your use, do as you wish.", own)
    assert got == (13, 2, 0, 9, "free", "free,open", 1.0)
    assert licenses.scan("open and free for", own)[6] == 2 / 3  # the share of mandatory words read


# quality rules


def test_quality_base_matches_brute_force(spark, small):
    got = {r["doc_id"]: r for r in queries.op6_quality_rules(spark, small).collect()}
    for i, text in table_texts(spark, small):
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        windows = {}
        for k in range(len(words) - 2):
            windows.setdefault(tuple(words[k : k + 3]), []).append(k)
        repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated),
        )
        assert r["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_line_rules():
    good = "The quick brown fox jumps over the lazy dog and runs away.\n"
    judge = lambda t: quality_rules.judge(t, quality_rules.LineRules(), True)
    text = "".join(good.replace("quick", f"quick{i}").replace("lazy", f"lazy{i}").replace("jumps", f"j{i}").replace("and", f"a{i}") for i in range(8))
    assert judge(text)[6] and judge(text)[9].count("\n") == 7
    assert "Home" not in judge(text + "Home | About | Contact\nAll rights reserved.")[9]
    bad = "\n".join(f"w{i}%%% x{i}### y{i}&&& z{i}***" for i in range(40))
    assert not judge(bad)[6] and not judge(bad)[5]


# bpe


def test_bpe_matches_the_library(spark, small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_vocabulary())
    got = {r["doc_id"]: r for r in queries.op8_bpe(spark, small).collect()}
    for i, text in table_texts(spark, small):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40) | st.lists(st.sampled_from(["<|endoftext|>", "ΑΣ", "'s", " ", "don't", "12", "ß", "İ", "é", "\x1c", "a" * 70]), max_size=8).map("".join))
def test_bpe_property(text):
    if not hasattr(test_bpe_property, "tok"):
        from tokenizers import Tokenizer

        test_bpe_property.tok = Tokenizer.from_file(bpe.default_vocabulary())
    b = bpe.load(bpe.default_vocabulary())
    ids, tokens = b.encode(text)
    want = test_bpe_property.tok.encode(text, add_special_tokens=False).ids
    assert ids == " ".join(map(str, want)) and tokens == b.decode(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=20), st.integers(0, 1000))
def test_segment_tree_merges(symbols, seed):
    rng, base = random.Random(seed), 50
    pairs = [(a, b) for a in range(6) for b in range(6)]
    rng.shuffle(pairs)
    ranks = {a * base + b: (r, rng.randrange(4, 8)) for r, (a, b) in enumerate(pairs[:12])}
    want = list(symbols)
    while True:
        open_ = [(ranks[a * base + b][0], i) for i, (a, b) in enumerate(zip(want, want[1:])) if a * base + b in ranks]
        if not open_:
            break
        i = min(open_)[1]
        want[i : i + 2] = [ranks[want[i] * base + want[i + 1]][1]]
    assert bpe.merge(symbols, ranks, base) == want


# packing


def check_packing(spark, rows, texts, width=1024):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in texts:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and 0 < r["length"] <= width
            part = b"".join(x.to_bytes(4, "little") for x in ids[at : at + r["length"]])
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= width
    return sum(r["length"] for r in rows) / (width * len(by_seq))


def test_packing_the_table(spark, small):
    full = check_packing(spark, queries.op10_packing(spark, small).collect(), table_texts(spark, small))
    assert full > 0.97


def least_bins(h, width):
    """A lower bound: pieces over half need a bin each, small ones at least the room that is left."""
    best = 0
    for a in range(width // 2 + 1):
        over = sum(v for k, v in h.items() if k > width - a)
        half = [(k, v) for k, v in h.items() if width // 2 < k <= width - a]
        room = sum((width - k) * v for k, v in half)
        small = sum(k * v for k, v in h.items() if a <= k <= width // 2)
        best = max(best, over + sum(v for _, v in half) + max(0, -(-(small - room) // width)))
    return best


def test_program_comes_close_to_the_bound():
    rng = random.Random(3)
    h = {k: rng.randrange(50, 500) for k in range(1, 65)}
    plan = packing.solve(h, 64)
    used = {}
    for times, sizes in plan.patterns:
        assert sum(sizes) <= 64
        for x in sizes:
            used[x] = used.get(x, 0) + times
    assert used == h
    assert sum(t for t, _ in plan.patterns) <= 1.005 * least_bins(h, 64)
    assert packing.solve({}, 64).patterns == [] and packing.solve({64: 3}, 64).patterns == [(3, [64])]


# pseudonyms


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms_keep_formats(spark):
    text = "a.Bc9@x.org +1 (456) 555-2186 55.63.178.142 4111-1111-1111-1111 2024-02-29 31/12/1999 123-45-6789 DE89370400440532013000"
    keep = " id 1234567890123456 999.1.1.1 2023-02-30 plain 42"
    d = docs(spark, [text + keep, "again: 55.63.178.142, 4111-1111-1111-1111"], repeat=False)
    a, b = pii.pseudonymize(d, "key").orderBy("doc_id").collect()
    assert a["text"].endswith(keep)
    mail, country, area, phone, ip, card, iso, date, ssn, iban = a["text"][: -len(keep)].split(" ")
    assert re.fullmatch(r"[a-z]\.[A-Z][a-z]\d@x\.org", mail) and mail != "a.Bc9@x.org"
    assert country == "+1" and re.fullmatch(r"\([2-9]\d\d\)", area) and re.fullmatch(r"[2-9]\d\d-\d{4}", phone)
    assert all(0 <= int(o) <= 255 for o in ip.split(".")) and ip != "55.63.178.142"
    assert luhn(card.replace("-", "")) and re.fullmatch(r"4\d{3}(-\d{4}){3}", card) and card != "4111-1111-1111-1111"
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", iso) and re.fullmatch(r"\d\d/\d\d/\d{4}", date) and re.fullmatch(r"\d{3}-\d\d-\d{4}", ssn)
    number = "".join(str(int(c, 36)) for c in iban[4:] + iban[:4])
    assert int(number) % 97 == 1 and iban != "DE89370400440532013000"
    assert b["text"] == f"again: {ip}, {card}"
    other = pii.pseudonymize(d, "other key").orderBy("doc_id").first()
    assert other["text"] != a["text"]
    assert (a["n_email"], a["n_phone"], a["n_ip"], a["n_card"], a["n_date"], a["n_ssn"], a["n_iban"]) == (1, 1, 1, 1, 2, 1, 1)


def test_pseudonyms_are_permutations(spark):
    ips = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(".", F.lit(10), F.lit(0), (F.col("id") / 250).cast("int"), F.col("id") % 250).alias("text"))
    assert pii.pseudonymize(ips, "k").select("text").distinct().count() == 3000
    days = spark.range(3000).select(F.col("id").alias("doc_id"), F.date_add(F.lit("1990-01-01"), F.col("id").cast("int")).cast("string").alias("text"))
    out = pii.pseudonymize(days, "k")
    assert out.select("text").distinct().count() == 3000 and out.where("to_date(text) is null").count() == 0


def test_pseudonyms_run_no_python(spark, small):
    plan = queries.op9_pii(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# html


def test_html_template():
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><!-- c --><div class=\"ad\">Buy, now</div>"
        "<header>Top</header><article><h1>Head &amp; tail</h1><p><b>First, para.<br><p>Second\n para &copy;&nbsp;x.</p><aside>Side</aside>"
        "<div class='comments'><p>Nice, post, really.</p></div><form><p>Mail</p></form></article><footer>Foot</footer>"
    )
    assert html_extract.main_text(page) == "Head & tail\n\nFirst, para.\n\nSecond para © x."


def test_html_without_article():
    para = "A sentence, with commas, that is long enough to count as the content of a page, surely. " * 3
    page = (
        f"<body><div id=menu><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div id=content><h2>Title</h2><p>{para}</p><p>{para}</p><p>Short.</p></div>"
        f"<div class=sidebar><p>{para}</p></div><div><a href=x>{para}</a></div></body>"
    )
    assert html_extract.main_text(page) == f"Title\n\n{para.strip()}\n\n{para.strip()}\n\nShort."


LONG = "<p>" + "Long paragraph, with commas, and many words in the text of the article. " * 4 + "</p>"
SAYS = "<p>" + "Reader says, that all this is wrong, and more. " * 9 + "</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="page no-sidebar"><div class="entry">{LONG * 2}</div></div></body>',
        f'<body><div class="page-header-fixed"><main>{LONG * 2}</main></div></body>',
        f"<body><form><article>{LONG * 2}</article><input></form></body>",
        f'<main><article>{LONG * 2}</article><div id="comments"><article>{SAYS * 4}</article></div></main>',
        f'<main><article>{LONG * 2}</article><article class="comment">{SAYS}</article></main>',
        f'<main><div>{LONG * 2}</div><div class="related"><article><p>Teaser, short.</p></article></div></main>',
        f"<article><p title=it's></p>{LONG * 2}<p data-x='a>b'></p></article><a href=\"cut",
    ],
)
def test_html_furniture(page):
    assert html_extract.main_text(page).split("\n\n") == [LONG[3:-4].strip()] * 2


@pytest.mark.parametrize("page", ["<a" * 20000, '<a href="' * 8000, '<div ="x ' * 20000, "<div class=ad>" * 20000, "<!--" * 9000])
def test_html_hostile_pages_take_linear_time(page):
    assert html_extract.main_text(page) == ""


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "</p>", "<script>", "<p>" * 3000, "<div>" * 3000 + "x", "&am", "a<b", "<a href='x>y"])
def test_html_never_fails(page):
    assert isinstance(html_extract.main_text(page), str)


def test_html_cases(spark, small):
    rows = [(1, "u", "<p>Hi</p>", "clash"), (1, "u", "<p>Hi</p>", "clash"), (None, None, None, None)]
    out = html_extract.extract_html(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert sorted(r["text"] for r in out) == ["", "Hi", "Hi"] and sorted(r["n_chars"] for r in out) == [0, 2, 2]
    assert html_extract.extract_html(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in queries.op1_html_extraction(spark, small).collect()}
    for p in pages.collect():  # the template of the table, read by hand
        import html as h

        body = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", " " if x else "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert got[p["page_id"]] == "\n\n".join(x for x in parts if x)


# classifier


def test_classifier_on_held_out_rows(spark, small):
    d = "/root/testdata/sf0.01"
    documents, known = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train, test = known.where("doc_id % 5 <> 0"), known.where("doc_id % 5 = 0")
    scored = cotraining.score_quality(documents, train).join(test, "doc_id")
    right = scored.where(F.col("kept") == (F.col("quality") == 1)).count()
    assert right >= 0.97 * scored.count()
    kept = cotraining.keep_quality(documents, train).count()
    assert kept == cotraining.score_quality(documents, train).where("kept").count()


def test_views_exchange_labels():
    import numpy as np

    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.5).astype(float)
    a, b = y[:, None] + rng.normal(0, 0.25, (400, 1)), y[:, None] * 2 + rng.normal(0, 0.5, (400, 2))
    model = cotraining.co_train(a[:40], b[:40], y[:40], a[40:], b[40:], cotraining.Settings())
    assert model.exchanged > 0 and (((model.odds(a[40:], b[40:]) > 0) == (y[40:] > 0.5)).mean()) > 0.95
    assert cotraining.co_train(a[:5], b[:5], np.ones(5), a[:0], b[:0], cotraining.Settings()) is None
