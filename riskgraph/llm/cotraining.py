"""Quality classifier by co-training on two views.

One classifier sees the text's content (its shape and its hashed word and character
n-grams), another the page's metadata (language, source, stated length). Both start
from the labelled rows; in each round each scores all unlabelled rows and hands those
that it is surest of, with its labels, to the other. Then both are calibrated on
labelled rows held out, and their log odds are added (less the prior, which both
contain) to score every document.

Features of all documents are computed once and kept as a table. Training reads at
most ``Settings.labelled`` labelled rows of the documents at hand, chosen by hash, and
is handed at most ``Settings.handed`` unlabelled rows per view and round: those are
found over the whole table, by counting its rows by their odds first. Scoring is a
column expression over all rows, in training as at the end.

Defined cases: a null text counts as empty, a null language, source or length is
a category of its own; labels that are null, or tie within one doc_id, are not
used; if no label of both classes is left, every document scores 0.5 and is kept;
rows that tie in their odds are taken by hash of doc_id; rows repeating a doc_id
are scored independently; rows without a doc_id are scored, not trained on; further
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.cluster import hash_sample, materialize
from riskgraph.llm.rows import map_rows, row_schema

#: Hashed categories of languages and sources, and hashed buckets of n-grams.
LANGS, SOURCES, GRAMS = 8, 32, 256
#: Letters of a character n-gram, and words whose buckets a worker remembers.
LETTERS, WORDS_KNOWN = 4, 200_000
SHAPE = 16
VIEWS = {"content": SHAPE + GRAMS, "meta": LANGS + SOURCES + 2}
#: Bins per unit of log odds in which rows are counted.
BINS = 8


@dataclass(frozen=True)
class Settings:
    labelled: int = 6000  # labelled rows used at most, by hash of doc_id
    rare: int = 200  # of each class, if there are so many
    handed: int = 600  # unlabelled rows that a view hands over in a round at most
    held_out: float = 0.3  # of the labelled rows, for calibration
    rounds: int = 3
    sure: float = 0.95
    ridge: float = 1e-2
    keep_at: float = 0.5


class _Buckets(dict):
    """Numbers of the words met lately; ``rows`` has the four signed buckets of each word's n-grams in order.

    A bucket from ``GRAMS`` on stands for the one ``GRAMS`` below it with a negative sign.
    """

    rows = array("h")

    def room(self, n: int) -> None:
        """Makes room for ``n`` more words, so that numbers hold for a whole text."""
        if len(self) + n > WORDS_KNOWN:
            self.clear()
            self.rows = array("h")

    def __missing__(self, word: bytes) -> int:
        edged = b"<" + word + b">"
        grams = (word, b"#" + edged[:LETTERS], b"#" + edged[-LETTERS:], b"#" + edged[2 : 2 + LETTERS])
        self.rows.extend([zlib.crc32(g) % (2 * GRAMS) for g in grams])
        i = self[word] = len(self)
        return i


_buckets = _Buckets()


def gram_view(words: list[bytes]) -> np.ndarray:
    """Signed hashed counts of words and of character n-grams at their ends and inside, relative to all of them."""
    _buckets.room(len(words))
    at = [_buckets[w] for w in words]
    hit = np.bincount(np.frombuffer(_buckets.rows, dtype=np.int16).reshape(-1, 4)[at].ravel(), minlength=2 * GRAMS)
    return (hit[:GRAMS] - hit[GRAMS:]) / (4 * len(words))


def content_view(text: str | None) -> np.ndarray:
    """Sixteen shares and logarithms of a text's shape, whatever its language, and its n-grams."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(VIEWS["content"], dtype=np.float32)
    size = len(raw)

    def share(chars: bytes) -> float:
        return (size - len(raw.translate(None, chars))) / size

    lines = [x for x in raw.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1:] in b".!?:;\"'" for x in lines)
    kinds = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    symbols = (size - len(raw.translate(None, b"#*$%&<>"))) / n
    upper = share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    shape = [
        math.log1p(n), min(symbols, 2.0), min(raw.count(b"!!") / n, 2.0), min(raw.count(b"|") / n, 2.0),
        upper, 1.0 if upper > 0.4 else 0.0, share(b"0123456789"), share(b".,;:"),
        kinds / n, pairs / max(1, n - 1), min(size / n, 40.0) / 10, 1 - len(set(lines)) / len(lines),
        ended / len(lines), min(len(lines) / n, 1.0), 1.0 if n < 50 else 0.0, min(math.log1p(size / len(lines)), 12.0),
    ]
    return np.concatenate([shape, gram_view(raw.lower().split())]).astype(np.float32)


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """One-hot hashes of language and source, and the stated length."""
    out = [0.0] * VIEWS["meta"]
    out[xxhash.xxh32_intdigest(lang or "") % LANGS] = 1.0
    out[LANGS + xxhash.xxh32_intdigest(source or "") % SOURCES] = 1.0
    out[-2] = math.log1p(max(0, n_chars or 0))
    out[-1] = 1.0 if n_chars is None else 0.0
    return out


@dataclass
class View:
    """Standardised logistic regression with a calibration on top."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * (x @ self.weights + self.bias) + self.shift, -12, 12)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float) -> View:
    """Newton steps on the penalised likelihood; weights refer to unscaled features."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std < 1e-9, 1.0, std)
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge * len(x))
    penalty[-1] = 1e-6
    for _ in range(25):
        p = _sigmoid(z @ w)
        hess = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / std
    return View(weights, float(w[-1] - mean @ weights))


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling on held-out rows; a view that orders them no better than chance goes flat."""
    raw = x @ view.weights + view.bias
    scaled = fit(raw[:, None], y, 1e-4)
    view.slope, view.shift = max(0.0, float(scaled.weights[0])), scaled.bias
    if scaled.weights[0] <= 0:
        view.shift = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))


@dataclass
class Model:
    content: View
    meta: View
    prior: float
    exchanged: int

    def odds(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return self.content.odds(content) + self.meta.odds(meta) - self.prior


#: Rows as arrays: the features by view, and the labels.
Rows = tuple[dict[str, np.ndarray], np.ndarray]


def train(rows: Rows, pool: Callable[[str, View, dict[float, int], set], list], settings: Settings) -> Model | None:
    """Both views; None where the labels lack a class.

    ``pool(view, fitted, quotas, taken)`` gives the unlabelled rows (key, class, content,
    meta) that a fitted view is surest of, at most ``quotas[class]`` of each class and
    none whose key is ``taken``.
    """
    x, label = rows
    n = len(label)
    if n < 4 or label.min() == label.max():
        return None
    # rows come in hash order; of each class the first rows are held out
    held = np.zeros(n, dtype=bool)
    for c in (0.0, 1.0):
        at = np.flatnonzero(label == c)
        held[at[: int(settings.held_out * len(at))]] = True
    if len(set(label[held])) < 2:
        held[:] = False
    use = ~held
    check = held if held.any() else use
    share = {c: float((label[use] == c).mean()) for c in (0.0, 1.0)}
    # both classes in the proportion of the labels, so that one cannot flood the other view
    quotas = {c: max(1, round(settings.handed * share[c])) for c in share}
    given: dict[str, list] = {"content": [], "meta": []}
    fitted: dict[str, View] = {}
    for step in range(settings.rounds + 1):
        for name in VIEWS:
            more = given[name]
            at = 2 if name == "content" else 3
            features = np.vstack([x[name][use], *(np.asarray(r[at], dtype=float)[None, :] for r in more)])
            fitted[name] = fit(features, np.concatenate([label[use], [r[1] for r in more]]), settings.ridge)
            calibrate(fitted[name], x[name][check], label[check])
        if step == settings.rounds:
            break
        for name, other in (("content", "meta"), ("meta", "content")):
            given[other] += pool(name, fitted[name], quotas, {r[0] for r in given[other]})
    prior = float(np.log((label[use].sum() + 1) / ((1 - label[use]).sum() + 1)))
    return Model(fitted["content"], fitted["meta"], prior, sum(map(len, given.values())))


def co_train(
    content: np.ndarray, meta: np.ndarray, label: np.ndarray, pool_content: np.ndarray, pool_meta: np.ndarray, settings: Settings
) -> Model | None:
    """The same with a pool of arrays."""
    views = {"content": pool_content, "meta": pool_meta}
    limit = math.log(settings.sure / (1 - settings.sure))

    def pool(name: str, view: View, quotas: dict[float, int], taken: set) -> list:
        odds = view.odds(views[name])
        free = [i for i in np.argsort(-np.abs(odds), kind="stable").tolist() if abs(odds[i]) >= limit and i not in taken]
        return [
            (i, c, pool_content[i], pool_meta[i])
            for c, quota in quotas.items() for i in [i for i in free if (odds[i] > 0) == bool(c)][:quota]
        ]

    return train(({"content": content, "meta": meta}, label), pool, settings)


def featurize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, content, meta`` of every row."""

    def factory():
        return lambda i, text, lang, source, n: (i, content_view(text), meta_view(lang, source, n))

    return map_rows(docs, [id_col, text_col, "lang", "source", "n_chars"], factory, "doc_id bigint, content array<float>, meta array<float>")


def beside_features(docs: DataFrame, text_col: str, content: str, meta: str) -> DataFrame:
    """``docs`` with both views of every row in columns of these names."""
    names = docs.columns
    at = [names.index(c) for c in (text_col, "lang", "source", "n_chars")]

    def factory():
        def one(*row):
            text, lang, source, n = (row[i] for i in at)
            return (*row, content_view(text), meta_view(lang, source, n))

        return one

    return map_rows(docs, names, factory, f"{row_schema(docs)}, `{content}` array<float>, `{meta}` array<float>")


def _odds(view: View, col: str) -> Column:
    weights = F.array(*(F.lit(float(view.slope * w)) for w in view.weights))
    dot = F.aggregate(F.zip_with(F.col(col), weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), dot + F.lit(float(view.slope * view.bias + view.shift))))


def _probability(odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def labelled_rows(features: DataFrame, labels: DataFrame, settings: Settings, label_col: str = "quality") -> tuple[Rows, DataFrame]:
    """The bounded labelled sample in hash order, and the ids that it took.

    Labels count only where a document has them; a class too rare for its share still
    gets up to ``settings.rare`` rows.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
        .groupBy("doc_id").agg(F.avg(F.col(label_col).cast("double")).alias("y"))
        .where("y <> 0.5").select("doc_id", (F.col("y") > 0.5).cast("double").alias("y"))
    )
    known = materialize(known.join(features.select("doc_id").distinct(), "doc_id", "left_semi"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    parts = [
        hash_sample(known.where(F.col("y") == c), ["doc_id"], max(min(n, settings.rare), round(settings.labelled * n / max(total, settings.labelled))), "labelled")
        for c, n in sorted(sizes.items())
    ]
    chosen = parts[0] if parts else known.limit(0)
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    chosen = materialize(chosen)
    rows = features.join(F.broadcast(chosen), "doc_id").select("doc_id", "content", "meta", "y").collect()
    rows = sorted(rows, key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["content"], r["meta"]))
    x = {v: np.array([r[v] for r in rows], dtype=float).reshape(len(rows), width) for v, width in VIEWS.items()}
    return (x, np.array([r["y"] for r in rows])), chosen.select("doc_id")


def surest(features: DataFrame, labelled: DataFrame, settings: Settings) -> Callable[[str, View, dict[float, int], set], list]:
    """The pool of all unlabelled rows of ``features``, for ``train``.

    Rows are counted by class and bin of their log odds; the bins that fill the quota
    are read then, the last of them in part, by hash.
    """
    spark = features.sparkSession
    limit = math.log(settings.sure / (1 - settings.sure))
    place = F.pmod(F.xxhash64("doc_id", F.lit("handed")), F.lit(1_000_000))

    def pool(name: str, view: View, quotas: dict[float, int], taken: set) -> list:
        out = labelled.unionByName(spark.createDataFrame([(i,) for i in sorted(taken)], "doc_id bigint"))
        free = features.where("doc_id is not null").join(F.broadcast(out), "doc_id", "left_anti")
        odds = free.select("doc_id", "content", "meta", _odds(view, name).alias("odds")).where(F.abs("odds") >= limit)
        odds = odds.withColumn("y", (F.col("odds") > 0).cast("double")).withColumn("bin", F.floor(F.abs("odds") * BINS))
        sizes = odds.groupBy("y", "bin").agg(F.count("*").alias("n")).collect()
        tests = []
        for c, quota in quotas.items():
            left = quota
            for r in sorted((r for r in sizes if r["y"] == c), key=lambda r: -r["bin"]):
                share = min(1.0, 1.2 * left / r["n"] + 1e-6)
                tests.append((F.col("y") == c) & (F.col("bin") == r["bin"]) & (place < F.lit(int(share * 1_000_000))))
                left -= r["n"]
                if left <= 0:
                    break
        if not tests:
            return []
        some = tests[0]
        for t in tests[1:]:
            some |= t
        found = odds.where(some).withColumn("place", place).collect()
        found.sort(key=lambda r: (-r["bin"], r["place"], r["doc_id"], r["content"]))
        picked, seen = [], set()
        for c, quota in quotas.items():
            for r in found:
                if r["y"] == c and quota > 0 and r["doc_id"] not in seen:
                    seen.add(r["doc_id"])
                    picked.append((r["doc_id"], c, r["content"], r["meta"]))
                    quota -= 1
        return picked

    return pool


def fit_model(features: DataFrame, labels: DataFrame, settings: Settings) -> Model | None:
    """Co-training over a table of features."""
    rows, ids = labelled_rows(features, labels, settings)
    return train(rows, surest(features, ids, settings), settings)


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None
) -> DataFrame:
    """``doc_id, score_content, score_meta, score, kept`` for every row of ``docs``."""
    settings = settings or Settings()
    features = materialize(featurize(docs, id_col, text_col))
    return with_scores(features, fit_model(features, labels, settings), settings)


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns.

    Features are kept beside the rows, so nothing is computed twice and no join has to
    bring rows and scores together.
    """
    settings = settings or Settings()
    content, meta = (next(n for k in range(len(docs.columns) + 1) if (n := f"{view}_{k}") not in docs.columns) for view in VIEWS)
    features = materialize(beside_features(docs, text_col, content, meta))
    slim = features.select(F.col(id_col).alias("doc_id"), F.col(content).alias("content"), F.col(meta).alias("meta"))
    model = fit_model(slim, labels, settings)
    if model is None:
        return features.select(*docs.columns)
    return features.where(_score(_odds(model.content, content), _odds(model.meta, meta), model) >= F.lit(settings.keep_at)).select(*docs.columns)


def _score(content: Column, meta: Column, model: Model) -> Column:
    return _probability(content + meta - F.lit(model.prior))


def with_scores(features: DataFrame, model: Model | None, settings: Settings) -> DataFrame:
    """``doc_id`` with scores and verdict."""
    if model is None:
        half = F.lit(0.5)
        return features.select("doc_id", half.alias("score_content"), half.alias("score_meta"), half.alias("score"), F.lit(True).alias("kept"))
    scored = features.select("doc_id", _odds(model.content, "content").alias("a"), _odds(model.meta, "meta").alias("b"))
    score = _score(F.col("a"), F.col("b"), model)
    return scored.select(
        "doc_id", _probability(F.col("a")).alias("score_content"), _probability(F.col("b")).alias("score_meta"),
        score.alias("score"), (score >= F.lit(settings.keep_at)).alias("kept"),
    )
