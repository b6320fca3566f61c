"""Scalar functions of the risk model as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_accents():
    """An Arrow UDF: lower, trim, canonical decomposition without non-spacing marks; null gives ''."""

    @F.pandas_udf("string")
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import unicodedata

        def one(s):
            if s is None or s != s:
                return ""
            s = s.lower().strip()
            if s.isascii():
                return s
            return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")

        for b in batches:
            yield b.map(one, na_action=None)

    return normal


def normalized(c: Column | str) -> Column:
    """Lower case, without surrounding white space and without accents, of any alphabet."""
    return strip_accents()(F.col(c) if isinstance(c, str) else c)


def normalized_identifier(c: Column | str) -> Column:
    """Lower case without surrounding white space; null gives ''."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length of normalised strings; both empty 1, one empty 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0)
        .otherwise(1 - F.levenshtein(a, b) / longest).cast("double")
    )


def prefix_similarity(a: Column, b: Column) -> Column:
    """Equal places among the first four characters, padded with 0."""
    x, y = F.rpad(F.left(a, F.lit(4)), 4, "0"), F.rpad(F.left(b, F.lit(4)), 4, "0")
    hits = sum((F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(1, 5))
    return F.when((a == "") | (b == ""), 0.0).otherwise(hits / 4.0).cast("double")


def exact_similarity(a: Column, b: Column, nulls_match: bool = True) -> Column:
    same = (a == b) if nulls_match else (a == b) & (a != "")
    return same.cast("double")


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def whole_days(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400)


def frequency(n: Column) -> Column:
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(n.cast("double")) / F.log(F.lit(101.0))))


def recency(days: Column, decay: float) -> Column:
    return F.exp(-F.lit(decay) * days)


def diversity(kinds: Column, most: int) -> Column:
    return F.least(F.lit(1.0), F.array_size(F.array_distinct(kinds)) / float(most))


def set_jaccard(a: Column, b: Column) -> Column:
    union = F.array_size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.array_size(F.array_intersect(a, b)) / union).cast("double")


def utc(c: Column) -> Column:
    """Epoch seconds, ISO text or timestamps as UTC timestamps; text without a zone means UTC, bad text is null."""
    return F.coalesce(F.try_to_timestamp(c.cast("string")), F.timestamp_seconds(c.cast("string").try_cast("double")))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def isolation_depth(n: Column) -> Column:
    """Mean depth of an unsuccessful search among ``n`` points."""
    gamma = 0.5772156649015329
    return F.when(n <= 1, 0.0).otherwise(2.0 * (F.log((n - 1).cast("double")) + gamma) - 2.0 * (n - 1) / n)


def classification_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """Precision, recall, F1, accuracy, specificity and MCC, 0 where undefined, 4 digits."""

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    d = F.sqrt(((tp + fp) * (tp + fn)).cast("double") * ((tn + fp) * (tn + fn)).cast("double"))
    return [
        F.round(x, 4).alias(n)
        for n, x in (
            ("precision", p), ("recall", r), ("f1", ratio(2 * p * r, p + r)), ("accuracy", ratio(tp + tn, tp + tn + fp + fn)),
            ("specificity", ratio(tn, tn + fp)), ("mcc", ratio((tp * tn - fp * fn).cast("double"), d)),
        )
    ]


def uniform(seed: int, name: str, *keys: str) -> Column:
    """A number in [0, 1) that depends on a seed, a name and columns only: the first 52 bits of a digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), *(F.col(k).cast("string") for k in keys)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / float(1 << 52)
