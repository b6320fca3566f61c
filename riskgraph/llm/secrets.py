"""Secret scans with multipart credential linking.

Strong spans are found by pattern alone. Access identifiers, secrets and
endpoints that are too weak to report by themselves are joined by interval:
one is reported only when a complementary part lies within ``reach`` code
points of it in the same scope (a block of lines without an empty line).
Identifiers and endpoints complement a secret, and a reported secret them; an
endpoint doesn't complement what is part of it, such as a long path.

Defined cases: a null text counts as empty and has no span; null ids pass
through; repeated rows are scanned independently; further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from riskgraph.llm.rows import map_rows, row_schema

#: Base patterns (fixed values).
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so short ones can be skipped here
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Weak parts.
WEAK_ID = re.compile(
    r"""(?:access_key_id|client_id|user_?name|user|login|account_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    re.I | re.A,
)
WEAK_ID_HINTS = ("access_key_id", "client_id", "user", "login", "account_id")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}")
ENDPOINT = re.compile(
    r"https?://[^\s\"'<>]+|(?<![\w.-])(?:[a-z0-9-]+\.)+[a-z]{2,}:\d{2,5}(?!\d)|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?(?![\w.])"
)
SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")
ORDER = {"assign": 0, "access": 1, "hex": 2, "id": 3, "secret": 4, "endpoint": 5}
#: Kinds whose text is itself secret.
SECRET_KINDS = ("assign", "access", "hex", "secret")
SCHEMA = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
    "n_linked bigint, masked string"
)


@dataclass(frozen=True)
class LinkRules:
    reach: int = 256
    mask: str = "[SECRET]"


class _Parts:
    """Intervals of one role, ready for overlap tests."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.ends, top = [], -1
        for _, e in spans:
            top = max(top, e)
            self.ends.append(top)

    def meets(self, low: int, high: int) -> bool:
        """Whether an interval overlaps [low, high)."""
        k = bisect.bisect_left(self.starts, high)
        return k > 0 and self.ends[k - 1] > low


def base_spans(text: str, low: str) -> list[tuple[str, int, int]]:
    out = []
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def linked_spans(text: str, low: str, base: list[tuple[str, int, int]], rules: LinkRules) -> list[tuple[str, int, int]]:
    """Weak parts that have a complementary part in reach and scope."""
    taken = _Parts([(s, e) for _, s, e in base])
    secrets = [(s, e) for k, s, e in base if k != "access"]
    weak_secrets = [m.span() for m in WEAK_SECRET.finditer(text) if not taken.meets(*m.span())]
    if not secrets and not weak_secrets:
        return []  # the other parts only count beside a secret
    weak_ids = []
    if any(h in low for h in WEAK_ID_HINTS):
        weak_ids = [m.span() for m in WEAK_ID.finditer(text) if not taken.meets(*m.span())]
    any_id = _Parts([(s, e) for k, s, e in base if k == "access"] + weak_ids)
    points = [m.span() for m in ENDPOINT.finditer(text)]
    starts_at, ends_at = [s for s, _ in points], [e for _, e in points]
    ends = [m.start() for m in SCOPE_END.finditer(text)]
    begins = [0] + [m.end() for m in SCOPE_END.finditer(text)]

    def window(s: int, e: int) -> tuple[int, int]:
        k = bisect.bisect_right(begins, s) - 1
        last = ends[k] if k < len(ends) else len(text)
        return max(begins[k], s - rules.reach), min(max(last, e), e + rules.reach)

    def complemented(s: int, e: int) -> bool:
        """Whether a secret has an identifier, or an endpoint that it isn't part of, in its window."""
        first, last = window(s, e)
        before, after = bisect.bisect_right(ends_at, s), bisect.bisect_left(starts_at, e)
        return (
            any_id.meets(first, last) or before > 0 and ends_at[before - 1] > first
            or after < len(points) and starts_at[after] < last
        )

    weak_secrets = [x for x in weak_secrets if complemented(*x)]
    any_secret = _Parts(secrets + weak_secrets)
    out = [("id", *x) for x in weak_ids if any_secret.meets(*window(*x))]
    out += [("secret", *x) for x in weak_secrets]
    out += [("endpoint", *x) for x in points if not taken.meets(*x) and any_secret.meets(*window(*x))]
    return out


def _text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], ORDER[x[0]], x[2])))


def mask(text: str, spans: list[tuple[str, int, int]], by: str) -> str:
    """``text`` with every union of overlapping secret spans replaced."""
    hide = sorted((s, e) for k, s, e in spans if k in SECRET_KINDS)
    out, at = [], 0
    for s, e in hide:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], by]
        at = e
    return "".join(out) + text[at:]


def scan(text: str | None, rules: LinkRules, want_text: bool) -> tuple:
    text = text or ""
    low = text.lower()
    base = base_spans(text, low)
    more = linked_spans(text, low, base, rules)
    count = {k: sum(x[0] == k for x in base) for k in ("assign", "access", "hex")}
    digest = hashlib.sha256(_text(base).encode()).hexdigest()
    hidden = mask(text, base + more, rules.mask) if want_text else None
    return count["assign"], count["access"], count["hex"], digest, _text(base + more), len(more), hidden


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LinkRules | None = None, want_text: bool = True
) -> DataFrame:
    """One row per row of ``docs``: counts, digests, spans and the masked text. No shuffle."""
    rules = rules or LinkRules()

    def factory():
        return lambda i, t: (i, *scan(t, rules, want_text))

    return map_rows(docs, [id_col, text_col], factory, SCHEMA)


def mask_documents(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars", rules: LinkRules | None = None) -> DataFrame:
    """``docs`` with secrets masked; null texts stay null, sizes change only with their text.

    Every column passes through, so no join is needed to bring the masked text back.
    """
    rules = rules or LinkRules()
    names = docs.columns
    text_at, size_at = names.index(text_col), names.index(size_col)

    def factory():
        def one(*row):
            text = row[text_at]
            if text is None:
                return row
            low = text.lower()
            base = base_spans(text, low)
            hidden = mask(text, base + linked_spans(text, low, base, rules), rules.mask)
            if hidden == text:
                return row
            row = list(row)
            row[text_at], row[size_at] = hidden, len(hidden)
            return tuple(row)

        return one

    return map_rows(docs, names, factory, row_schema(docs))
