"""Quality rules by line-first cleaning.

Each line of a text is judged on its own: by punctuation (too many symbols, marks or
separators, long lines without any mark), as navigation (menu words, and runs of
short lines that end without a mark), as boilerplate (legal and cookie phrases of
several languages, copyright notes, bare links), and as a repetition. Failing lines
are removed; a text that loses too much is rejected.

Defined cases: a null text counts as empty; an empty text has no words and is
rejected (``base_failed``); of equal lines the first stays; a cleaned text is the
lines that passed, without blank ones, and ``keep_documents`` leaves a text that loses
no line as it is; null ids pass through; repeated rows are judged independently; other columns of the
input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from riskgraph.llm.rows import map_rows, row_schema

SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, kept_words bigint, n_lines_removed bigint, clean_text string"
)
#: Phrases that mark a line as boilerplate wherever it stands (fixed values).
BOILERPLATE = tuple(
    p.encode()
    for p in (
        "all rights reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados",
        "cookie policy", "accept cookies", "we use cookies", "cookie-richtlinie", "politique de cookies", "política de cookies",
        "privacy policy", "datenschutzerklärung", "politique de confidentialité", "política de privacidad",
        "terms of use", "terms of service", "nutzungsbedingungen", "conditions d'utilisation", "términos de uso",
        "enable javascript", "lorem ipsum", "subscribe to our newsletter", "newsletter abonnieren",
    )
)
#: Words of menus; a short line made of them only is navigation (fixed values).
NAVIGATION = frozenset(
    w.encode()
    for w in (
        "home login logout register search menu contact about next previous back top share print sitemap help faq "
        "startseite anmelden suche kontakt impressum weiter zurück accueil connexion recherche suivant précédent inicio "
        "buscar contacto siguiente anterior"
    ).split()
)
#: What a line may end with: marks, closing quotes and brackets of the scripts that have them (fixed values).
ENDS = tuple(c.encode() for c in ".!?:;,\"')]}»”’…。！？；：，、」』）؟।")
#: Marks of which running text has some (fixed values).
MARKS = tuple(c.encode() for c in ".,;:!?…。！？，、؛؟।")
COPYRIGHT = re.compile("(?:©|\\(c\\)|copyright).{0,40}(?:19|20)[0-9]{2}".encode(), re.I)
LINK = re.compile(rb"\s*(?:https?://|www\.)\S+\s*")


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the verdict on what is left."""

    max_symbol_share: float = 0.25  # symbols to words of a line
    max_bangs: float = 0.25  # '!!' to words of a line
    max_pipes: float = 0.2  # separators to words of a line
    max_unmarked: int = 40  # words of a line without any mark
    menu_words: int = 5  # words of a line that may be part of a menu, if it ends without a mark
    menu_run: int = 3  # such lines in a row that make a menu
    max_same_word: float = 0.5  # share of the commonest word in a line of 10 words or more
    min_kept_share: float = 0.5  # of a text's words, in lines that passed
    min_words: int = 50


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    v = len(number)
    pairs = ids[:-1] * v + ids[1:]
    if v > 1_500_000:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    codes = pairs[:-1] * v + ids[2:]
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, dtype=bool)
    cover[:-2] |= twice
    cover[1:-1] |= twice
    cover[2:] |= twice
    return int(cover.sum())


def line_passes(line: bytes, n: int, rules: LineRules) -> bool:
    """Whether one line of ``n`` words is kept (apart from being a repetition)."""
    symbols = len(line) - len(line.translate(None, b"#*$%&<>"))
    if symbols > rules.max_symbol_share * n:
        return False
    if line.count(b"!!") > rules.max_bangs * n:
        return False
    if line.count(b"|") + line.count("•".encode()) > rules.max_pipes * n:
        return False
    if n > rules.max_unmarked and not any(m in line for m in MARKS):
        return False
    low = line.lower()
    if any(p in low for p in BOILERPLATE) or n <= 2 and LINK.fullmatch(line):
        return False
    if n <= 12 and (b"(c)" in low or b"copyright" in low or "©".encode() in line) and COPYRIGHT.search(line):
        return False
    words = low.split()
    if n <= 6 and all(w.strip(b".,:;>|") in NAVIGATION for w in words):
        return False
    if n >= 10:
        top: dict[bytes, int] = {}
        for w in words:
            top[w] = top.get(w, 0) + 1
        if max(top.values()) > rules.max_same_word * n:
            return False
    return True


def menu_lines(lines: list[bytes], sizes: list[int], rules: LineRules) -> set[int]:
    """Numbers of the lines that stand in a run of short ones without an end mark; blank lines don't end a run."""
    out: set[int] = set()
    run: list[int] = []
    for i, k in enumerate([*sizes, rules.menu_words + 1]):
        if not k:
            continue
        if k <= rules.menu_words and not lines[i].rstrip().endswith(ENDS):
            run.append(i)
            continue
        if len(run) >= rules.menu_run:
            out.update(run)
        run = []
    return out


def judge(text: str | None, rules: LineRules, want_text: bool) -> tuple:
    """Base counts, verdict and cleaned text of one document."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    # code points of words: those of the text less its six white space characters
    chars = len(text) - (len(raw) - len(raw.translate(None, b"\x20\t\n\x0b\x0c\r")))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = removed = kept_words = 0
    kept_lines = []
    lines = raw.split(b"\n")
    sizes = [len(line.split()) for line in lines]
    menu = menu_lines(lines, sizes, rules)
    for i, (line, k) in enumerate(zip(lines, sizes, strict=True)):
        if not k:
            continue
        if line in seen:
            dup += 1
            removed += 1
            continue
        seen.add(line)
        if i not in menu and line_passes(line, k, rules):
            kept_words += k
            kept_lines.append(line)
        else:
            removed += 1
    repeated = _repeat_words(words)
    failed = n < rules.min_words or 100 * repeated > 50 * n
    kept = not failed and kept_words >= rules.min_kept_share * n
    clean = b"\n".join(kept_lines).decode("utf-8", "surrogatepass") if want_text else None
    return n, chars, symbols, dup, repeated, failed, kept, kept_words, removed, clean


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules | None = None, want_text: bool = True
) -> DataFrame:
    """One row per row of ``docs``: base counts, ``kept`` and the cleaned text.

    A single pass without a shuffle; a text is held by one task at a time.
    """
    rules = rules or LineRules()

    def factory():
        return lambda i, t: (i, *judge(t, rules, want_text))

    return map_rows(docs, [id_col, text_col], factory, SCHEMA)


def keep_documents(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars", rules: LineRules | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns and without their failing lines.

    Texts are filtered in place, not joined; a text's size changes only where a line went.
    """
    rules = rules or LineRules()
    names = docs.columns
    text_at, size_at = names.index(text_col), names.index(size_col)

    def factory():
        def one(*row):
            judged = judge(row[text_at], rules, True)
            if not judged[6]:
                return ()
            if not judged[8]:
                return (row,)
            row = list(row)
            row[text_at], row[size_at] = judged[9], len(judged[9])
            return (tuple(row),)

        return one

    return map_rows(docs, names, factory, row_schema(docs), many=True)
