"""License scans by template-markup matching.

A template is license wording with marked regions: ``[[...]]`` may be missing (and may
hold further regions), ``{{n}}`` stands for up to ``n`` words of any kind. Each
template is compiled into a token automaton; a text carries the license where the
automaton accepts, so every mandatory word has to be there, in order, with nothing
between. Where several templates accept from one word on, the one with the most
mandatory words counts, so that "cc by nc" isn't taken for "cc by". The templates are
whole licenses, the notices that stand for long ones, and short grants.

Defined cases: a null text counts as empty (no words, score 0); templates with equally
many mandatory words all count; typographic quotes and dashes separate words for the
templates, not for the base scan; null ids pass through; repeated rows are scanned
independently; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from riskgraph.llm.license_texts import PHRASES, templates as known_templates
from riskgraph.llm.rows import map_rows

#: Public license wording with markup.
TEMPLATES = known_templates()
SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, spans string"
)
#: Typographic quotes and dashes, which the templates write plainly.
_MARKS = re.compile("[\u2010-\u2015\u2018-\u201f\u2032\u2033\u00ab\u00bb\u00a0\u2022]")
_MARKUP = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Lower-cases A-Z and blanks what is in no word, byte by byte; bytes of other characters stay.
_TABLE = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80) else 0x20
    for b in range(256)
)


class Automaton:
    """Token automaton of one template.

    State ``s`` has read ``s`` tokens of the template. ``step[s]`` is the word it
    wants, ``skip[s]`` the states it may jump to without reading, ``any[s]`` says
    that it may read any word.
    """

    def __init__(self, markup: str):
        self.step: list[bytes | None] = []
        self.skip: dict[int, list[int]] = {}
        self.any: set[int] = set()
        self.need: list[int] = [0]  # mandatory words read when in a state
        opened: list[int] = []
        mandatory = 0
        for piece in _MARKUP.findall(markup.lower()):
            at = len(self.step)
            if piece == "[[":
                opened.append(at)
            elif piece == "]]":
                if not opened:
                    raise ValueError("a region ends that didn't begin")
                self.skip.setdefault(opened.pop(), []).append(at)
            elif piece.startswith("{{"):
                for k in range(int(piece[2:-2])):
                    self.any.add(at + k)
                    self.skip.setdefault(at + k, []).append(at + k + 1)
                    self.step.append(None)
                    self.need.append(mandatory)
            else:
                mandatory += not opened
                self.step.append(piece.encode())
                self.need.append(mandatory)
        if opened:
            raise ValueError("a region doesn't end")
        self.last, self.mandatory = len(self.step), mandatory
        self.start = self.closure({0})
        self.first = {self.step[s] for s in self.start if s < self.last and self.step[s] is not None}

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skip.get(todo.pop(), ()):
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def match(self, words: list[bytes], at: int) -> tuple[int, int]:
        """End of the longest accepted run of words from ``at`` (-1 if none), and the mandatory words read at most."""
        now, best, end = self.start, 0, -1
        while True:
            if self.last in now:
                end = at
            if at >= len(words):
                break
            w = words[at]
            now = self.closure({s + 1 for s in now if s < self.last and (self.step[s] == w or s in self.any)})
            if not now:
                break
            best = max(best, max(self.need[s] for s in now))
            at += 1
        return end, self.mandatory if end >= 0 else best

    def run(self, words: list[bytes], at: int) -> tuple[bool, int]:
        """Whether it accepts a run of words from ``at``, and the mandatory words read at most."""
        end, got = self.match(words, at)
        return end >= 0, got


def compile_templates(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, all_of in templates.items() for t in all_of]


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Scanner:
    """Base phrases and automata by the words that they may begin with."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, tuple[str, ...]]):
        self.phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for p, label in phrases.items():
            words = p.encode().split()
            self.phrases.setdefault(words[0], []).append((words, label))
        self.automata: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, a in compile_templates(templates):
            for w in a.first:
                self.automata.setdefault(w, []).append((label, a))


def find_base(words: list[bytes], by: Scanner) -> tuple[list[int], set[str]]:
    """Starts and labels of the base phrases."""
    starts, labels = [], set()
    for at in [i for i, w in enumerate(words) if w in by.phrases]:
        for p, label in by.phrases[words[at]]:
            if words[at : at + len(p)] == p:
                starts.append(at)
                labels.add(label)
    return starts, labels


def find_templates(words: list[bytes], by: Scanner) -> tuple[list[tuple[str, int, int]], float]:
    """Accepted spans (label, start, end), and the best share of mandatory words that was read."""
    spans, best = [], 0.0
    for at in [i for i, w in enumerate(words) if w in by.automata]:
        found: dict[str, tuple[int, int]] = {}
        for label, a in by.automata[words[at]]:
            end, got = a.match(words, at)
            if end >= 0:
                found[label] = max(found.get(label, (0, 0)), (got, end))
            best = max(best, got / a.mandatory)
        if found:
            most = max(got for got, _ in found.values())
            spans += [(label, at, end) for label, (got, end) in sorted(found.items()) if got == most]
    return spans, best


def scan(text: str | None, by: Scanner, want_spans: bool = False) -> tuple:
    """Columns of one text, from ``n_words`` to ``score``; ``spans`` as well if wanted."""
    text = text or ""
    words = split_words(text)
    starts, base = find_base(words, by)
    plain = _MARKS.sub(" ", text) if not text.isascii() else text
    spans, best = find_templates(words if plain == text else split_words(plain), by)
    labels = {label for label, _, _ in spans}
    if base:
        best = max(best, 0.9)
    score = best if best > 0.5 else 0.0
    first, last = (starts[0], starts[-1]) if starts else (None, None)
    row = len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), float(score)
    return (*row, ",".join(f"{label}:{s}:{e}" for label, s, e in spans)) if want_spans else row


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict | None = None, phrases: dict | None = None
) -> DataFrame:
    """One row per row of ``docs``. ``score`` is 1 for an accepted template, 0.9 for a
    base phrase alone, else the share of mandatory words that an automaton read, if over half;
    ``spans`` lists accepted templates as label:start:end, in words of the text without typographic marks."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases

    def factory():
        by = Scanner(phrases, templates)
        return lambda i, t: (i, *scan(t, by, True))

    return map_rows(docs, [id_col, text_col], factory, SCHEMA)
