"""Byte-pair encoding with a segment tree over adjacent pair ranks.

For one word, the leaves of a segment tree hold the merge rank of each adjacent
pair and the root holds the lowest; walking down to the left yields the leftmost
pair of that rank. A merge changes three leaves, each an update of logarithmic
cost, until no pair of the vocabulary is left. Words recur, so a worker keeps
the outcome of the words it has met lately, in two generations of ``CACHE`` words.

Defined cases: a null text counts as empty and has no tokens (digests are those
of the empty string); a word of any length is merged in O(n log n); strings of
special tokens in a text become those tokens, as the library does; null ids pass
through; repeated rows are encoded independently; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from riskgraph.llm.rows import map_rows

#: Words that a generation of a worker's memory holds; when it is full, the one before it is dropped.
CACHE = 250_000
NONE = 1 << 60
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def merge(symbols: list[int], ranks: dict[int, tuple[int, int]], base: int) -> list[int]:
    """Merges ``symbols`` by ``ranks`` (left * base + right -> rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1
    while size < n - 1:
        size *= 2
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(symbols[i] * base + symbols[i + 1])
        if r is not None:
            tree[size + i] = r[0]
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        i += size
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a <= b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    symbols = list(symbols)
    while (lowest := tree[1]) != NONE:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != lowest:
                i += 1
        i -= size
        j = after[i]
        symbols[i] = get(symbols[i] * base + symbols[j])[1]
        k = after[i] = after[j]
        symbols[j] = -1
        if j < n - 1:
            put(j, NONE)
        if k < n:
            before[k] = i
            r = get(symbols[i] * base + symbols[k])
            put(i, r[0] if r else NONE)
        else:
            put(i, NONE)
        if (h := before[i]) >= 0:
            r = get(symbols[h] * base + symbols[i])
            put(h, r[0] if r else NONE)
    return [s for s in symbols if s >= 0]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A lower-casing word-level BPE read from a ``tokenizers`` file."""

    #: How the file's pre-tokenizer splits (fixed value).
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.base = max(self.tokens) + 1
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.vocab[a] * self.base + self.vocab[b]] = (rank, self.vocab[a + b])
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + self.suffix] for c in letters]
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")
        self.library = Tokenizer.from_file(path)
        self.letter_bytes = {c: b for b, c in enumerate(letters)}
        # characters that Unicode tables of different age may class differently
        gaps = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
        cuts = [0, *(i for i in range(1, len(gaps)) if gaps[i] != gaps[i - 1] + 1), len(gaps)]
        self.unsure = re.compile("[" + "".join(f"{chr(gaps[a])}-{chr(gaps[b - 1])}" for a, b in zip(cuts, cuts[1:])) + "]")
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def normalize(self, text: str) -> str:
        # character by character: str.lower alone would use the final form of sigma
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def words(self, text: str) -> list[str]:
        """The words of ``text``, lower-cased."""
        try:
            text.encode("latin-1")
            sure = True
        except UnicodeEncodeError:
            sure = not self.unsure.search(text)
        if not sure:
            # the library's own tables decide; bytes of its letters are read back
            norm = self.library.normalizer.normalize_str(text)
            pieces = self.library.pre_tokenizer.pre_tokenize_str(norm)
            return [bytes(self.letter_bytes[c] for c in p).decode("utf-8") for p, _ in pieces]
        return self.WORDS.findall(self.normalize(text))

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        return merge([self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]], self.ranks, self.base)

    def learn(self, word: str) -> tuple[str, str]:
        out = self.older.get(word)
        if out is None:
            ids = self.encode_word(word)
            out = " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids])
        if len(word) <= 64:
            if len(self.known) >= CACHE:
                self.older = dict(self.known)
                self.known.clear()
            self.known[word] = out
        return out

    def encode(self, text: str) -> tuple[str, str]:
        """The ids and the tokens of ``text``, each joined by one space."""
        ids: list[str] = []
        tokens: list[str] = []
        get = self.known.get
        parts = self.split.split(text) if "<|" in text else (text,)
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(str(self.special[part]))
                tokens.append(part)
                continue
            for w in self.words(part):
                got = get(w) or self.learn(w)
                ids.append(got[0])
                tokens.append(got[1])
        return " ".join(ids), " ".join(tokens)

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by one space: the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One per Python worker, which serves many tasks."""
    return WordBpe(path)


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, want_ids: bool = True
) -> DataFrame:
    """Ids of every row of ``docs`` and digests of its ids and of the text decoded from them. No shuffle."""
    path = vocabulary or default_vocabulary()

    def factory():
        bpe = load(path)

        def one(i, text):
            ids, tokens = bpe.encode(text or "")
            n = ids.count(" ") + 1 if ids else 0
            return (
                i, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(tokens.encode("utf-8")).hexdigest(),
                list(map(int, ids.split())) if want_ids else None,
            )

        return one

    return map_rows(docs, [id_col, text_col], factory, SCHEMA)
