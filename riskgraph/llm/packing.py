"""Packing token sequences by cutting-stock column generation.

Documents are cut into full sequences and one remainder each. How the remainders
share sequences is a cutting-stock problem over their length histogram: a linear
program over patterns (how many pieces of which lengths fill a sequence) whose
columns are priced by a knapsack dynamic program. Patterns are used as often as
the rounded-down program says; what is left over is packed first-fit decreasing.
Pieces then find their place by rank among the pieces of their length class, which
is arithmetic on a lookup table: no task ever holds the pieces of one class.

Only the histogram, at most ``width`` rows, and the pattern table, bounded by the
width as well, pass through the driver.

Defined cases: a null text counts as empty (one end token); every id lies in one
piece; rows repeating a doc_id are packed as separate documents; an empty table
gives an empty result; null ids pass through; further columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.functions.cluster import materialize
from riskgraph.llm.bpe import byte_letters
from riskgraph.llm.rows import map_rows

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, size int, part int, nth bigint"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Ids of the ``tokenizers`` file as bytes, through the rank file of the same vocabulary if given."""

    #: How the file's pre-tokenizer splits (fixed value).
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        back = {c: b for b, c in enumerate(byte_letters())}
        ranks = {
            bytes(back[c] for c in token): i
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()
            if token not in self.special
        }
        self.fast = tiktoken.Encoding("words", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of ``text``."""
        if any(s in text for s in self.special):
            return self.whole(text)
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One per Python worker, which serves many tasks."""
    return ByteBpe(path)


def cut_documents(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, width: int, grid: int) -> DataFrame:
    """Pieces of at most ``width`` ids, numbered within their task and length class."""

    def factory():
        from pyspark import TaskContext

        bpe, part, counts = load(vocabulary), TaskContext.get().partitionId(), {}

        def one(doc, text):
            raw = bpe.encode(text or "") + b"\0\0\0\0"
            total = len(raw) // 4
            out = []
            for at in range(0, total, width):
                piece = raw[4 * at : 4 * (at + width)]
                k = len(piece) // 4
                size = -(-k // grid)
                nth = counts.get(size, 0)
                counts[size] = nth + 1
                out.append((doc, at, k, zlib.crc32(piece), total, size, part, nth))
            return out

        return one

    return map_rows(docs, [id_col, text_col], factory, PIECES, many=True)


@dataclass
class Plan:
    """Patterns as (times used, length classes in order)."""

    patterns: list[tuple[int, list[int]]]

    def table(self) -> list[tuple[int, int, int, int, int, int]]:
        """Rows (class, from, until, each, first sequence, first slot) by rank among a class's pieces."""
        out, seen, sequence = [], {}, 0
        for times, sizes in self.patterns:
            slot = 0
            for size in dict.fromkeys(sizes):
                each = sizes.count(size)
                at = seen.get(size, 0)
                seen[size] = at + each * times
                out.append((size, at, at + each * times, each, sequence, slot))
                slot += each
            sequence += times
        return out


def _best_pattern(value: np.ndarray, lengths: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """Knapsack: the multiset of lengths within ``width`` of the highest value."""
    best = np.zeros(width + 1)
    pick = np.full(width + 1, -1)
    for c in range(1, width + 1):
        k = np.searchsorted(lengths, c, side="right")
        best[c] = best[c - 1]
        if k:
            got = best[c - lengths[:k]] + value[:k]
            j = int(got.argmax())
            if got[j] > best[c] + 1e-12:
                best[c], pick[c] = got[j], j
    out, c = np.zeros(len(lengths)), width
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[pick[c]] += 1
            c -= int(lengths[pick[c]])
    return float(best[width]), out


class _Program:
    """Master program: cover the demand with patterns, each of cost 1, by the revised simplex method."""

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, width: int):
        fit = (width // lengths).astype(float)
        self.columns, self.inverse = np.diag(fit), np.diag(1.0 / fit)
        self.amount, self.cost = demand / fit, np.ones(len(lengths))

    @property
    def dual(self) -> np.ndarray:
        return self.cost @ self.inverse

    def enter(self, column: np.ndarray, cost: float) -> None:
        step = self.inverse @ column
        up = step > 1e-9
        if not up.any():
            return
        ratio = np.full(len(step), np.inf)
        ratio[up] = self.amount[up] / step[up]
        out = int(ratio.argmin())
        by = max(float(ratio[out]), 0.0)
        self.amount -= by * step
        self.amount[out] = by
        np.maximum(self.amount, 0.0, out=self.amount)
        row = self.inverse[out] / step[out]
        self.inverse -= np.outer(step, row)
        self.inverse[out] = row
        self.cost[out], self.columns[:, out] = cost, column


def solve(histogram: dict[int, int], width: int, gap: float = 0.002, max_rounds: int = 1500) -> Plan:
    """Column generation on the histogram, rounding, and first-fit decreasing for the rest.

    First-fit patterns are offered to the program first. Then columns are priced at
    duals smoothed towards the best bound so far; steps stop when the program is within
    ``gap`` of that bound. Any basis is a valid plan, so stopping costs only padding.
    """
    histogram = {k: v for k, v in histogram.items() if v > 0}
    full = histogram.pop(width, 0)
    patterns: list[tuple[int, list[int]]] = [(full, [width])] if full else []
    if not histogram:
        return Plan(patterns)
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[int(x)] for x in lengths], dtype=float)
    m = len(lengths)
    place = {int(x): i for i, x in enumerate(lengths)}
    program = _Program(lengths, demand, width)
    for _, items in _first_fit(lengths, demand.astype(np.int64), width):
        column = np.bincount([place[x] for x in items], minlength=m).astype(float)
        if column @ program.dual > 1 + 1e-9:
            program.enter(column, 1.0)
    center = lengths / width
    bound = float(center @ demand)
    for _ in range(max_rounds):
        if program.amount @ program.cost - bound <= gap * bound:
            break
        dual = program.dual
        low = int(dual.argmin())
        if dual[low] < -1e-9:  # more of a length than asked for costs nothing
            spare = np.zeros(m)
            spare[low] = -1.0
            program.enter(spare, 0.0)
            continue
        for at in (0.8 * center + 0.2 * dual, dual):
            value, column = _best_pattern(at, lengths, width)
            if (below := float(at @ demand) / max(value, 1.0)) > bound:
                bound, center = below, at / max(value, 1.0)
            if column @ dual > 1 + 1e-9:
                program.enter(column, 1.0)
                break
        else:
            break
    left = demand.astype(np.int64).copy()
    for j in np.argsort(-program.amount * program.cost):
        column = program.columns[:, j].astype(np.int64)
        need = column > 0
        if not program.cost[j] or not need.any():
            continue
        times = min(int(program.amount[j] + 1e-7), int((left[need] // column[need]).min()))
        if times > 0:
            left -= times * column
            patterns.append((times, [int(x) for x, k in zip(lengths[::-1], column[::-1], strict=True) for _ in range(k)]))
    patterns += [(1, p) for times, p in _first_fit(lengths, left, width) for _ in range(times)]
    return Plan(patterns)


def _first_fit(lengths: np.ndarray, left: np.ndarray, width: int) -> list[tuple[int, list[int]]]:
    """First-fit decreasing on the histogram: (times, lengths), equal sequences made at once."""
    counts = {int(x): int(k) for x, k in zip(lengths[::-1], left[::-1], strict=True) if k}
    bins: list[tuple[int, list[int]]] = []
    while counts:
        room, items = width, []
        for x in counts:
            k = min(room // x, counts[x])
            if k:
                items += [x] * k
                room -= k * x
        times = min(counts[x] // items.count(x) for x in set(items))
        for x in items:
            counts[x] -= times
        counts = {x: k for x, k in counts.items() if k}
        bins.append((times, items))
    return bins


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    width: int = 1024,
    grid: int = 4,
) -> DataFrame:
    """One row per piece: document, start, length, checksum, sequence and offset in it.

    The program works on lengths rounded up to multiples of ``grid``, which keeps it
    small; offsets add up the lengths themselves, so sequences have no gaps.
    """
    spark = docs.sparkSession
    pieces = materialize(cut_documents(docs, id_col, text_col, vocabulary or default_vocabulary(), width, grid))
    counts = pieces.groupBy("part", "size").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}
    rows = solve(histogram, width // grid).table()
    places = spark.createDataFrame(
        rows, "size int, low bigint, high bigint, each bigint, first_sequence bigint, first_slot bigint"
    )
    ranked = pieces.join(offsets, ["part", "size"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    placed = (
        ranked.join(F.broadcast(places), "size")
        .where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .withColumn("sequence_id", F.col("first_sequence") + F.expr("(rank - low) div each"))
        .withColumn("slot", F.col("first_slot") + F.expr("(rank - low) % each"))
    )
    # a sequence has at most `width` pieces, so its window is small whatever the input
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"),
    )
