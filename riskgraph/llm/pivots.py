"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its 8 or 10 nearest reference points in order. Inverted
lists are kept for the sets of ``SHARED`` of them, so two vectors meet in a list
exactly if they share that many; a pair that shares more counts only in the list of
its first shared pivots. The number of pivots grows with the root of the number of
vectors, which keeps the lists short at every size.

Members of a list are compared twice, block against block. First by signs of fixed
random projections, which let through what may reach the threshold; only members with
such a partner go on, so vectors move for those lists alone. Then by cosine in double
precision. Only members, sums and spanning links leave a block, never its pairs.

Pivots are rows of a bounded sample (``SAMPLE`` rows by hash, mutually apart), topped
up with fixed random directions, which workers draw themselves. Every vector is
indexed. Equal vectors are collapsed beforehand and counted with their multiplicity.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing (0 links, a component of their own); components of any
magnitude are scaled before their norm is taken; vectors of different dimension never
link; rows that repeat a vec_id are one vector each for links, with one output row per
input row; null ids link with nothing; pivots at the same distance count by number;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.cluster import hash_sample, materialize, release, ship_package
from riskgraph.functions.graph import connected_components

#: Pivots of a vector while there are up to so many, and beyond, where like vectors share fewer; how many two have to share.
NEAREST, MANY, NEAREST_OF_MANY, SHARED = 8, 1 << 14, 10, 2
#: Pivots for ``BASE_ROWS`` vectors; a sketch's 16 bits a pivot bound their number.
PIVOTS, BASE_ROWS, MOST_PIVOTS = 2048, 10_000, 1 << 16
#: Rows read to choose pivots from, how many may be chosen, and the cosine that two of them may have at most.
SAMPLE, CHOSEN, APART = 4096, 1024, 0.7
#: Signs of a sketch. A pair at the threshold differs in more than the limit with probability 1e-8 (six deviations).
SIGNS, DEVIATIONS = 256, 6.0
#: Vectors of a list that are compared at a time, and pairs that a task looks at together.
BLOCK, PAIRS = 1024, 1 << 18
#: Vectors that are described at a time.
ROWS = 256
_BITS = 20


def pivot_count(n: int) -> int:
    """Pivots for ``n`` vectors: with the root of their number, so that lists keep their length."""
    return int(min(MOST_PIVOTS, max(64, round(PIVOTS * (n / BASE_ROWS) ** 0.5))))


def nearest_count(pivots: int) -> int:
    """Pivots that describe a vector: of pairs at 0.9, 0.93 share two of 8 among 16,384, 0.95 share two of 10 among 65,536."""
    return NEAREST if pivots <= MANY else NEAREST_OF_MANY


def choose_pivots(rows: list[list[float]], most: int, dim: int) -> np.ndarray:
    """Mutually apart directions out of ``rows``."""
    out = np.empty((most, dim), dtype=np.float32)
    n = 0
    for v in rows:
        if n == most:
            break
        x = unit(np.array([v], dtype=np.float64))[0].astype(np.float32)
        if not n or np.abs(out[:n] @ x).max() < APART:
            out[n] = x
            n += 1
    return out[:n]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component is taken out first, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


@lru_cache(maxsize=4)
def _random(dim: int, count: int, seed: int) -> np.ndarray:
    x = np.random.default_rng([dim, seed]).standard_normal((count, dim), dtype=np.float32)
    return x / np.linalg.norm(x, axis=1)[:, None]


def nearest_pivots(x: np.ndarray, pivots: list[np.ndarray], k: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, in order of their numbers; ties go to the lower number."""
    s = np.hstack([x.astype(np.float32) @ p.T for p in pivots])
    k = min(k, s.shape[1])
    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    near = np.empty((len(s), k), dtype=np.int64)
    for i in range(len(s)):
        some = np.flatnonzero(s[i] >= kth[i])
        near[i] = some if len(some) == k else np.sort(some[np.lexsort((some, -s[i][some]))][:k])
    return near


def sketch(x: np.ndarray) -> np.ndarray:
    """Signs of fixed random projections as bytes."""
    return np.packbits(x.astype(np.float32) @ _random(x.shape[1], SIGNS, 1).T > 0, axis=1)


def sign_limit(threshold: float) -> int:
    """Signs in which a pair at the threshold differs at most."""
    p = np.arccos(threshold) / np.pi
    return int(np.ceil(SIGNS * p + DEVIATIONS * (SIGNS * p * (1 - p)) ** 0.5))


def _describe(chosen: dict[int, np.ndarray], count: int):
    """Adds lists, near pivots and sketches to batches of (rep, copies, vector)."""
    nearest = nearest_count(count)
    sets = np.array(list(combinations(range(nearest), SHARED)))

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = batch.column(2)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = np.diff(vectors.offsets.to_numpy())
        ends = np.cumsum(sizes)
        near, lists, codes = ([None] * batch.num_rows for _ in range(3))
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            x = unit(flat[(ends[at] - dim)[:, None] + np.arange(dim)])
            mine = chosen.get(dim, np.empty((0, dim), dtype=np.float32))
            found = nearest_pivots(x, [mine, _random(dim, count - len(mine), 0)], nearest)
            pick = found[:, sets]
            keys = pick[..., 0] << _BITS | pick[..., 1] | dim << 2 * _BITS
            signs = sketch(x)
            for i, k in enumerate(at.tolist()):
                near[k], lists[k], codes[k] = found[i].astype("<u2").tobytes(), keys[i], signs[i].tobytes()
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(lists, type=pa.list_(pa.int64())), pa.array(near, type=pa.binary()), pa.array(codes, type=pa.binary())],
            names=["rep", "copies", "vector", "lists", "near", "code"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield describe(batch.slice(at, ROWS))

    return run


class Members:
    """Rows of whole list blocks as arrays."""

    def __init__(self, table: pa.Table):
        def whole(name: str) -> np.ndarray:
            return table.column(name).to_numpy()

        self.list, self.i, self.j, self.side, self.rep = (whole(c) for c in ("list", "i", "j", "side", "rep"))
        n = len(self.list)
        first = np.ones(n, dtype=bool)
        first[1:] = (self.list[1:] != self.list[:-1]) | (self.i[1:] != self.i[:-1]) | (self.j[1:] != self.j[:-1])
        starts = np.flatnonzero(first)
        self.after = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        self.near = np.frombuffer(b"".join(table.column("near").to_pylist()), dtype="<u2").reshape(n, -1)
        self.table = table

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs within each block, or across two, a bounded number at a time."""
        later = self.after - np.arange(len(self.list)) - 1
        total = np.cumsum(later)
        at = 0
        while at < len(later):
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
            n = later[at:to]
            a = np.repeat(np.arange(at, to), n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            across = self.i[a] != self.j[a]
            use = ~across | (self.side[a] != self.side[b])
            if use.any():
                yield a[use], b[use]
            at = to

    def own(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the list is that of a pair's first shared pivots."""
        x = self.near[a]
        both = (x[:, :, None] == self.near[b][:, None, :]).any(axis=2)
        key = self.list[a]
        ok = np.ones(len(a), dtype=bool)
        rows = np.arange(len(a))
        for k in range(SHARED):
            at = both.argmax(axis=1)
            ok &= x[rows, at] == (key >> _BITS * (SHARED - 1 - k)) & ((1 << _BITS) - 1)
            both[rows, at] = False
        return ok


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Members]:
    """Sorted rows cut between list blocks; a block is held whole, and bounded by two times ``BLOCK``."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        last = tuple(rest.column(c)[-1].as_py() for c in ("list", "i", "j"))
        differ = np.flatnonzero(
            (rest.column("list").to_numpy() != last[0]) | (rest.column("i").to_numpy() != last[1]) | (rest.column("j").to_numpy() != last[2])
        )
        cut = int(differ[-1]) + 1 if len(differ) else 0
        if cut:
            yield Members(rest.slice(0, cut))
            rest = rest.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield Members(rest)


def _candidates(threshold: float):
    """Members that have a partner of their own list which may reach the threshold."""
    limit = sign_limit(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _whole_groups(batches):
            codes = np.frombuffer(b"".join(m.table.column("code").to_pylist()), dtype=np.uint64).reshape(len(m.rep), -1)
            use = np.zeros(len(m.rep), dtype=bool)
            for a, b in m.pairs():
                close = np.bitwise_count(codes[a] ^ codes[b]).sum(axis=1, dtype=np.int64) <= limit
                a, b = a[close], b[close]
                mine = m.own(a, b)
                use[a[mine]] = use[b[mine]] = True
            if use.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[use]) for x in (m.list, m.i, m.j, m.side, m.rep)], names=["list", "i", "j", "side", "rep"]
                )

    return run


def _cosines(column: pa.ChunkedArray):
    """Cosine of pairs of rows, in double precision; rows of a pair have the same size."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    ends = np.cumsum(sizes)
    blocks = {}
    place = np.empty(len(sizes), dtype=np.int64)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        blocks[dim] = unit(flat[(ends[at] - dim)[:, None] + np.arange(dim)])
        place[at] = np.arange(len(at))

    def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a))
        for dim, x in blocks.items():
            rows = np.flatnonzero(sizes[a] == dim) if len(blocks) > 1 else np.arange(len(a))
            step = max(1, PAIRS * 16 // dim)
            for k in range(0, len(rows), step):
                r = rows[k : k + step]
                out[r] = np.einsum("ij,ij->i", x[place[a[r]]], x[place[b[r]]])
        return out

    return cosine


def _links(threshold: float):
    """Rows (rep, weight of its links, smallest member reachable) of each list block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _whole_groups(batches):
            n = len(m.rep)
            weight = m.table.column("copies").to_numpy()
            links, label = np.zeros(n, dtype=np.int64), m.rep.copy()
            ends: list[tuple[np.ndarray, np.ndarray]] = []
            cosine = _cosines(m.table.column("vector"))
            for a, b in m.pairs():
                hit = cosine(a, b) >= threshold
                a, b = a[hit], b[hit]
                mine = m.own(a, b)
                a, b = a[mine], b[mine]
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                ends.append((a, b))
            a, b = (np.concatenate(side) for side in zip(*ends, strict=True)) if ends else (np.empty(0, int),) * 2
            while len(a):
                low = np.minimum(label[a], label[b])
                before = label.copy()
                np.minimum.at(label, a, low)
                np.minimum.at(label, b, low)
                if (label == before).all():
                    break
            use = links > 0
            if use.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[use]) for c in (m.rep, links, label)], names=["rep", "links", "root"])

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    spark = vectors.sparkSession
    ship_package(spark)
    v = F.col("vector")
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>" if element == "float" else "array<double>").alias("vector"))
    sound = (
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    rows = materialize(
        rows.select("vec_id", "vector", "sound", F.when(F.col("sound"), F.xxhash64("vector")).alias("k1"), F.when(F.col("sound"), F.hash("vector")).alias("k2"))
    )
    good = rows.where("sound")
    counted = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = materialize(
        counted.join(good.select(F.col("vec_id").alias("rep"), "k1", "k2", "vector"), ["rep", "k1", "k2"])
        .dropDuplicates(["rep", "k1", "k2"])
    )
    # one id may stand for several vectors, so the index has numbers of its own
    reps = materialize(reps.withColumn("number", F.monotonically_increasing_id()), instead=reps)
    count = pivot_count(reps.count())
    picked = hash_sample(reps, ["k1", "k2"], SAMPLE, "pivots").select("vector").collect()
    dims = {len(r["vector"]) for r in picked}
    chosen = {d: choose_pivots([r["vector"] for r in picked if len(r["vector"]) == d], min(CHOSEN, count // 2), d) for d in dims}
    vector = f"array<{'float' if element == 'float' else 'double'}>"
    described = materialize(
        reps.select(F.col("number").alias("rep"), "copies", "vector")
        .mapInArrow(_describe(chosen, count), f"rep bigint, copies bigint, vector {vector}, lists array<bigint>, near binary, code binary")
    )
    postings = described.select("rep", F.explode("lists").alias("list"))
    lists = postings.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    member = postings.join(lists, "list").withColumn("blocks", F.expr(f"cast(ceil(n / {BLOCK}) as int)"))
    member = member.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    facing = member.select("list", "rep", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("facing"))
    dealt = facing.select(
        "list", F.least("own", "facing").alias("i"), F.greatest("own", "facing").alias("j"),
        (F.col("own") > F.col("facing")).cast("int").alias("side"), "rep",
    )

    def meet(rows: DataFrame, *what: str) -> DataFrame:
        met = rows.join(described.select("rep", *what), "rep").repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
        return met.select("list", "i", "j", "side", "rep", *what)

    near = materialize(meet(dealt, "near", "code").mapInArrow(_candidates(threshold), "list bigint, i int, j int, side int, rep bigint"))
    found = materialize(meet(near, "near", "copies", "vector").mapInArrow(_links(threshold), "rep bigint, links bigint, root bigint"))
    joined = connected_components(found.select("rep", "root").distinct(), "rep", "root")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (
        reps.select("k1", "k2", "copies", F.col("rep").alias("vec"), F.col("number").alias("rep"))
        .join(links, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
        .select("k1", "k2", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    known = materialize(known)
    release(described, near, found, reps)
    smallest = known.groupBy("component").agg(F.min("vec").alias("component_id"))
    known = known.join(smallest, "component").select("k1", "k2", "n_links", "component_id")
    return rows.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
