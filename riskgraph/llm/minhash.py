"""Near-duplicates by DartMinHash signatures and banded joining.

A text is a weighted set: its five-word shingles with their counts. Every shingle
owns a strip as wide as its count, on which hashed darts land; a dart's position
along the strip decides whether it counts, its height is its rank, and its hash
names a coordinate. The earliest dart of each coordinate is the signature, and two
texts agree on a coordinate with the probability of their weighted Jaccard
similarity. Darts are thrown only up to the height at which all coordinates are
filled, so the work follows the text's length, not length times coordinates.

Equal texts are first collapsed into one representative. Representatives that
share a band are compared: all pairs in small buckets, in large ones everyone with
the bucket's first member. Members of a large bucket that are then still in
different components are compared block by block: pairs whose sizes alone rule out
the threshold go, and long signatures let through the rest down to ``PASS``, five
deviations below it, so that a pair at 0.8 falls below with probability 3e-7, less
than banding loses. Every pair that remains is verified on whole shingle sets; links
are closed into components.

Defined cases: null ids are ignored for linking and stay alone (class null, kept);
a null text counts as empty; texts without a word link with nothing; texts of fewer
than five words have one shingle; words are split at white space and lower-cased;
rows that repeat a doc_id are one document and get one row; further columns are
ignored. The class id is the smallest doc_id reachable by links.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import cache, partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.cluster import materialize, release, ship_package
from riskgraph.functions.graph import connected_components
from riskgraph.llm.rows import map_rows

SHINGLE = 5
#: Bands of so many coordinates: a pair at 0.8 is missed with probability 3e-6.
BANDS, ROWS = 32, 5
THRESHOLD = 0.8
#: Buckets up to this size compare all pairs; larger ones go through their first member.
SMALL = 8
#: Coordinates (one byte each) of the long signatures, the agreement they ask for, and members per block.
LONG, PASS, BLOCK = 2048, 0.756, 512
#: Agreement of the codes' lowest bits that comes first: a pair at 0.8 agrees in 0.9 of them, five deviations higher.
PASS_BITS = 0.867
#: Bits of the filter on documents whose shingles are needed; it takes 1 MB whatever the input.
FILTER_BITS = 1 << 23
#: Heights at which cells of darts end; fixed, so that all texts share the darts. Further cells double the height.
CELLS = [0.0, *(2.0**e for e in range(-4, 13, 2))]
WORDS_KNOWN = 200_000
_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of counts, up to where nothing is left."""
    logs, n, out, total = -mean, 0, [], 0.0
    while total < 1 - 1e-15 and n < mean + 40 * (mean**0.5 + 1):
        total += float(np.exp(logs))
        out.append(total)
        n += 1
        logs += np.log(mean) - np.log(n)
    return np.array(out)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= WORDS_KNOWN:
            self.clear()
        self[word] = h
        return h


_words = _WordHashes()


@cache
def _cell(i: int) -> tuple[np.uint64, np.ndarray]:
    """The seed of a cell of heights, and the cumulative probabilities of its darts per shingle."""
    last = len(CELLS) - 2
    width = CELLS[i + 1] - CELLS[i] if i <= last else CELLS[-1] * 2.0 ** (i - last - 1)
    return np.uint64((0x9E3779B97F4A7C15 * (i + 1)) % 2**64), _poisson(width)


def strips(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's shingles; the j-th occurrence of a shingle has its own, so this is a weighted set."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.array([_words[w] for w in words], dtype=np.uint64)
    k = min(SHINGLE, len(h))
    s = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for j in range(k):
        s = mix(s * _G + h[j : len(h) - k + 1 + j])
    s.sort()
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    nth = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    if nth.any():
        s = np.where(nth > 0, mix(s + _G * nth.astype(np.uint64)), s)
        s.sort()
    return s


def signature(elements: np.ndarray, k: int) -> np.ndarray:
    """The hash of the earliest dart for each of ``k`` coordinates."""
    if not len(elements):
        raise ValueError("no shingle throws a dart")
    out, empty = np.zeros(k, dtype=np.uint64), np.ones(k, dtype=bool)
    for c in itertools.count():
        salt, cdf = _cell(c)
        seed = mix(elements + salt)
        n = np.searchsorted(cdf, _unit(seed), side="right")
        total = int(n.sum())
        if not total:
            continue
        of = np.repeat(seed, n)
        nth = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(of ^ mix(nth.astype(np.uint64) + _G))
        at = (dart % np.uint64(k)).astype(np.int64)
        rank = _unit(mix(dart + _G))
        use = empty[at]
        dart, at, rank = dart[use], at[use], rank[use]
        order = np.lexsort((dart, rank, at))
        at = at[order]
        first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.empty(0, dtype=bool)
        out[at[first]] = dart[order][first]
        empty[at[first]] = False
        if not empty.any():
            break
    return out


def band_hashes(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    grid = sig.reshape(-1, rows)
    h = np.zeros(len(grid), dtype=np.uint64)
    for j in range(rows):
        h = mix(h * _G + grid[:, j])
    return h.view(np.int64)


def sign(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, k1, k2, bands``: digest of the shingle set and band hashes; null where a text has no word."""

    def factory():
        def one(i, text):
            s = strips(text)
            if i is None or not len(s):
                return i, None, None, None
            d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            return (
                i, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True),
                band_hashes(signature(s, bands * rows), rows).tolist(),
            )

        return one

    return map_rows(docs, [id_col, text_col], factory, "doc_id bigint, k1 bigint, k2 bigint, bands array<bigint>")


def restrict(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` of the documents in ``ids``.

    A bitmap of hashed ids, at most 256 rows of 4 KB, is broadcast and drops most
    other documents while scanning, so their texts aren't shuffled; an exact join
    with the distinct ids follows (a semi-join would be moved below the filter).
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    maps = (
        ids.select(place.alias("h")).groupBy(F.expr("cast(h div 32768 as int)").alias("page"))
        .agg(F.bitmap_construct_agg(F.expr("h % 32768")).alias("bits"))
    )
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", place)
    some = some.withColumn("page", F.expr("cast(h div 32768 as int)")).join(F.broadcast(maps), "page")
    byte = F.expr("cast(conv(hex(substring(bits, cast((h % 32768) div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.expr("cast(h % 8 as int)")
    some = some.where(F.getbit(byte, hit) == 1).select("doc_id", "text")
    return some.join(ids.distinct(), "doc_id")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole shingle sets of some documents."""

    def factory():
        return lambda i, text: (i, strips(text).view(np.int64).tolist())

    return map_rows(restrict(docs, ids, id_col, text_col), ["doc_id", "text"], factory, "doc_id bigint, shingles array<bigint>")


def _long_signatures(sets: DataFrame, ids: DataFrame) -> DataFrame:
    def factory():
        def one(i, shingles):
            s = np.array(shingles, dtype=np.int64).view(np.uint64)
            # upper bits: the lower ones name the coordinate
            return i, len(s), (signature(s, LONG) >> np.uint64(56)).astype(np.uint8).tobytes()

        return one

    return map_rows(sets.join(ids, "doc_id", "left_semi"), ["doc_id", "shingles"], factory, "rep bigint, size bigint, codes binary")


def _compare_blocks(batches, threshold: float):
    """Pairs of one block pair after another (rows come sorted by it) that agree enough and lie apart."""
    import pyarrow as pa

    schema = pa.schema([("member", pa.int64()), ("center", pa.int64())])

    def finish(key, rows):
        a = [r for r in rows if not r["side"]]
        b = [r for r in rows if r["side"]] if key[1] != key[2] else a
        if not a or not b:
            return
        def matrix(rows):
            return np.frombuffer(b"".join(r["codes"] for r in rows), dtype=np.uint8).reshape(len(rows), LONG)

        x, y = matrix(a), matrix(b)
        xs, ys = (np.packbits(m & 1, axis=1).view(np.uint64) for m in (x, y))
        comp_a, comp_b = (np.array([r["component"] for r in rows]) for rows in (a, b))
        size_a, size_b = (np.array([r["size"] for r in rows], dtype=float) for rows in (a, b))
        for at in range(len(a)):
            apart = (comp_b != comp_a[at]) & (np.minimum(size_b, size_a[at]) >= threshold * np.maximum(size_b, size_a[at]))
            some = np.flatnonzero(apart)
            some = some[np.bitwise_count(ys[some] ^ xs[at]).sum(axis=1, dtype=np.int64) <= (1 - PASS_BITS) * LONG]
            if b is a:
                some = some[some > at]
            if not len(some):
                continue
            some = some[np.count_nonzero(y[some] == x[at], axis=1) >= PASS * LONG]
            mine = set(a[at]["keys"]) if len(some) else ()
            for k in some:
                # a pair that meets in several buckets is taken in the lowest of them
                if min(mine.intersection(b[k]["keys"])) == key[0]:
                    i, j = a[at]["rep"], b[k]["rep"]
                    yield max(i, j), min(i, j)

    now, rows, out = None, [], []
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["key"], r["i"], r["j"])
            if key != now:
                out += finish(now, rows) if now else ()
                now, rows = key, []
            rows.append(r)
        if len(out) > 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], schema=schema)
            out = []
    out += finish(now, rows) if now else ()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], schema=schema)


def _leftover_pairs(shared: DataFrame, joined: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of large buckets that the comparison with the first member left in different components."""
    large = (
        shared.where(F.col("n") > SMALL)
        .join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select("key", "rep", "n", F.coalesce("component", "rep").alias("component"), (F.col("rep") == F.col("first")).alias("is_first"))
        .where("not is_first")
    )
    mixed = large.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    apart = materialize(large.join(mixed, "key", "left_semi"))
    known = apart.groupBy("rep").agg(F.sort_array(F.collect_set("key")).alias("keys"))  # at most one per band
    codes = _long_signatures(sets, apart.select(F.col("rep").alias("doc_id")).distinct())
    members = codes.join(known, "rep")
    blocks = F.expr(f"cast(ceil(n / {BLOCK}) as int)")
    dealt = (
        apart.withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .select("key", "rep", "component", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("facing"))
        .select(
            "key", "rep", "component", F.least("own", "facing").alias("i"), F.greatest("own", "facing").alias("j"),
            (F.col("own") > F.col("facing")).alias("side"),
        )
        .join(members, "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    )
    return dealt.select("key", "i", "j", "side", "rep", "component", "size", "codes", "keys").mapInArrow(
        partial(_compare_blocks, threshold=threshold), "member bigint, center bigint"
    )


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``member, center, sim`` of each pair.

    The member's set moves first and once per pair; the center's, which many pairs
    may share, joins last, where only its own side of the join repeats it.
    """

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("member", pa.int64()), ("center", pa.int64()), ("sim", pa.float64())])
        for batch in batches:
            # sets stay Arrow buffers: as Python lists, long texts would take several times the room
            a, b = batch.column("a"), batch.column("b")
            sims = []
            for i in range(batch.num_rows):
                x = a[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                y = b[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                sims.append(both / max(1, len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("member"), batch.column("center"), pa.array(sims, type=pa.float64())], schema=schema)

    ship_package(pairs.sparkSession)
    joined = pairs.join(sets.select(F.col("doc_id").alias("member"), F.col("shingles").alias("a")), "member")
    joined = joined.join(sets.select(F.col("doc_id").alias("center"), F.col("shingles").alias("b")), "center")
    return joined.select("member", "center", "a", "b").mapInArrow(run, "member bigint, center bigint, sim double")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, class_id, kept`` with one row per document; ``kept`` marks the smallest id of a class."""
    signed = materialize(sign(docs, id_col, text_col))
    reps = signed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    reps = materialize(reps)
    bands = (
        signed.where("k1 is not null")
        .join(reps.select(F.col("rep").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi")
        .select(F.col("doc_id").alias("rep"), F.posexplode("bands").alias("band", "hash"))
    )
    postings = bands.select("rep", F.xxhash64("band", "hash").alias("key"))
    buckets = postings.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("first")).where("n > 1")
    shared = materialize(postings.join(buckets, "key").distinct())
    star = shared.where("rep <> first").select(F.col("rep").alias("member"), F.col("first").alias("center"))
    little = shared.where(F.col("n").between(3, SMALL)).select("key", "rep", "first").where("rep <> first")
    inside = little.join(little.select("key", F.col("rep").alias("center")), "key").where("rep > center")
    pairs = materialize(star.unionByName(inside.select(F.col("rep").alias("member"), "center")).distinct())
    ids = pairs.select(F.col("member").alias("doc_id")).unionByName(pairs.select(F.col("center").alias("doc_id"))).distinct()
    sets = materialize(_sets(docs, ids, id_col, text_col))
    compared = materialize(verify(pairs, sets))
    links = compared.where(F.col("sim") >= threshold).select("member", "center")
    joined = connected_components(links, "member", "center")

    later = materialize(_leftover_pairs(shared, joined, sets, threshold).distinct())
    if later.limit(1).count():
        more = verify(later, sets).where(F.col("sim") >= threshold).select("member", "center")
        joined = connected_components(links.unionByName(more), "member", "center")
    release(shared, pairs, sets, compared, later)  # what follows reads signatures, representatives and components

    classes = (
        reps.join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select("k1", "k2", F.coalesce("component", "rep").alias("class_id"))
    )
    out = signed.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"], "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    alone = out.where("doc_id is null").select("doc_id", "class_id")
    out = out.where("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("class_id")).unionByName(alone)
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))
