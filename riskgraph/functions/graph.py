"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.cluster import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every node of ``edges``; component is its smallest node.

    Both sides of an edge count alike; null ends and loops are ignored. Each
    round keeps at most as many edges as came in: a node's neighbours are
    re-pointed to the smallest one, so hubs become partial aggregates and
    equi-joins that AQE can split, never a group held by one task.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    e = materialize(e)
    seen = _fingerprint(e)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: neighbours above u point to the smallest of u's closed neighbourhood
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where("u != v").distinct()
        # small-star: u and its lower neighbours point to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        e = materialize(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), instead=e)
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
