"""Phase 7: features, isolation forest, neighbour propagation, decision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.config import ScoringConfig
from riskgraph.functions.cluster import ship_package
from riskgraph.functions.scalar import clamp, whole_days

#: The feature vector in order.
FEATURES = (
    "pagerank", "degre_entrant", "degre_sortant", "confiance_moy", "cohesion", "synthetique", "nb_flags", "montant_moyen",
    "montant_std", "nb_communautes", "anciennete", "nb_fusions", "pagerank_com", "ratio_inactifs", "nb_hubs", "corroboration",
)


def features(
    vertices: DataFrame, edges: DataFrame, *, ranks: DataFrame, members: DataFrame, cohesions: DataFrame, hub_flags: DataFrame,
    events: DataFrame, as_of: str, synthetic: DataFrame | None = None, merges: DataFrame | None = None,
) -> DataFrame:
    """The sixteen features of each vertex ``id``.

    Every side is aggregated by vertex before it is joined, so joins never fan out.
    ``edges`` has ``src, dst, score_confiance, inactif``; ``events`` carries flags. Values
    are rounded to six digits, halves up whatever order a mean was added up in.
    """
    out = edges.groupBy(F.col("src").alias("id")).agg(
        F.count("*").alias("degre_sortant"), F.avg(F.coalesce("score_confiance", F.lit(0.0))).alias("confiance_moy"),
        (F.count_if("inactif") / F.count("*")).alias("ratio_inactifs"),
    )
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degre_entrant"))
    near = edges.select(F.col("src").alias("id"), F.col("dst").alias("n")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("n"))).distinct()
    hubs = near.join(hub_flags.where("est_hub").select(F.col("id").alias("n")), "n", "left_semi").groupBy("id").agg(F.count("*").alias("nb_hubs"))
    acts = events.groupBy(F.col("id_entite_source").alias("id")).agg(
        F.avg("montant").alias("montant_moyen"), F.stddev_pop("montant").alias("montant_std"),
        F.sum(F.array_size("flags_semantiques")).alias("nb_flags"), F.min("horodatage").alias("first_seen"),
        F.avg("score_corroboration").alias("corroboration"),
    )
    community = members.join(ranks, "id", "left").groupBy("id_communaute").agg(F.avg(F.coalesce("rank", F.lit(0.0))).alias("pagerank_com"))
    joined = (
        vertices.select("id").join(ranks.withColumnRenamed("rank", "pagerank"), "id", "left").join(out, "id", "left").join(into, "id", "left")
        .join(members, "id", "left").join(cohesions.select("id_communaute", "cohesion"), "id_communaute", "left")
        .join(community, "id_communaute", "left").join(hubs, "id", "left").join(acts, "id", "left")
    )
    joined = joined.join(synthetic.select("id", F.lit(1.0).alias("synthetique")), "id", "left") if synthetic is not None else joined.withColumn("synthetique", F.lit(0.0))
    joined = joined.join(merges, "id", "left") if merges is not None else joined.withColumn("nb_fusions", F.lit(0))
    joined = joined.withColumn("nb_communautes", F.lit(1)).withColumn("anciennete", whole_days(F.to_timestamp(F.lit(as_of)), F.col("first_seen")))
    default = {"corroboration": 0.5}
    return joined.select("id", *(F.round(F.coalesce(F.col(c).cast("double"), F.lit(default.get(c, 0.0))) + 1e-10, 6).alias(c) for c in FEATURES))


def propagate(vertices: DataFrame, edges: DataFrame, cfg: ScoringConfig | None = None) -> DataFrame:
    """``id, score_gnn``: own risk mixed over layers with the weighted mean of out-neighbours.

    The mean is the same in each layer, so layers close to own·2^-k + mean·(1-2^-k).
    A vertex without neighbours meets one of default risk, as an outer match gives it.
    """
    cfg = cfg or ScoringConfig()
    risk = vertices.select(F.col("id").alias("dst"), F.coalesce("risk", F.lit(cfg.default_risk)).alias("r"))
    w = F.coalesce("score_confiance", F.lit(cfg.default_confidence))
    mean = edges.join(risk.hint("shuffle_hash"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(w * F.col("r")).alias("num"), F.sum(w).alias("den"))
    own = F.coalesce("risk", F.lit(cfg.default_risk))
    m = F.when(F.col("den").isNull(), F.lit(cfg.default_risk)).when(F.col("den") > 0, F.col("num") / F.col("den"))
    keep = 2.0**-cfg.layers
    score = F.when(m.isNull(), own).otherwise(own * keep + m * (1 - keep))
    return vertices.join(mean, "id", "left").select("id", F.round(clamp(score), 6).alias("score_gnn"))


def decide(score: Column, cfg: ScoringConfig | None = None, threshold: float | None = None) -> Column:
    """The decision of least expected cost, or by a calibrated threshold."""
    t = (cfg or ScoringConfig()).threshold if threshold is None else threshold
    return F.when(score >= F.lit(t), "FRAUDE_SUSPECTEE").otherwise("NORMAL")


def heuristic(feature: DataFrame, scaled: bool = True) -> DataFrame:
    """Stand-in for the forest: synthetic flag, flags and mean amount, over three, at most 1.

    Raw amounts drown the rest, so by default flags and amounts are divided by their maximum.
    """
    if not scaled:
        return feature.select("id", F.least(F.lit(1.0), (F.col("synthetique") + F.col("nb_flags") + F.col("montant_moyen")) / 3).alias("score_if"))
    top = feature.agg(F.max("nb_flags").alias("mf"), F.max("montant_moyen").alias("mm"))  # one row
    s = F.col("synthetique") + F.coalesce(F.try_divide(F.col("nb_flags"), F.col("mf")), F.lit(0.0)) + F.coalesce(F.try_divide(F.col("montant_moyen"), F.col("mm")), F.lit(0.0))
    return feature.crossJoin(F.broadcast(top)).select("id", F.round(F.least(F.lit(1.0), s / 3), 6).alias("score_if"))


def composite(vertices: DataFrame, forest: DataFrame, spread: DataFrame, cfg: ScoringConfig | None = None, threshold: float | None = None) -> DataFrame:
    """``id, score_risque, decision_fraude`` of all vertices at once, from the same snapshot."""
    cfg = cfg or ScoringConfig()
    score = cfg.weight_forest * F.coalesce("score_if", F.lit(0.5)) + cfg.weight_propagation * F.coalesce("score_gnn", F.lit(cfg.default_risk))
    j = vertices.select("id").join(forest, "id", "left").join(spread, "id", "left").withColumn("score_risque", F.round(score, 6))
    return j.select("id", "score_risque", decide(F.col("score_risque"), cfg, threshold).alias("decision_fraude"))


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, int]]:
    """Nodes (feature or -1, cut, left, right, depth) of one isolation tree over ``x``."""
    nodes: list[tuple[int, float, int, int, int]] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            f, c, left, right, d = nodes[parent]
            nodes[parent] = (f, c, at if side == 0 else left, at if side == 1 else right, d)
        f = int(rng.integers(x.shape[1]))
        low, high = (x[rows, f].min(), x[rows, f].max()) if len(rows) else (0.0, 0.0)
        if len(rows) <= 1 or depth >= limit or low == high:
            nodes.append((-1, 0.0, -1, -1, depth))
            continue
        cut = float(rng.uniform(low, high))
        nodes.append((f, cut, -1, -1, depth))
        below = x[rows, f] < cut
        todo += [(rows[~below], depth + 1, at, 1), (rows[below], depth + 1, at, 0)]
    return nodes


def mean_depth(n: int) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_scores(vectors: DataFrame, key: str, columns: list[str], cfg: ScoringConfig | None = None, seed: int = 0) -> DataFrame:
    """``id, score_if`` by a forest trained once on a bounded sample (``cfg.sample`` rows, by hash of the key)."""
    cfg = cfg or ScoringConfig()
    ship_package(vectors.sparkSession)
    picked = vectors.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(cfg.sample).select(*columns).collect()
    x = np.array([[float(v or 0) for v in r] for r in picked], dtype=float).reshape(len(picked), len(columns))
    if len(x) < 2:
        return vectors.select(F.col(key).alias("id"), F.lit(0.5).alias("score_if"))
    limit = int(np.ceil(np.log2(len(x))))
    trees = [np.array(grow_tree(x, np.random.default_rng([seed, t]), limit)) for t in range(cfg.trees)]
    scale = mean_depth(len(x))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            v = np.column_stack([c.fillna(0).to_numpy(dtype=float) for c in cols])
            total = np.zeros(len(v))
            for t in trees:
                at = np.zeros(len(v), dtype=int)
                while (inner := t[at, 0] >= 0).any():
                    rows = np.flatnonzero(inner)
                    node = t[at[rows]]
                    left = v[rows, node[:, 0].astype(int)] < node[:, 1]
                    at[rows] = np.where(left, node[:, 2], node[:, 3]).astype(int)
                total += t[at, 4]
            yield pd.Series(np.round(2.0 ** (-(total / len(trees)) / scale), 6))

    return vectors.select(F.col(key).alias("id"), score(*(F.col(c).cast("double") for c in columns)).alias("score_if"))
