"""Phase 5: confidence of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.config import ConfidenceConfig
from riskgraph.functions.scalar import clamp, diversity, frequency, recency, uniform, whole_days
from riskgraph.operators.links import symmetric


def neighbour_jaccard(edges: DataFrame) -> DataFrame:
    """``src, dst, jaccard`` of the ends' undirected neighbour sets.

    Common neighbours are counted by joining on them; sets are never gathered. Tables of
    edges are small when compressed, so hints keep them from being broadcast.
    """
    near = symmetric(edges).distinct()
    size = near.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d"))
    pairs = edges.select("src", "dst").distinct()
    left = pairs.join(near.select(F.col("src"), F.col("dst").alias("w")).hint("merge"), "src")
    common = left.join(near.select(F.col("src").alias("dst"), F.col("dst").alias("w")).hint("merge"), ["dst", "w"], "left_semi")
    common = common.groupBy("src", "dst").agg(F.count("*").alias("common"))
    sized = (
        pairs.join(size.select(F.col("v").alias("src"), F.col("d").alias("da")), "src")
        .join(size.select(F.col("v").alias("dst"), F.col("d").alias("db")), "dst").join(common.hint("merge"), ["src", "dst"], "left")
    )
    both = F.coalesce("common", F.lit(0))
    return sized.select("src", "dst", F.coalesce(F.try_divide(both.cast("double"), F.col("da") + F.col("db") - both), F.lit(0.0)).alias("jaccard"))


def link_confidence(edges: DataFrame, facts: DataFrame, as_of: str, cfg: ConfidenceConfig | None = None) -> DataFrame:
    """``score_confiance`` of each edge from its events.

    ``facts`` has one row per (src, dst): ``n``, ``last_seen``, ``kinds``,
    ``corroboration`` and, if known, ``whitelisted``.
    """
    cfg = cfg or ConfidenceConfig()
    j = edges.select("src", "dst").distinct().join(facts.hint("merge"), ["src", "dst"], "left").join(neighbour_jaccard(edges).hint("merge"), ["src", "dst"], "left")
    days = F.coalesce(whole_days(F.to_timestamp(F.lit(as_of)), F.col("last_seen")), F.lit(0))
    score = (
        cfg.frequency * frequency(F.coalesce("n", F.lit(0))) + cfg.recency * recency(days, cfg.decay_per_day)
        + cfg.diversity * diversity(F.coalesce("kinds", F.array().cast("array<string>")), cfg.proof_types)
        + cfg.jaccard * F.coalesce("jaccard", F.lit(0.0)) + cfg.corroboration * clamp(F.coalesce("corroboration", F.lit(0.0)))
    )
    if "whitelisted" in facts.columns:
        score = F.when(F.col("whitelisted"), score * cfg.whitelist_factor).otherwise(score)
    return j.select("src", "dst", F.round(clamp(score), 6).alias("score_confiance"))


def event_facts(events: DataFrame) -> DataFrame:
    """What events say about each (source, target)."""
    return events.groupBy(F.col("id_entite_source").alias("src"), F.col("id_entite_cible").alias("dst")).agg(
        F.count("*").alias("n"), F.max("horodatage").alias("last_seen"), F.collect_set("type_evenement").alias("kinds"),
        F.avg("score_corroboration").alias("corroboration"),
    )


def null_model(spark: SparkSession, observed: float, seed: int = 0, cfg: ConfidenceConfig | None = None) -> DataFrame:
    """How far a confidence lies from that of random links: z-score, skewness and the verdict."""
    cfg = cfg or ConfidenceConfig()

    def u(name: str):
        return uniform(seed, name, "id")

    draw = (
        cfg.frequency * frequency(F.floor(u("n") * 100) + 1) + cfg.recency * recency(F.floor(u("days") * 365), cfg.decay_per_day)
        + cfg.diversity * (F.floor(u("kinds") * cfg.proof_types) + 1) / cfg.proof_types + cfg.corroboration * u("corroboration")
    )
    s = spark.range(cfg.null_draws).select(draw.alias("x")).agg(
        F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(1e-9)).alias("std"), F.skewness("x").alias("skewness")
    )
    z = (F.lit(observed) - F.col("mean")) / F.col("std")
    return s.select(
        F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("skewness", 6).alias("skewness"),
        F.round(z, 6).alias("z"), (z > cfg.z_limit).alias("significant"), (F.abs("skewness") > cfg.skew_limit).alias("skewed"),
    )
