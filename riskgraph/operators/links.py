"""Phase 3: causal links, shared-attribute links, expiry of links."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.config import GraphConfig, ResolutionConfig
from riskgraph.functions.cluster import materialize
from riskgraph.functions.pairs import expand


def causal_links(events: DataFrame, cfg: GraphConfig | None = None) -> DataFrame:
    """Pairs (cause, effect) within the causal window that follow a pattern and share an entity.

    An interval join: the cause offers both its entities as keys and the time
    buckets that its window reaches, an effect has one entity and one bucket, so a
    pair meets exactly once per key and a busy entity is cut up by time. Missing
    entities match each other; ties in time follow arrival.
    """
    cfg = cfg or GraphConfig()
    span = cfg.causal_hours * 3600 * 1_000_000
    e = events.select(
        "seq", "type_evenement", F.unix_micros("horodatage").alias("t"), "id_entite_source", "id_entite_cible"
    ).where("t is not null")
    bucket = F.expr(f"t div {span}")
    causes, effects = sorted({a for a, _ in cfg.causal_patterns}), sorted({b for _, b in cfg.causal_patterns})
    cause = (
        e.where(F.col("type_evenement").isin(*causes))
        .withColumn("key", F.explode(F.array_distinct(F.array("id_entite_source", "id_entite_cible"))))
        .withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
        .select(F.col("seq").alias("cause"), F.col("type_evenement").alias("cause_type"), F.col("t").alias("cause_t"), "key", "bucket")
    )
    effect = e.where(F.col("type_evenement").isin(*effects)).select(
        F.col("seq").alias("effect"), F.col("type_evenement").alias("effect_type"), F.col("t").alias("effect_t"),
        F.col("id_entite_source").alias("effect_key"), bucket.alias("effect_bucket"),
    )
    patterns = F.struct("cause_type", "effect_type").isin(*(F.struct(F.lit(a), F.lit(b)) for a, b in cfg.causal_patterns))
    later = (F.col("effect_t") > F.col("cause_t")) | ((F.col("effect_t") == F.col("cause_t")) & (F.col("effect") > F.col("cause")))
    met = cause.join(
        effect,
        F.col("key").eqNullSafe(F.col("effect_key")) & (F.col("bucket") == F.col("effect_bucket"))
        & later & (F.col("effect_t") - F.col("cause_t") <= span) & patterns,
    )
    return met.select(
        "cause", "effect", "cause_type", "effect_type", ((F.col("effect_t") - F.col("cause_t")) / 1e6).alias("delta_secondes")
    )


def mark_inactive(links: DataFrame, date_col: str, as_of: str, cfg: GraphConfig | None = None) -> DataFrame:
    """``inactif`` set where a link is older than the limit and carries no mark yet."""
    cfg = cfg or GraphConfig()
    old = F.col(date_col).cast("timestamp") < F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(cfg.inactive_days))
    if "inactif" not in links.columns:
        return links.withColumn("inactif", old)
    return links.withColumn("inactif", F.when(old & F.col("inactif").isNull(), True).otherwise(F.col("inactif")))


def shared_attribute_groups(entities: DataFrame, key: str, attributes: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(id, line)`` of entities without missing attributes, and ``(line, group_size)`` of groups of two or more equal ones."""
    e = entities.select(F.col(key).alias("id"), *attributes).dropna(subset=attributes)
    sizes = e.groupBy(*attributes).agg(F.count("*").alias("group_size")).where("group_size > 1")
    sizes = materialize(sizes.withColumn("line", F.monotonically_increasing_id()))
    return e.join(sizes, attributes).select("id", "line"), sizes.select("line", "group_size")


def shared_attribute_pairs(entities: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Ordered pairs of entities with equal attributes; the group's size comes along for a caller's limits."""
    members, sizes = shared_attribute_groups(entities, key, attributes)
    found = expand(sizes.select(F.col("line").alias("a"), F.col("line").alias("b"), "group_size"), members)
    return found.select(F.col("first").alias("src"), F.col("second").alias("dst"), "group_size")


def synthetic_identities(
    entities: DataFrame, key: str, attributes: list[str], created: str | None, as_of: str | None, cfg: ResolutionConfig | None = None
) -> DataFrame:
    """Entities that share any attribute with enough recent others.

    Others are counted without pairing them: by inclusion and exclusion over the sets
    of attributes, each of which takes one grouping, so a value that many share costs
    no more than its rows.
    """
    cfg = cfg or ResolutionConfig()
    recent = F.lit(True)
    if created and as_of:
        recent = F.coalesce(F.col(created) >= F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(cfg.synthetic_days)), F.lit(False))
    e = entities.select(F.col(key).alias("id"), *(F.col(a).alias(f"_{i}") for i, a in enumerate(attributes)), recent.cast("int").alias("_recent"))
    parts = None
    for size in range(1, len(attributes) + 1):
        for some in combinations(range(len(attributes)), size):
            by = [f"_{i}" for i in some]
            there = e.dropna(subset=by)
            met = there.groupBy(*by).agg(F.sum("_recent").alias("_n")).where("_n > 0")
            others = there.join(met, by).select("id", ((F.col("_n") - F.col("_recent")) * (-1) ** (size - 1)).alias("n"))
            parts = others if parts is None else parts.unionByName(others)
    return parts.groupBy("id").agg(F.sum("n").alias("n_recent")).where(F.col("n_recent") >= cfg.synthetic_min)


def symmetric(edges: DataFrame, *extra: str) -> DataFrame:
    """Both directions of each edge; parallel edges stay."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *extra)
    return edges.select("src", "dst", *extra).unionByName(back)
