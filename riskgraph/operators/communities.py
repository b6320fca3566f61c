"""Phase 6: communities, cohesion, cores, evolution, modularity."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.config import CommunityConfig
from riskgraph.functions.cluster import materialize, ship_package
from riskgraph.functions.order import with_position
from riskgraph.operators.links import symmetric
from riskgraph.operators.topology import components


#: Digits to which weights are added up, so that no order of adding decides a tie.
DIGITS = 9


def local_moves(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy moves within one component, vertices in order of id, until none moves.

    A vertex joins the neighbouring community with the largest incident weight if
    that is strictly more than the weight to its own; ties go to the smaller label.
    Every move raises the weight inside communities, so the moves end.
    """
    near: dict[int, list[tuple[int, float]]] = {}
    for s, d, w in zip(pdf["src"], pdf["dst"], pdf["weight"], strict=True):
        near.setdefault(s, []).append((d, w))
        near.setdefault(d, []).append((s, w))
    label = {v: v for v in near}
    order, moved = sorted(near), True
    while moved:
        moved = False
        for v in order:
            parts: dict[int, list[float]] = {}
            for u, w in near[v]:
                parts.setdefault(label[u], []).append(w)
            weight = {c: round(math.fsum(ws), DIGITS) for c, ws in parts.items()}
            best = min(weight, key=lambda c: (-weight[c], c))
            if weight[best] > weight.get(label[v], 0.0):
                label[v], moved = best, True
    return pd.DataFrame({"id": list(label), "label": list(label.values())})


def wave_moves(edges: DataFrame) -> DataFrame:
    """The very same moves over a component of any size, many vertices at a time.

    In a pass in order of id a vertex sees the new labels of its smaller neighbours and
    the old ones of its larger ones, so it may move as soon as its smaller neighbours
    have had their turn. Each round moves all such vertices at once; a pass takes as many
    rounds as its longest path of growing ids, whose number ``depth`` counts beforehand.
    """
    both = materialize(symmetric(edges, "weight"))
    smaller = both.where("dst < src").select("src", "dst").distinct()
    turn = materialize(both.select(F.col("src").alias("id")).distinct().withColumn("turn", F.lit(0)))
    grown = True
    while grown:  # a vertex's turn comes after those of its smaller neighbours
        late = smaller.join(turn.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg((F.max("turn") + 1).alias("late"))
        new = turn.join(late, "id", "left").select("id", F.greatest("turn", F.coalesce("late", F.lit(0))).alias("turn"), (F.coalesce("late", F.lit(0)) > F.col("turn")).alias("grew"))
        new = materialize(new)
        grown = new.where("grew").limit(1).count() > 0
        turn = materialize(new.select("id", "turn"), instead=turn)
    depth = turn.agg(F.max("turn")).first()[0] or 0
    by_turn = materialize(both.join(turn.withColumnRenamed("id", "src"), "src"))
    label = materialize(turn.select("id", F.col("id").alias("label")))
    moved = True
    while moved:
        moved = False
        for k in range(depth + 1):
            mine = by_turn.where(F.col("turn") == k)
            at = mine.join(label.select(F.col("id").alias("dst"), F.col("label").alias("c")), "dst")
            weight = at.groupBy(F.col("src").alias("id"), "c").agg(F.round(F.sum("weight"), DIGITS).alias("w"))
            best = weight.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), "c")).alias("b"))
            held = weight.select("id", F.col("c").alias("label"), F.col("w").alias("held"))
            some = best.join(label, "id").join(held, ["id", "label"], "left").where(-F.col("b.w") > F.coalesce("held", F.lit(0.0)))
            some = materialize(some.select("id", F.col("b.c").alias("to")))
            if some.limit(1).count():
                moved = True
                new = label.join(some, "id", "left").select("id", F.coalesce("to", "label").alias("label"))
                label = materialize(new, instead=label)
    return label


def detect(edges: DataFrame, largest_local: int = 200_000) -> DataFrame:
    """``id, id_communaute`` by greedy weighted moves from singletons, numbered densely.

    Components up to ``largest_local`` edges are solved one per group; larger ones move
    by waves, so no task holds a giant component. Both make the same moves.
    """
    ship_package(edges.sparkSession)
    e = edges.select("src", "dst", "weight").where("src <> dst")
    comp = components(e)
    e = materialize(e.join(comp.select(F.col("id").alias("src"), "component"), "src"))
    sizes = e.groupBy("component").agg(F.count("*").alias("n"))
    giant = sizes.where(F.col("n") > largest_local).select("component")
    small = e.join(giant, "component", "left_anti").groupBy("component").applyInPandas(
        lambda pdf: local_moves(pdf), "id bigint, label bigint"
    )
    if giant.limit(1).count():
        small = small.unionByName(wave_moves(e.join(giant, "component", "left_semi").select("src", "dst", "weight")))
    small = materialize(small)
    number = with_position(small.select("label").distinct(), ["label"], "id_communaute")
    return small.join(number, "label").select("id", "id_communaute")


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edge entries inside each community over n(n-1)/2; parallel edges count, below two members 0."""
    size = members.groupBy("id_communaute").agg(F.count("*").alias("size"))
    a = members.select(F.col("id").alias("src"), F.col("id_communaute").alias("ca"))
    b = members.select(F.col("id").alias("dst"), F.col("id_communaute").alias("cb"))
    inside = edges.where("src <> dst").join(a, "src").join(b, "dst").where("ca = cb").groupBy(F.col("ca").alias("id_communaute")).agg(F.count("*").alias("inside"))
    value = F.when(F.col("size") < 2, 0.0).otherwise(2.0 * F.coalesce("inside", F.lit(0)) / (F.col("size") * (F.col("size") - 1)))
    return size.join(inside, "id_communaute", "left").select("id_communaute", "size", F.round(value, 6).alias("cohesion"))


def cohesion_class(c: Column, cfg: CommunityConfig | None = None) -> Column:
    low, mid, high = (cfg or CommunityConfig()).cohesion_levels
    return F.when(c < low, "DIFFUSE").when(c < mid, "NORMALE").when(c < high, "DENSE").otherwise("TRES_DENSE")


def core_members(edges: DataFrame, members: DataFrame, created: DataFrame, as_of: str, cfg: CommunityConfig | None = None) -> DataFrame:
    """Members older than the limit, where they are fewer than two or dense enough among themselves."""
    cfg = cfg or CommunityConfig()
    old = F.col("date_creation") < F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(cfg.core_age_days))
    aged = members.join(created.where(old).select("id"), "id", "left_semi")
    dense = cohesion(edges, aged).where((F.col("size") < 2) | (F.col("cohesion") >= cfg.core_density)).select("id_communaute")
    return aged.join(dense, "id_communaute", "left_semi").select("id_communaute", "id")


def evolution(now: DataFrame, before: DataFrame, cfg: CommunityConfig | None = None) -> DataFrame:
    """State of each community against the memberships of the snapshot before."""
    cfg = cfg or CommunityConfig()
    j = now.join(before.select("id", F.col("id_communaute").alias("earlier")), "id", "left")
    g = j.groupBy("id_communaute").agg(
        F.count("*").alias("size"), F.count("earlier").alias("known"), F.count_distinct("earlier").alias("sources")
    )
    share = F.col("known") / F.col("size")
    state = (
        F.when(F.col("known") == 0, "NOUVELLE").when(F.col("sources") >= cfg.fragmentation, "FRAGMENTEE_SUSPECTE")
        .when(F.col("sources") > 1, "FUSIONNEE").when(share >= cfg.overlap_stable, "STABLE")
        .when(share >= cfg.overlap_transition, "EN_TRANSITION").otherwise("REORGANISEE")
    )
    return g.select("id_communaute", "size", "known", "sources", state.alias("evolution"))


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: weight inside communities over all, less what degrees alone would give."""
    e = edges.where("src <> dst")
    w = "weight" if "weight" in e.columns else None
    e = e.withColumn("w", F.col(w) if w else F.lit(1.0))
    total = e.agg(F.sum("w").alias("m"))
    a = members.select(F.col("id").alias("src"), F.col("id_communaute").alias("ca"))
    b = members.select(F.col("id").alias("dst"), F.col("id_communaute").alias("cb"))
    inside = e.join(a, "src").join(b, "dst").where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("inside"))
    strength = symmetric(e, "w").join(a, "src").groupBy("ca").agg(F.sum("w").alias("k"))
    squares = strength.agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    q = F.col("inside") / F.col("m") - F.col("k2") / (4 * F.col("m") * F.col("m"))
    return total.crossJoin(inside).crossJoin(squares).select(F.round(q, 6).alias("modularity"))


def summary(edges: DataFrame, members: DataFrame, created: DataFrame, before: DataFrame, as_of: str) -> DataFrame:
    """Per community: size, cohesion and its class, core size, evolution."""
    c = cohesion(edges, members)
    core = core_members(edges, members, created, as_of).groupBy("id_communaute").agg(F.count("*").alias("core_size"))
    e = evolution(members, before).select("id_communaute", "evolution")
    return c.join(core, "id_communaute", "left").join(e, "id_communaute").select(
        "id_communaute", "size", F.round("cohesion", 4).alias("cohesion"), cohesion_class(F.col("cohesion")).alias("classe"),
        F.coalesce("core_size", F.lit(0)).alias("core_size"), "evolution",
    )
