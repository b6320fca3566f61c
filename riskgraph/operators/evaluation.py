"""Phase 8: evaluation, bias, feedback, retraining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.config import FeedbackConfig
from riskgraph.functions.order import shuffled
from riskgraph.functions.scalar import clamp, classification_metrics
from riskgraph.operators.links import symmetric

LABELS = ("FRAUDE", "NORMAL", "FAUX_POSITIF")


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row of counts and metrics for two boolean columns."""
    t, p = F.coalesce(F.col(truth), F.lit(False)), F.coalesce(F.col(predicted), F.lit(False))
    c = rows.agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")
    )
    return c.select("tp", "fp", "fn", "tn", *classification_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def held_out(rows: DataFrame, key: str, cfg: FeedbackConfig | None = None, seed: int = 0) -> DataFrame:
    """The part after the training share, in an order shuffled by digest; the cut is exact."""
    cfg = cfg or FeedbackConfig()
    placed = shuffled(rows, key, seed, "_r")
    return placed.where(F.col("_r") >= int(rows.count() * cfg.train_share)).drop("_r")


def bias(rows: DataFrame, segment: str, detected: str, cfg: FeedbackConfig | None = None) -> DataFrame:
    """Detection rate by segment, highest first, with the verdict on the largest over the smallest rate on every row."""
    cfg = cfg or FeedbackConfig()
    rates = rows.groupBy(F.col(segment).alias("segment")).agg(F.count("*").alias("total"), F.count_if(detected).alias("detected"))
    rates = rates.withColumn("taux_detection", F.round(F.col("detected") / F.col("total"), 6))
    limits = rates.agg(F.max("taux_detection").alias("hi"), F.min("taux_detection").alias("lo"), F.count("*").alias("n"))
    ratio = F.when(F.col("n") < 2, 1.0).when(F.col("lo") > 0, F.col("hi") / F.col("lo")).otherwise(F.lit(float("inf")))
    return rates.crossJoin(F.broadcast(limits)).select(
        "segment", "total", "detected", "taux_detection", (F.coalesce(ratio > cfg.max_disparity, F.lit(False)) & (F.col("n") >= 2)).alias("biais")
    ).orderBy(F.desc("taux_detection"), "segment")  # a row per segment


def retrain_trigger(rows: DataFrame, label: str, used: str | None = None, cfg: FeedbackConfig | None = None) -> DataFrame:
    """How many labels no training has used yet, and whether they are enough."""
    cfg = cfg or FeedbackConfig()
    fresh = F.col(label).isNotNull() & (~F.coalesce(F.col(used), F.lit(False)) if used else F.lit(True))
    return rows.agg(F.count_if(fresh).alias("nouveaux_labels")).select("nouveaux_labels", (F.col("nouveaux_labels") >= cfg.retrain_at).alias("reentrainer"))


def _step(fraud: float, other: float):
    return F.when(F.col("label") == "FRAUDE", fraud).otherwise(other)


def feedback_neighbours(vertices: DataFrame, edges: DataFrame, labels: DataFrame, cfg: FeedbackConfig | None = None) -> DataFrame:
    """New risks of the direct neighbours of labelled vertices; parallel edges add up."""
    cfg = cfg or FeedbackConfig()
    step = labels.select(F.col("id").alias("src"), _step(cfg.neighbour_step, -cfg.false_positive_step).alias("step"))
    delta = symmetric(edges).join(step, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("step").alias("delta"))
    risk = F.coalesce("risk", F.lit(0.1)) + F.col("delta")
    return vertices.join(delta, "id").select("id", F.round(clamp(risk), 6).alias("score_risque"))


def feedback_community(vertices: DataFrame, members: DataFrame, cohesions: DataFrame, labels: DataFrame, cfg: FeedbackConfig | None = None) -> DataFrame:
    """New risks of the other members of labelled vertices' communities, where these are cohesive enough."""
    cfg = cfg or FeedbackConfig()
    dense = cohesions.where(F.col("cohesion") >= cfg.cohesion_at).select("id_communaute")
    step = labels.join(members, "id").join(dense, "id_communaute", "left_semi")
    step = step.select("id", "id_communaute", _step(cfg.community_step, -cfg.false_positive_step / 2).alias("step"))
    total = step.groupBy("id_communaute").agg(F.sum("step").alias("all"))
    own = step.groupBy("id").agg(F.sum("step").alias("own"))
    touched = members.join(total, "id_communaute").join(own, "id", "left").withColumn("delta", F.round(F.col("all") - F.coalesce("own", F.lit(0.0)), 9))
    n = step.groupBy("id_communaute").agg(F.count("*").alias("labelled"))
    touched = touched.join(n, "id_communaute").where((F.col("labelled") > 1) | F.col("own").isNull())
    return vertices.join(touched.select("id", "delta"), "id").select("id", F.round(clamp(F.coalesce("risk", F.lit(0.1)) + F.col("delta")), 6).alias("score_risque"))


def class_tally(rows: DataFrame, column: str, *values: str) -> DataFrame:
    """``classe, n`` for each of ``values``, with 0 for those that don't occur, and for whatever else does."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(v, 0) for v in values], "classe string, n bigint")
    seen = rows.select(F.col(column).cast("string").alias("classe"), F.lit(1).cast("bigint").alias("n"))
    return wanted.unionByName(seen).groupBy("classe").agg(F.sum("n").alias("n"))


def record_labels(vertices: DataFrame, labels: DataFrame) -> DataFrame:
    """``vertices`` with ``label_verite`` set where ``labels`` has the id; others keep theirs, a label outside the domain raises an error."""
    ok = F.when(F.col("label").isin(*LABELS), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null")))))
    old = F.col("label_verite") if "label_verite" in vertices.columns else F.lit(None).cast("string")
    joined = vertices.join(labels.select("id", ok.alias("_label")), "id", "left").withColumn("label_verite", F.coalesce("_label", old))
    return joined.drop("_label")
