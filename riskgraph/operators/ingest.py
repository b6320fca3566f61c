"""Phase 1: validation of events as one projection over windows."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.config import IngestConfig
from riskgraph.functions.cluster import materialize, ship_package
from riskgraph.functions.order import with_position
from riskgraph.functions.scalar import whole_days


@dataclass(frozen=True)
class Rule:
    """A validator: ``reject`` is a reason or null, ``flag`` a mark or null."""

    name: str
    reject: Column | None = None
    flag: Column | None = None


def rules(cfg: IngestConfig, as_of: str, extra_flags: dict[str, Column] | None = None) -> list[Rule]:
    """The validators V1 to V8 in order; windowed ones refer to columns computed beforehand."""
    age = whole_days(F.to_timestamp(F.lit(as_of)), F.col("horodatage"))
    flags = extra_flags or {}
    kind, source = F.coalesce("type_evenement", F.lit("")), F.coalesce("type_source", F.lit(""))
    sources, jump = F.coalesce("nombre_sources", F.lit(1)), F.coalesce("saut_hierarchique", F.lit(0))
    return [
        Rule("V1", F.when(~kind.isin(*cfg.event_types), F.format_string("Type non autorisé : '%s'", kind))),
        Rule("V2", F.when(~source.isin(*cfg.source_types), F.format_string("Source non autorisée : '%s'", source))),
        Rule("V3", F.when(F.col("is_duplicate"), F.lit(f"Doublon (fenêtre={cfg.dedup_seconds}s)")) if "is_duplicate" in flags else None),
        Rule("V4", flag=F.when(flags["is_spike"], "SPIKE_VOLUME") if "is_spike" in flags else None),
        Rule(
            "V5",
            F.when(F.col("horodatage").isNull(), "Horodatage manquant").when(
                age > cfg.reject_age_days, F.format_string(f"Rétrodatation excessive : %d jours > {cfg.reject_age_days} jours", age)
            ),
            F.when(age > cfg.flag_age_days, "RETRODATE_MODEREE"),
        ),
        Rule(
            "V6", F.when(sources > cfg.max_sources, F.format_string("Nombre de sources excessif : %d", sources)),
            F.when(F.coalesce("score_corroboration", F.lit(0.0)) < cfg.min_corroboration, "FAIBLE_CORROBORATION"),
        ),
        Rule("V7", flag=F.when(flags["is_outlier"], "MONTANT_ABERRANT") if "is_outlier" in flags else None),
        Rule("V8", F.when(jump > cfg.max_jump, F.format_string("Saut hiérarchique excessif : %d", jump))),
    ]


def apply_rules(events: DataFrame, chain: list[Rule]) -> DataFrame:
    """``events`` with ``motif`` (the first rejection or null) and ``flags_semantiques``.

    Flags count up to the rule that rejects, as in a chain that stops there.
    """
    rejects = [r.reject for r in chain if r.reject is not None]
    flags, before = [], []
    for r in chain:
        if r.reject is not None:
            before.append(r.reject)
        if r.flag is not None:
            flags.append(F.when(F.coalesce(*before).isNull(), r.flag) if before else r.flag)
    marks = F.filter(F.array(*flags), lambda x: x.isNotNull()) if flags else F.array().cast("array<string>")
    return events.withColumns({"motif": F.coalesce(*rejects), "flags_semantiques": marks})


def mark_duplicates(events: DataFrame, keys: list[str], seconds: int, order: str = "seq") -> DataFrame:
    """``is_duplicate``: less than ``seconds`` after the last kept event of the same key.

    Time is cut into buckets as wide as the window, of which each holds one kept event
    at most. An event's successor, the first one a window later, lies in the next
    bucket or opens the next bucket in use, so it is found within single buckets. Kept
    is what successors reach from an event that nothing precedes by less than a window.
    That closure takes jumps of doubling length, so a busy key costs rounds as the
    logarithm of its busiest stretch, and no task ever holds more than one bucket of a
    key. Events without a time are no duplicates; null keys count as equal.
    """
    width = seconds * 1_000_000
    key = F.struct(*keys).alias("k")
    t = F.unix_micros("horodatage").alias("t")
    nodes = events.where(F.col("horodatage").isNotNull()).groupBy(key, t).agg(F.min(order).alias("first"))
    nodes = materialize(nodes.withColumn("b", F.expr(f"t div {width}")))
    w = Window.partitionBy("k").orderBy("b")
    ends = nodes.groupBy("k", "b").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    ends = ends.select(
        "k", "b", "lo", F.lag("hi").over(w).alias("before"), F.lead("b").over(w).alias("b1"), F.lead("lo").over(w).alias("lo1"), F.lead("lo", 2).over(w).alias("lo2")
    )
    ends = materialize(ends)
    starts = ends.where(F.col("before").isNull() | (F.col("lo") - F.col("before") >= width)).select("k", F.col("lo").alias("t"))
    # an event asks the next bucket for the first time a window later; at equal times the question comes first
    asked = nodes.select("k", (F.col("b") + 1).alias("b"), (F.col("t") + width).alias("at"), F.lit(0).alias("kind"), F.col("t").alias("asker"), F.lit(None).cast("bigint").alias("point"))
    there = nodes.select("k", "b", F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("asker"), F.col("t").alias("point"))
    following = Window.partitionBy("k", "b").orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    answers = asked.unionByName(there).withColumn("found", F.min("point").over(following)).where("kind = 0")
    answers = answers.select("k", (F.col("b") - 1).alias("b"), F.col("asker").alias("t"), "found")
    after = F.when(F.col("b1") > F.col("b") + 1, F.col("lo1")).otherwise(F.coalesce("found", "lo2"))
    jumps = answers.join(ends, ["k", "b"]).select("k", "t", after.alias("to")).where(F.col("to").isNotNull())
    jumps = materialize(jumps.join(starts.withColumnRenamed("t", "to"), ["k", "to"], "left_anti"))
    kept = materialize(starts)
    while jumps.limit(1).count():
        reached = kept.join(jumps, ["k", "t"]).select("k", F.col("to").alias("t"))
        kept = materialize(kept.unionByName(reached).distinct(), instead=kept)
        far = jumps.select("k", F.col("to").alias("t"), F.col("t").alias("from")).join(jumps, ["k", "t"])
        jumps = materialize(far.select("k", F.col("from").alias("t"), "to"), instead=jumps)
    first = nodes.join(kept, ["k", "t"], "left_semi").select(F.col("first").alias(order), F.lit(True).alias("_keep"))
    marked = events.join(first, order, "left")
    return marked.withColumn("is_duplicate", F.col("_keep").isNull() & F.col("horodatage").isNotNull()).drop("_keep")


def _bucketed(events: DataFrame, key: str, width: int) -> DataFrame:
    """Each event in its time bucket ``_b``, and once more (``_own`` false) in the next, whose first windows reach back to it."""
    b = F.expr(f"unix_micros(horodatage) div {width}")
    both = events.withColumn("_at", b).withColumn("_b", F.explode(F.array_distinct(F.array("_at", F.col("_at") + 1))))
    return both.withColumn("_own", F.col("_b").eqNullSafe(F.col("_at")))


def trailing_volume(events: DataFrame, key: str, minutes: int) -> DataFrame:
    """``volume``: events of the key in the trailing window, itself included. A busy key is cut up by time."""
    width = minutes * 60_000_000
    w = Window.partitionBy(key, "_b").orderBy(F.unix_micros("horodatage")).rangeBetween(-width + 1, 0)
    counted = _bucketed(events, key, width).withColumn("volume", F.count("*").over(w))
    return counted.where("_own").select(*events.columns, "volume")


def mark_spikes(events: DataFrame, key: str, cfg: IngestConfig, literal: bool = False) -> DataFrame:
    """``is_spike``: volume over ``spike_factor`` times the key's mean volume so far.

    The mean adds up what earlier time buckets and the rows before in the same bucket
    hold, so no window spans a whole key but over its buckets. The literal rule compares
    a volume with ten times itself spread over the window, which can never hold; it is
    kept as ``literal=True``.
    """
    v = trailing_volume(events, key, cfg.spike_minutes)
    if literal:
        usual = F.greatest(F.lit(1.0), F.col("volume") / float(max(1, cfg.spike_minutes)))
        return v.withColumn("is_spike", F.col("volume") > cfg.spike_factor * usual)
    v = v.withColumn("_b", F.expr(f"unix_micros(horodatage) div {cfg.spike_minutes * 60_000_000}"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = v.groupBy(key, "_b").agg(F.sum("volume").alias("_s"), F.count("*").alias("_n"))
    sums = sums.select(
        F.col(key).alias("_key"), F.col("_b").alias("_bucket"),
        F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"),
    )
    inside = Window.partitionBy(key, "_b").orderBy("horodatage", "seq").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("_is", F.coalesce(F.sum("volume").over(inside), F.lit(0))).withColumn("_in", F.count("*").over(inside))
    v = v.join(sums, F.col(key).eqNullSafe(F.col("_key")) & F.col("_b").eqNullSafe(F.col("_bucket")))
    mean = F.try_divide((F.col("_s") + F.col("_is")).cast("double"), F.col("_n") + F.col("_in"))
    usual = F.greatest(F.lit(1.0), F.coalesce(mean, F.lit(1.0)))
    return v.withColumn("is_spike", F.col("volume") > cfg.spike_factor * usual).select(*events.columns, "volume", "is_spike")


def mark_outliers(events: DataFrame, cfg: IngestConfig, chunk: int = 20000) -> DataFrame:
    """``is_outlier`` of transactions by the upper median of up to 1000 amounts before, in global arrival order.

    Positions in the order are cut into chunks; each chunk also gets the rows that
    its first frames reach back to, so chunks of bounded size are slid over
    independently and give what one window over everything would.
    """
    t = with_position(events.where((F.col("type_evenement") == "TRANSACTION") & F.col("montant").isNotNull()).select("seq", "montant"), ["seq"])
    own = F.expr(f"cast(position div {chunk} as bigint)")
    reach = F.expr(f"cast((position + {cfg.outlier_history}) div {chunk} as bigint)")
    dealt = t.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence("_own", reach)))
    factor, most, least = cfg.outlier_factor, cfg.outlier_history, cfg.outlier_min

    def slide(pdf: pd.DataFrame) -> pd.DataFrame:
        # the frame as a sorted list: one insertion and one removal per row instead of a sort
        pdf = pdf.sort_values("position")
        amounts, own = pdf["montant"].tolist(), (pdf["_own"] == pdf["_chunk"]).tolist()
        frame: list[float] = []
        out = []
        for i, (seq, x) in enumerate(zip(pdf["seq"], amounts, strict=True)):
            if own[i]:
                n = len(frame)
                middle = frame[n // 2] if n else 0.0
                out.append((seq, n, n >= least and middle > 0 and x > factor * middle))
            bisect.insort(frame, x)
            if len(frame) > most:
                del frame[bisect.bisect_left(frame, amounts[i - most])]
        return pd.DataFrame(out, columns=["seq", "history", "is_outlier"])

    ship_package(events.sparkSession)
    return dealt.groupBy("_chunk").applyInPandas(slide, "seq bigint, history int, is_outlier boolean")


def validate(events: DataFrame, as_of: str, cfg: IngestConfig | None = None) -> DataFrame:
    """All eight validators; each windowed one sees only what the rules before it let through."""
    cfg = cfg or IngestConfig()
    basic = apply_rules(events, rules(cfg, as_of)[:2])
    passed = basic.where("motif is null").select(*events.columns)
    dup = mark_duplicates(passed, ["id_source", "type_evenement", "montant"], cfg.dedup_seconds).select("seq", "is_duplicate")
    fresh = passed.join(dup.where("not is_duplicate").select("seq"), "seq", "left_semi")
    spikes = mark_spikes(fresh, "id_source", cfg).select("seq", "is_spike")
    upto6 = apply_rules(fresh, [r for r in rules(cfg, as_of) if r.name in ("V5", "V6")]).where("motif is null")
    outliers = mark_outliers(upto6, cfg).select("seq", "is_outlier")
    joined = events.join(dup, "seq", "left").join(spikes, "seq", "left").join(outliers, "seq", "left")
    joined = joined.fillna(False, ["is_duplicate", "is_spike", "is_outlier"])
    chain = rules(cfg, as_of, {"is_duplicate": F.col("is_duplicate"), "is_spike": F.col("is_spike"), "is_outlier": F.col("is_outlier")})
    return apply_rules(joined, chain).drop("is_duplicate", "is_spike", "is_outlier")


def reject_counts(validated: DataFrame) -> DataFrame:
    """Rejections by the text before the colon."""
    return (
        validated.where(F.col("motif").isNotNull())
        .groupBy(F.trim(F.substring_index("motif", ":", 1)).alias("motif")).agg(F.count("*").alias("n"))
    )
