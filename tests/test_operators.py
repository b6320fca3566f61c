"""Operators on small hand-computed frames."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskgraph.config import IngestConfig, ResolutionConfig, ScoringConfig, TopologyConfig
from riskgraph.functions import scalar
from riskgraph.functions.graph import connected_components
from riskgraph.operators import communities, confidence, evaluation, ingest, links, resolution, scoring, topology
from riskgraph.sources import generator, tables

EVENT = (
    "seq bigint, id_source string, type_evenement string, type_source string, horodatage timestamp, montant double, "
    "id_entite_source bigint, id_entite_cible bigint, score_corroboration double, nombre_sources int, saut_hierarchique int"
)
T0 = dt.datetime(2024, 1, 1)


def event(seq, kind="TRANSACTION", at=T0, amount=10.0, src=1, dst=2, source="INTERNE", corr=0.9, n=1, jump=0, ident=None):
    return (seq, ident or f"e{seq}", kind, source, at, amount, src, dst, corr, n, jump)


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_validators_each_and_first_wins(spark):
    rows = [
        event(1), event(2, kind="X", source="Y"), event(3, source="Y"), event(4, at=None), event(5, at=T0 - dt.timedelta(days=181)),
        event(6, at=T0 - dt.timedelta(days=180)), event(7, at=T0 - dt.timedelta(days=31)), event(8, at=T0 - dt.timedelta(days=30)),
        event(9, n=6), event(10, corr=0.1), event(11, corr=None), event(12, jump=3), event(13, n=None, jump=None), event(14, at=T0 + dt.timedelta(days=5)),
    ]
    out = {r["seq"]: r for r in ingest.validate(spark.createDataFrame(rows, EVENT), "2024-01-01 00:00:00").collect()}
    assert out[1]["motif"] is None and out[1]["flags_semantiques"] == []
    assert out[2]["motif"].startswith("Type") and out[3]["motif"].startswith("Source")
    assert out[4]["motif"] == "Horodatage manquant" and "181" in out[5]["motif"]
    assert out[6]["motif"] is None and out[6]["flags_semantiques"] == ["RETRODATE_MODEREE"]
    assert out[7]["flags_semantiques"] == ["RETRODATE_MODEREE"] and out[8]["flags_semantiques"] == []
    assert out[9]["motif"].startswith("Nombre") and out[12]["motif"].startswith("Saut")
    assert out[10]["flags_semantiques"] == out[11]["flags_semantiques"] == ["FAIBLE_CORROBORATION"]
    assert out[13]["motif"] is None and out[14]["motif"] is None


def test_dedup_is_anchored_at_the_last_kept(spark):
    at = [0, 1800, 3500, 3600, 5000, 7200]
    rows = [event(i, at=T0 + dt.timedelta(seconds=s), ident="k") for i, s in enumerate(at)]
    out = ingest.mark_duplicates(spark.createDataFrame(rows, EVENT), ["id_source"], 3600)
    assert {r["seq"] for r in out.where("not is_duplicate").collect()} == {0, 3, 5}


@pytest.mark.parametrize("prior,flagged", [(9, False), (10, True), (11, True), (1500, True)])
def test_outlier_history(spark, prior, flagged):
    rows = [event(i, amount=10.0) for i in range(prior)] + [event(prior, amount=51.0)]
    out = ingest.mark_outliers(spark.createDataFrame(rows, EVENT), IngestConfig(), chunk=200)
    assert {r["seq"]: r["is_outlier"] for r in out.collect()}[prior] is flagged


def test_causal_window_ties_nulls(spark):
    h72 = T0 + dt.timedelta(hours=72)
    rows = [
        event(1, "EMAIL", T0, src=1, dst=2), event(2, "TRANSACTION", T0, src=1, dst=9), event(3, "TRANSACTION", h72, src=2, dst=9),
        event(4, "TRANSACTION", h72 + dt.timedelta(seconds=1), src=2, dst=9), event(5, "EMAIL", T0, src=None, dst=None),
        event(6, "APPROBATION", T0, src=None, dst=7), event(7, "LOG_ACCES", T0, src=3, dst=3), event(8, "TRANSACTION", T0, src=3, dst=4),
    ]
    got = {(r["cause"], r["effect"]) for r in links.causal_links(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {(1, 2), (1, 3), (3, 4), (5, 6), (7, 8)}


def test_causal_join_has_no_cartesian_plan(spark):
    plan = links.causal_links(spark.createDataFrame([event(1)], EVENT))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_cliques(spark):
    def found(pairs):
        return {r["members"] for r in topology.cliques(edges(spark, pairs)).collect()}

    assert found([(1, 2), (2, 3), (1, 3)]) == {"1,2,3"}
    assert found([(1, 2), (2, 3), (1, 3), (3, 4)]) == {"1,2,3"}
    assert found([(1, 2), (2, 3), (1, 3), (2, 4), (3, 4)]) == {"1,2,3", "2,3,4"}
    assert found([(1, 2)]) == set()


def test_pagerank_cycle_and_leak(spark):
    ranks = {r["id"]: r["rank"] for r in topology.pagerank(edges(spark, [(1, 2), (2, 1)])).collect()}
    assert ranks[1] == pytest.approx(ranks[2])
    leaky = topology.pagerank(edges(spark, [(1, 2), (2, 3), (1, 3), (3, 1)]), rounds=20).agg(F.sum("rank")).first()[0]
    proper = topology.pagerank(edges(spark, [(1, 2), (2, 3), (1, 3), (3, 1)]), TopologyConfig(dedup_paths=True), rounds=20).agg(F.sum("rank")).first()[0]
    assert leaky < proper <= 1 + 1e-9
    assert topology.pagerank(edges(spark, [])).count() == 0


def test_hubs_without_edges(spark):
    v = spark.range(3).withColumnRenamed("id", "id")
    assert topology.hubs(topology.degrees(v, edges(spark, []))).where("est_hub").count() == 3


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=20))
def test_components(spark, pairs):
    got = {r["id"]: r["component"] for r in connected_components(edges(spark, pairs)).collect()}
    group = {v: v for p in pairs if p[0] != p[1] for v in p}
    for _ in group:
        for a, b in pairs:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    assert got == group


def test_communities_and_cohesion(spark):
    two = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6)]
    e = edges(spark, two + [(3, 4)]).withColumn("weight", F.when((F.col("src") == 3) & (F.col("dst") == 4), 0.1).otherwise(1.0))
    label = {r["id"]: r["id_communaute"] for r in communities.detect(e).collect()}
    assert label[1] == label[2] == label[3] != label[4] == label[5] == label[6]
    parallel = {r["id"]: r["id_communaute"] for r in communities.detect(e, largest_local=0).collect()}
    assert parallel[1] == parallel[2] and parallel[5] == parallel[6]
    members = spark.createDataFrame([(1, 0), (2, 0), (9, 1)], "id bigint, id_communaute bigint")
    c = {r["id_communaute"]: r["cohesion"] for r in communities.cohesion(edges(spark, [(1, 2), (1, 2), (2, 1)]), members).collect()}
    assert c == {0: 3.0, 1: 0.0}


def test_evolution_states(spark):
    now = spark.createDataFrame([(i, c) for c in range(5) for i in range(c * 10, c * 10 + 10)], "id bigint, id_communaute bigint")
    before = [(i, 1) for i in range(10, 18)] + [(i, 2) for i in range(20, 24)] + [(i, 3 + i % 2) for i in range(30, 40)] + [(40 + i, 10 + i) for i in range(5)]
    state = {r["id_communaute"]: r["evolution"] for r in communities.evolution(now, spark.createDataFrame(before, "id bigint, id_communaute bigint")).collect()}
    assert state == {0: "NOUVELLE", 1: "STABLE", 2: "EN_TRANSITION", 3: "FUSIONNEE", 4: "FRAGMENTEE_SUSPECTE"}


@settings(max_examples=20, deadline=None)
@given(st.text("abcé", max_size=6), st.text("abcé", max_size=6))
def test_edit_similarity(spark, a, b):
    got = one(spark, scalar.edit_similarity(F.lit(a), F.lit(b)).alias("s"))["s"]
    want = 1.0 if a == b == "" else 0.0 if "" in (a, b) else 1 - edit(a, b) / max(len(a), len(b))
    assert got == pytest.approx(want)


def test_scalar_rules(spark):
    assert one(spark, scalar.normalized(F.lit(" Éléonore ")).alias("s"))["s"] == "eleonore"
    df = spark.createDataFrame([("Éa ",), (None,)], "s string")
    assert [r[0] for r in df.select(scalar.strip_accents()("s")).collect()] == ["ea", ""]
    assert one(spark, scalar.prefix_similarity(F.lit("ab"), F.lit("abc")).alias("s"))["s"] == 0.75
    assert one(spark, scalar.exact_similarity(F.lit(""), F.lit(""), False).alias("s"))["s"] == 0.0
    assert one(spark, scalar.frequency(F.lit(100)).alias("s"))["s"] == pytest.approx(1.0)
    assert one(spark, scalar.set_jaccard(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("s"))["s"] == 0.5
    assert one(spark, scalar.utc(F.lit("nonsense")).alias("s"))["s"] is None
    depth = one(spark, scalar.isolation_depth(F.lit(256)).alias("s"))["s"]
    assert depth == pytest.approx(scoring.mean_depth(256))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text("ab", min_size=3, max_size=5), min_size=2, max_size=12))
def test_resolution_is_leader_clustering(spark, names):
    cfg = ResolutionConfig(merge_at=0.93)
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, nom string")
    got = {r["merged"]: r["survivor"] for r in resolution.resolve(df, "id", cfg).collect()}
    pairs = {(r["a"], r["b"]) for r in resolution.matches(df, "id", cfg).collect()}
    merged = {}
    for i in range(len(names)):
        if i not in merged:
            for j in range(i + 1, len(names)):
                if j not in merged and (i, j) in pairs:
                    merged[j] = i
    assert got == merged


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("abc", max_size=8), min_size=2, max_size=12))
def test_blocking_loses_no_pair(spark, names):
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, nom string")
    got = {(r["a"], r["b"]) for r in resolution.block_pairs(df, "id").collect()}

    def near(a, b):
        if abs(len(a) - len(b)) / max(len(a), 1) > 0.3 * 3:
            return False
        x, y = a[:6], b[:6]
        return a[:3] == b[:3] or not a or not b or 1 - edit(x, y) / max(len(x), len(y)) > 0.7

    assert got == {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if near(names[i], names[j])}


def test_merge_repoints_edges(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "identifiant string")
    g = spark.createDataFrame([("b", "c"), ("a", "b")], "src string, dst string")
    left, moved = resolution.merge(e, g, spark.createDataFrame([("b", "a")], "merged string, survivor string"))
    assert {r["identifiant"]: r["identifiants_fusionnes"] for r in left.collect()} == {"a": ["b"], "c": None}
    assert [tuple(r) for r in moved.collect()] == [("a", "c")]


def test_propagation_and_decision(spark):
    v = spark.createDataFrame([(1, 0.8), (2, 0.4), (3, None)], "id bigint, risk double")
    e = spark.createDataFrame([(1, 2, 1.0)], "src bigint, dst bigint, score_confiance double")
    got = {r["id"]: r["score_gnn"] for r in scoring.propagate(v, e).collect()}
    assert got == {1: 0.5, 2: pytest.approx(0.175), 3: 0.1}
    assert ScoringConfig().threshold == pytest.approx(200 / 50200)
    assert one(spark, scoring.decide(F.lit(0.01)).alias("d"))["d"] == "FRAUDE_SUSPECTEE"


def test_forest_finds_the_outlier(spark):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(200)] + [(999, 500.0, -300.0)]
    s = scoring.isolation_scores(spark.createDataFrame(rows, "id bigint, x double, y double"), "id", ["x", "y"])
    assert s.orderBy(F.desc("score_if")).first()["id"] == 999
    empty = spark.createDataFrame([], "id bigint, x double")
    assert scoring.isolation_scores(empty, "id", ["x"]).count() == 0


def test_metrics_without_denominators(spark):
    rows = spark.createDataFrame([(True, True)], "t boolean, p boolean")
    r = evaluation.confusion(rows, "t", "p").first()
    assert (r["precision"], r["recall"], r["f1"], r["specificity"], r["mcc"]) == (1.0, 1.0, 1.0, 0.0, 0.0)
    r = evaluation.confusion(rows.limit(0), "t", "p").first()
    assert (r["tp"], r["accuracy"]) == (0, 0.0)


def test_bias(spark):
    def verdict(rows):
        return {r["biais"] for r in evaluation.bias(spark.createDataFrame(rows, "s string, d boolean"), "s", "d").collect()}

    assert verdict([("a", True)]) == {False}
    assert verdict([("a", True), ("b", False)]) == {True}
    assert verdict([("a", True), ("b", True)]) == {False}


def test_feedback_and_labels(spark):
    v = spark.createDataFrame([(1, 0.5), (2, 0.95), (3, 0.05)], "id bigint, risk double")
    lab = spark.createDataFrame([(1, "FRAUDE")], "id bigint, label string")
    got = {r["id"]: r["score_risque"] for r in evaluation.feedback_neighbours(v, edges(spark, [(1, 2), (1, 2), (3, 1)]), lab).collect()}
    assert got == {2: 1.0, 3: 0.15}
    assert evaluation.record_labels(v, lab).where("label_verite = 'FRAUDE'").count() == 1
    with pytest.raises(Exception, match="unknown label"):
        evaluation.record_labels(v, spark.createDataFrame([(1, "X")], "id bigint, label string")).collect()


def test_confidence_bounds(spark):
    e = edges(spark, [(1, 2), (2, 3)])
    facts = spark.createDataFrame([(1, 2, 1000, T0, ["a", "b", "c", "d", "e"], 2.0, True)], "src bigint, dst bigint, n bigint, last_seen timestamp, kinds array<string>, corroboration double, whitelisted boolean")
    got = {(r["src"], r["dst"]): r["score_confiance"] for r in confidence.link_confidence(e, facts, "2024-01-01").collect()}
    assert got[1, 2] == pytest.approx(0.3 * 0.8)
    assert 0 <= got[2, 3] <= 1
    r = confidence.null_model(spark, 0.99).first()
    assert r["significant"] == (r["z"] > 2.0) and math.isfinite(r["skewness"])


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k bigint, v string, w bigint")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 9)], "k bigint, v string, w bigint")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"], refresh=["v"]).collect())) == [(1, "a", 1), (2, "c", 1), (3, "d", 9)]
    e = edges(spark, [(1, 2)]).withColumn("type", F.lit("x"))
    assert tables.add_edges(e, e.unionByName(edges(spark, [(2, 3)]).withColumn("type", F.lit("x")))).count() == 2
    v, g = tables.delete_vertices(old, edges(spark, [(1, 2), (3, 4)]), old.where("k = 1"), key="k")
    assert v.count() == 1 and [tuple(r) for r in g.collect()] == [(3, 4)]
    assert sorted(r["n"] for r in tables.violations(spark.createDataFrame([(1, None), (1, "x")], "k bigint, c string"), "k", ("c",)).collect()) == [1, 2]
    path = str(tmp_path / "t")
    assert tables.snapshot(old, path).count() == 2
    with pytest.raises(ValueError):
        tables.wipe(spark, path, old.schema)
    tables.wipe(spark, path, old.schema, sure=True)
    assert spark.read.schema(old.schema).parquet(path).count() == 0
    assert {r["extra"] for r in tables.write_back(old, spark.createDataFrame([(1, 5)], "k bigint, extra bigint"), "k").collect()} == {5, None}
    rejected = spark.createDataFrame([event(1)], EVENT).withColumn("motif", F.lit("m")).withColumn("flags_semantiques", F.array(F.lit("x" * 900)))
    assert len(tables.reject_records(rejected, "2024-01-01").first()["donnees_brutes"]) <= 500
    assert tables.query(spark, "SELECT * FROM {t} WHERE k = :k", {"t": old}, {"k": 2}).count() == 1


def test_generator_is_deterministic(spark):
    a, b = (generator.entities(spark.newSession(), 60, seed=1) for _ in range(2))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    ev = generator.events(a, seed=1)
    assert ev.where("id_entite_source = id_entite_cible").count() == 0
    assert ingest.validate(ev.withColumn("seq", F.xxhash64("id_source")), "2024-07-01 00:00:00").where("motif is not null").count() == 0
