"""What keeps the operators sound at any size: plans without global steps, and equality with plain versions."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgraph.config import FeedbackConfig, IngestConfig, ResolutionConfig
from riskgraph.functions import cluster, pairs, scalar
from riskgraph.functions.order import shuffled, with_position
from riskgraph.operators import communities, confidence, evaluation, ingest, links, resolution, scoring, topology
from riskgraph.plans import phases
from riskgraph.sources import tables
from riskgraph.streaming import checks
from tests.test_operators import EVENT, T0, edges, event
from tests.test_streaming import feed, run


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def busy_events(seed, n=400, keys=("a", "b", None), hours=30):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = None if rng.random() < 0.03 else T0 + dt.timedelta(seconds=rng.choice([rng.randrange(hours * 3600), 3600 * rng.randrange(hours), 7]))
        rows.append((i, rng.choice(keys), at))
    return rows


def timed(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, k string, horodatage timestamp").repartition(3)


@pytest.mark.parametrize("seed,n,hours", [(1, 400, 30), (2, 60, 200), (3, 600, 4)])
def test_duplicates_match_a_fold(spark, seed, n, hours):
    rows = busy_events(seed, n, hours=hours)
    last, kept = {}, set()
    for seq, k, at in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        if k not in last or (at - last[k]).total_seconds() >= 3600:
            last[k] = at
            kept.add(seq)
    got = {r["seq"]: r["is_duplicate"] for r in ingest.mark_duplicates(timed(spark, rows), ["k"], 3600).collect()}
    assert got == {seq: at is not None and seq not in kept for seq, _, at in rows}


def test_spikes_match_a_scan(spark):
    rows = busy_events(5, 300, hours=3)
    cfg = IngestConfig(spike_factor=1.5)
    want, seen = {}, {}
    for seq, k, at in sorted(rows, key=lambda r: (r[2] is not None, r[2] or T0, r[0])):
        same = [x for _, j, x in rows if j == k]
        volume = sum(x is None for x in same) if at is None else sum(x is not None and dt.timedelta(0) <= at - x < dt.timedelta(minutes=10) for x in same)
        past = seen.setdefault(k, [])
        usual = max(1.0, sum(past) / len(past)) if past else 1.0
        want[seq] = (volume, volume > 1.5 * usual)
        past.append(volume)
    got = {r["seq"]: (r["volume"], r["is_spike"]) for r in ingest.mark_spikes(timed(spark, rows), "k", cfg).collect()}
    assert got == want


def test_no_global_window(spark):
    rows = spark.range(100).withColumn("t", F.lit(True)).withColumn("p", F.lit(True))
    held = evaluation.held_out(rows, "id", FeedbackConfig())
    assert held.count() == 30
    assert sorted(r["position"] for r in shuffled(rows, "id", 3).collect()) == list(range(100))
    assert [r["id"] for r in shuffled(rows, "id", 3).orderBy("position").collect()] != list(range(100))
    assert [r["position"] for r in with_position(rows, ["id"]).orderBy("id").collect()] == list(range(100))


@pytest.mark.parametrize("seed", [1, 2])
def test_communities_are_the_same_at_every_size(spark, seed):
    rng = random.Random(seed)
    pairs = {tuple(rng.sample(range(14), 2)) for _ in range(24)}
    e = spark.createDataFrame([(a, b, round(rng.choice([0.1, 0.2, 0.3, rng.random()]), 6)) for a, b in sorted(pairs)], "src bigint, dst bigint, weight double")
    small = {r["id"]: r["id_communaute"] for r in communities.detect(e).collect()}
    assert {r["id"]: r["id_communaute"] for r in communities.detect(e, largest_local=0).collect()} == small


def test_links_of_ranks_are_never_broadcast(spark):
    e = edges(spark, [(i, 100 + j) for i in range(40) for j in range(5)] + [(100, 1)])
    physical = topology.pagerank(e, rounds=1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ShuffledHashJoin \[src#\d+L\], \[id#\d+L\], Inner, BuildRight", physical)


def test_edges_are_never_broadcast_for_confidence(spark):
    e = edges(spark, [(i, 100 + j) for i in range(40) for j in range(5)])
    rows = [event(i, "TRANSACTION", T0, src=i, dst=100) for i in range(40)]
    scored = confidence.link_confidence(e, confidence.event_facts(spark.createDataFrame(rows, EVENT)), "2024-02-15")
    spread = scoring.propagate(spark.range(40).withColumn("risk", F.lit(0.5)), e.withColumn("score_confiance", F.lit(0.5)))
    assert not re.search(r"BroadcastHashJoin \[src#\d+L?, dst#|BroadcastHashJoin \[dst#\d+L, w#", plan(scored))
    assert "ShuffledHashJoin [dst#" in plan(spread)


def test_resolution_has_no_nested_loop(spark):
    rows = [(i, n, a, t) for i, (n, a, t) in enumerate([("", "x", "1"), ("", "y", "1"), ("anna", "x", "1"), ("Anná ", "x", "1"), ("anne", "z", "2"), (None, "x", None)])]
    df = spark.createDataFrame(rows, "id bigint, nom string, adresse string, telephone string")
    for prefilter in (0.30, 0.40):
        cfg = ResolutionConfig(prefilter=prefilter)
        got = resolution.block_pairs(df.select("id", F.coalesce("nom", F.lit("")).alias("nom")), "id", cfg)
        assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
        empty = {(0, 1), (0, 5), (1, 5)}
        assert {(r["a"], r["b"]) for r in got.collect()} >= empty
    # ids of empty names after others: only a wide gap lets them meet
    late = spark.createDataFrame([(1, "bob"), (2, "")], "id bigint, nom string")
    assert resolution.block_pairs(late, "id", ResolutionConfig(prefilter=0.40)).count() == 1
    assert resolution.block_pairs(late, "id", ResolutionConfig()).count() == 0


def test_equal_names_are_compared_once(spark):
    names = ["anna", "annas", "bob", "", "a very long name of annas"]
    rows = [(i, names[i * i % 5 if i % 7 else 0]) for i in range(1500)] + [(None, "anna"), (9000, None)]
    df = spark.createDataFrame(rows, "id bigint, nom string")
    got = resolution.block_pairs(df, "id")
    assert "explode(ys" in plan(got) and "levenshtein" not in plan(got).split("explode(ys")[0]
    fits = {(a, b) for a in names for b in names if (a[:3] == b[:3] or not a or not b) and abs(len(a) - len(b)) / max(len(a), 1) <= 0.9}
    ids = [(i, n) for i, n in rows if i is not None and n is not None]
    want = sum((m, n) in fits for x, (i, m) in enumerate(ids) for j, n in ids[x + 1 :])
    assert got.count() == want == got.distinct().count() and got.where("a >= b").count() == 0
    both = resolution.block_pairs(df, "id", both=True)
    assert both.count() == sum((m, n) in fits for i, m in ids for j, n in ids if i != j)


def test_matches_of_equal_entities_are_made_at_the_end(spark):
    df = spark.createDataFrame([(i, "anna" if i % 4 else "bob", "x") for i in range(1200)], "id bigint, nom string, adresse string")
    got = resolution.matches(df, "id", ResolutionConfig(merge_at=0.951))
    assert "explode(ys" in plan(got)
    assert got.count() == 900 * 899 // 2 + 300 * 299 // 2 == got.distinct().count() and got.where("a >= b or similarite <> 1").count() == 0


def test_classes_paired_in_both_orders_meet_once(spark, monkeypatch):
    rng = random.Random(12)
    line = {i: rng.choice([1, 1, 1, 2, 2, 3, 4]) for i in range(80)}
    asked = [(1, 1, 1.0), (1, 2, 0.5), (2, 1, 0.5), (3, 1, 0.25), (2, 3, 0.5), (3, 2, 0.75), (4, 4, 1.0), (None, 4, 1.0), (4, 9, 1.0)]
    tables, keep = [], pairs.materialize
    monkeypatch.setattr(pairs, "materialize", lambda df: tables.append(keep(df)) or tables[-1])
    monkeypatch.setattr(pairs, "BLOCK", 8)
    members = spark.createDataFrame([*line.items(), (None, 1), (900, None)], "id bigint, line bigint")
    got = pairs.expand(spark.createDataFrame(asked, "a bigint, b bigint, s double"), members)
    want = sorted((a, b, x, y, s) for a, b, s in asked for x in line for y in line if x < y and (line[x], line[y]) == (a, b))
    assert sorted(tuple(r) for r in got.select("a", "b", "first", "second", "s").collect()) == want
    blocks = {(r["line"], r["block"]): r["ids"] for r in tables[0].collect()}
    assert len(blocks) > 8 and all(ids == sorted(ids) for ids in blocks.values())
    met = [frozenset([(r["a"], r["ka"]), (r["b"], r["kb"])]) for r in tables[-1].where("s = 0.5 and least(a, b) = 1").collect()]
    sizes = {c: sum(k[0] == c for k in blocks) for c in (1, 2)}
    assert len(met) == len(set(met)) == sizes[1] * sizes[2]


def test_blocks_dealt_out_are_small_beside_their_pairs(spark, monkeypatch):
    tables, keep = [], pairs.materialize
    monkeypatch.setattr(pairs, "materialize", lambda df: tables.append(keep(df)) or tables[-1])
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        members = spark.range(5000).select("id", (F.col("id") % 2).alias("line"))
        got = pairs.expand(spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "a bigint, b bigint"), members)
        plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    ids = {(r["line"], r["block"]): len(r["ids"]) for r in tables[0].collect()}
    sent = sum(ids[r["a"], r["ka"]] + ids[r["b"], r["kb"]] for r in tables[-1].collect())
    assert got.count() == got.distinct().count() == 2500 * 2499 // 2 + 2500 * 2500 and sent < 50_000
    # rows of one block come before those of pairs, so that a task doesn't hold all pairs of two blocks
    made = [line for line in plan if "Generate explode" in line]
    assert len(made) == 2 and "*(" in made[0] and "*(" not in made[1]


def test_groups_of_many_blocks_lose_no_pair(spark):
    rows = [(i, "x" if i % 3 else "y", i % 2) for i in range(2000)] + [(5000, None, 1), (5001, "z", 1)]
    got = links.shared_attribute_pairs(spark.createDataFrame(rows, "id bigint, s string, k int"), "id", ["s", "k"])
    assert "explode(ys" in plan(got) and got.where("src >= dst").count() == 0
    size = {}
    for _, s, k in rows[:2000]:
        size[s, k] = size.get((s, k), 0) + 1
    want = {n: sum(m * (m - 1) // 2 for m in size.values() if m == n) for n in size.values()}
    assert {r["group_size"]: r["n"] for r in got.distinct().groupBy("group_size").agg(F.count("*").alias("n")).collect()} == want


def test_edges_of_lines_stand_for_those_of_their_members(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["anna", "annabella", "annas", "bob", "", None]), rng.choice("xy"), rng.choice("tu")) for i in range(150)]
    df = spark.createDataFrame(rows, "identifiant bigint, nom string, adresse string, telephone string")
    members, matched = resolution.matched_lines(df, "identifiant", ResolutionConfig())
    both = {(r["a"], r["b"]) for r in matched.collect()}
    assert any((b, a) not in both for a, b in both) and any((b, a) in both for a, b in both if a != b)
    mapping = resolution.resolve_lines(members, matched)
    few = resolution.pair_counts(members, matched).select(F.col("a").alias("src"), F.col("b").alias("dst"), "n")
    all_of_them = resolution.matches(df, "identifiant").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    assert few.agg(F.sum("n")).first()[0] == all_of_them.count() > 10 * few.count()
    moved = [resolution.merge(df, e, mapping)[1].groupBy("src", "dst") for e in (few, all_of_them)]
    want = {(r["src"], r["dst"]): r["n"] for r in moved[1].agg(F.count("*").alias("n")).collect()}
    got = {}
    for r in moved[0].agg(F.sum("n").alias("n")).collect():  # survivors of both orders
        got[min(r["src"], r["dst"]), max(r["src"], r["dst"])] = got.get((min(r["src"], r["dst"]), max(r["src"], r["dst"])), 0) + r["n"]
    whole = {}
    for (a, b), n in want.items():
        whole[min(a, b), max(a, b)] = whole.get((min(a, b), max(a, b)), 0) + n
    assert got == whole and got


def test_cliques_of_groups_are_those_of_their_pairs(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(30), rng.randrange(14)) for _ in range(42)] + [(i, 90) for i in range(100, 103)] + [(i, 91) for i in (200, 201)] + [(None, 90)]
    got = [tuple(r) for r in topology.group_cliques(spark.createDataFrame(rows, "id bigint, line int")).collect()]
    pairs = [(a, b) for a, x in rows for b, y in rows if x == y and a is not None and b is not None and a < b]
    assert sorted(got) == sorted(tuple(r) for r in topology.cliques(edges(spark, pairs)).collect()) and (3, "100,101,102") in got and len(got) > 2
    # pairs of a group of this size have 1.3 billion triangles
    large = spark.range(2000).withColumn("line", F.lit(1))
    assert topology.group_cliques(large).select("size").first()[0] == 2000


def test_closeness_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(8)
    pairs = [(rng.randrange(120), 1000 + int(rng.random() ** 3 * 90)) for _ in range(260)] + [(5000, 5001), (3, 3), (1000, 1), (1, 1000)]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for v in near:
        dist, front = {v: 0}, {v}
        for k in (1, 2, 3):
            front = {w for x in front for w in near[x]} - dist.keys()
            dist |= dict.fromkeys(front, k)
        want[v] = (len(dist) - 1, pytest.approx((len(dist) - 1) / sum(dist.values()), abs=1e-6))
    got = topology.closeness(edges(spark, pairs))
    assert {r["id"]: (r["reach"], r["closeness"]) for r in got.collect()} == want
    assert "origin" not in plan(got)
    monkeypatch.setattr(topology, "LOOKUPS", 16)  # a vertex's edges go over several lookups
    ids = sorted(near)
    ends = [(k, ids.index(w)) for k, v in enumerate(ids) for w in near[v]]
    a, b = (np.array(x, dtype=np.int32) for x in zip(*ends, strict=True))
    parts = [topology._reach(a, b, len(ids), low, min(70, len(ids) - low), 3)[0] for low in range(0, len(ids), 70)]
    assert dict(zip(ids, sum(parts).tolist(), strict=True)) == {v: r for v, (r, _) in want.items()}
    assert topology.closeness(edges(spark, [])).count() == 0


@pytest.mark.parametrize("nulls_match", [True, False])
def test_exact_keys_lose_no_match(spark, nulls_match):
    rng = random.Random(4)
    cfg = ResolutionConfig(nulls_match=nulls_match)
    names = ["nom", "adresse", "telephone", "email", "adresse_ip", "numero_compte", "siret"]
    rows = [(i, *(rng.choice(["marie", "marie", "maria", None]) if c == "nom" else rng.choice(["u", "u", "u", "v", None]) for c in names)) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} string" for c in names))
    got = {(r["a"], r["b"]) for r in resolution.matches(df, "id", cfg).collect()}
    norm = df.select("id", *(scalar.normalized(c).alias(c) for c in names))
    pairs = resolution.block_pairs(norm.select("id", "nom"), "id", cfg)
    a, b = (norm.select(F.col("id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in names)) for x in "ab")
    scored = pairs.join(a, "a").join(b, "b").withColumn("s", resolution.composite_similarity(cfg, names))
    assert got == {(r["a"], r["b"]) for r in scored.where(F.col("s") >= cfg.merge_at).collect()} and got


def test_accents_of_any_alphabet(spark):
    words = ["Źdźbło", "Őz", "\tAna\n", "ΆΛΦΑ", "Йод", "straße", "한글", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(words)), "i int, s string").select("i", scalar.normalized("s").alias("s")).orderBy("i").select("s").collect()]
    assert got[:6] == ["zdzbło", "oz", "ana", "αλφα", "иод", "straße"] and len(got[6]) > 2 and got[7] == ""
    assert spark.range(1).select(scalar.normalized_identifier(F.lit("  AbC\n"))).first()[0] == "abc"


def test_shared_identities_are_counted_without_pairs(spark):
    rng = random.Random(2)
    rows = [(i, *(rng.choice(["p", "q", "r", None]) for _ in range(3)), T0 - dt.timedelta(days=rng.randrange(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, x string, y string, z string, made timestamp")
    got = {r["id"]: r["n_recent"] for r in links.synthetic_identities(df, "id", ["x", "y", "z"], "made", "2024-01-01").collect()}
    recent = [r for r in rows if r[4] >= T0 - dt.timedelta(days=30)]
    want = {r[0]: sum(o[0] != r[0] and any(a is not None and a == b for a, b in zip(r[1:4], o[1:4])) for o in recent) for r in rows}
    assert got == {k: n for k, n in want.items() if n >= 3}


def test_ordered_reports(spark):
    rows = spark.createDataFrame([("a", True), ("b", False), ("b", True), ("c", False)], "s string, d boolean")
    assert [r["segment"] for r in evaluation.bias(rows, "s", "d").collect()] == ["a", "b", "c"]
    star = edges(spark, [(1, k) for k in range(2, 9)] + [(2, 3)])
    v = spark.range(1, 9)
    assert [r["id"] for r in topology.ranked_hubs(topology.hubs(topology.degrees(v, star))).collect()] == [1]
    assert {r["classe"]: r["n"] for r in evaluation.class_tally(rows, "s", "a", "x").collect()} == {"a": 1, "b": 2, "c": 1, "x": 0}


def test_versions_of_several_tables(spark, tmp_path):
    root = str(tmp_path / "graph")
    assert tables.open_version(spark, root) == {}
    a, b = spark.range(2), spark.range(3)
    assert tables.commit({"v": a, "e": b}, root) == 1 and tables.commit({"v": b}, root) == 2
    assert {k: d.count() for k, d in tables.open_version(spark, root, 1).items()} == {"v": 2, "e": 3}
    assert {k: d.count() for k, d in tables.open_version(spark, root).items()} == {"v": 3}
    with pytest.raises(Exception):
        tables.commit({"v": a, "e": b.select(F.raise_error(F.lit("no")).alias("x"))}, root)
    assert tables.latest(spark, root) == 2  # neither table of a failed commit is seen


def test_event_and_edge_upserts(spark):
    old = spark.createDataFrame([("a", 1.0, ["x"], T0, None)], "id_source string, montant double, flags_semantiques array<string>, date_creation timestamp, date_mise_a_jour timestamp")
    new = spark.createDataFrame([("a", 9.0, ["y"]), ("b", 2.0, [])], "id_source string, montant double, flags_semantiques array<string>")
    got = {r["id_source"]: tuple(r)[1:] for r in tables.upsert_events(old, new, "2024-03-01").collect()}
    assert got == {"a": (1.0, ["y"], T0, dt.datetime(2024, 3, 1)), "b": (2.0, [], dt.datetime(2024, 3, 1), None)}
    e = edges(spark, [(1, 2)]).withColumn("type", F.lit("x"))
    more = edges(spark, [(1, 2), (2, 1), (1, 3)]).withColumn("type", F.lit("x"))
    assert sorted(map(tuple, tables.add_edges(e, more, vertices=spark.range(1, 3)).collect())) == [(1, 2, "x"), (2, 1, "x")]


def test_runs_build_on_each_other(spark):
    graph = phases.generate(spark, 60)
    first = phases.run(graph, "2024-07-01 00:00:00")
    assert {r["evolution"] for r in first.communities.collect()} == {"NOUVELLE"}
    second = phases.run(graph, "2024-07-02 00:00:00", before=first)
    assert {r["evolution"] for r in second.communities.collect()} <= {"STABLE", "FUSIONNEE", "EN_TRANSITION", "REORGANISEE", "FRAGMENTEE_SUSPECTE"}
    assert second.event_vertices.count() == first.event_vertices.count() and second.event_links.count() == first.event_links.count()
    assert first.event_vertices.where("date_mise_a_jour is not null").count() == 0
    assert second.event_vertices.where("date_mise_a_jour is null").count() == 0
    ends = {r["seq"] for r in first.event_vertices.collect()}
    assert all(r["src"] in ends and r["dst"] in ends for r in first.event_links.collect())


def test_generated_events(spark):
    graph = phases.generate(spark, 200)
    e = graph.events.join(graph.entities.select(F.col("id").alias("id_entite_source"), "categorie", "id_reseau"), "id_entite_source")
    mean = {r["categorie"]: r["n"] for r in e.groupBy("categorie").agg((F.count("*") / F.count_distinct("id_entite_source")).alias("n")).collect()}
    assert mean["SUSPECT"] > 1.5 * mean["NORMAL"] and mean["FRAUDE"] > 1.5 * mean["NORMAL"]
    ring = e.where(F.col("id_source").contains("-R")).join(graph.entities.select(F.col("id").alias("id_entite_cible"), F.col("id_reseau").alias("other")), "id_entite_cible")
    assert ring.count() == 60 and ring.where("id_reseau <> other or id_entite_source = id_entite_cible").count() == 0
    assert ring.groupBy("id_entite_source").agg(F.count_distinct("id_entite_cible").alias("n")).where("n <> 3").count() == 0
    assert graph.entities.where("categorie = 'SUSPECT'").count() == 30


def test_streams_decide_as_the_batch(spark, tmp_path):
    rows = [
        event(1, "EMAIL", T0, src=1, dst=2), event(2, "TRANSACTION", T0, src=1, dst=9), event(3, "TRANSACTION", T0, src=1, dst=9),
        event(4, "EMAIL", T0, src=None, dst=None), event(5, "APPROBATION", T0 + dt.timedelta(hours=72), src=None, dst=7),
        event(6, "APPROBATION", T0 + dt.timedelta(hours=73), src=None, dst=7),
    ]
    batch = {(r["cause"], r["effect"]) for r in links.causal_links(spark.createDataFrame(rows, EVENT)).collect()}
    s = feed(spark, tmp_path, rows)
    assert {(r["cause"], r["effect"]) for r in run(checks.causal(s, s), "ties").collect()} == batch == {(1, 2), (1, 3), (2, 3), (4, 5)}


def test_a_batch_that_is_played_again_is_written_once(spark, tmp_path):
    batch = spark.createDataFrame([(1, None), (2, "no")], "seq bigint, motif string")
    write = checks.split_sink(str(tmp_path / "ok"), str(tmp_path / "bad"))
    for number in (0, 0, 1, 0):
        write(batch, number)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 2 == spark.read.parquet(str(tmp_path / "bad")).count()


def test_spikes_on_a_stream(spark, tmp_path):
    rows = [event(i, at=T0 + dt.timedelta(minutes=20 * i), ident="a") for i in range(5)] + [event(5 + i, at=T0 + dt.timedelta(minutes=90), ident="a") for i in range(4)]
    got = {r["seq"]: (r["volume"], r["is_spike"]) for r in run(checks.spikes(feed(spark, tmp_path, rows), "id_source", IngestConfig(spike_factor=3.0)), "spikes").collect()}
    want = {r["seq"]: (r["volume"], r["is_spike"]) for r in ingest.mark_spikes(spark.createDataFrame(rows, EVENT), "id_source", IngestConfig(spike_factor=3.0)).collect()}
    assert got == want and any(flag for _, flag in got.values())


def test_replaced_tables_go(spark):
    import os

    a = cluster.materialize(spark.range(5))
    b = cluster.materialize(a.where("id > 2"), instead=a)
    assert b.count() == 2 and not os.path.exists(a._scratch) and os.path.exists(b._scratch)
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    cluster.ship_package(own)
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("1m", "1048576b")
