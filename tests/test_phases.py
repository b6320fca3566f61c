"""The phases over a generated graph."""

import pytest
from pyspark.sql import functions as F

from riskgraph.plans import phases

AS_OF = "2024-07-01 00:00:00"
N = 120


@pytest.fixture(scope="module")
def done(spark):
    graph = phases.generate(spark, N)
    return graph, phases.run(graph, AS_OF)


def test_generated_links(done):
    graph, _ = done
    e = graph.edges
    assert {r["type"] for r in e.select("type").distinct().collect()} == {"PARTAGE_IP", "PARTAGE_ADRESSE", "COSIGNATURE", "CAUSE_DE"}
    assert e.where("src = dst").count() == 0 and e.count() == e.select("src", "dst", "type").distinct().count()
    assert e.where("type <> 'CAUSE_DE' and src >= dst").count() == 0
    # 12 ring members in 5 rings: two rings of 3 and three of 2 make 2 * 3 + 3 pairs
    assert e.where("type = 'COSIGNATURE'").count() == 9
    assert sorted(r["seq"] for r in graph.events.collect()) == list(range(graph.events.count()))


def test_every_event_is_accepted_or_rejected(done):
    graph, out = done
    assert out.accepted.count() + out.rejects.count() == graph.events.count()
    assert out.rejects.where("motif_rejet is null").count() == 0


def test_every_entity_is_merged_or_decided(done):
    graph, out = done
    merged = {r["merged"] for r in out.merges.collect()}
    rows = out.entities.collect()
    assert {r["id"] for r in rows} | merged == set(range(N)) and not {r["id"] for r in rows} & merged
    assert all(r["decision_fraude"] in ("NORMAL", "FRAUDE_SUSPECTEE") and 0 <= r["score_risque"] <= 1 for r in rows)
    linked = {x for e in out.edges.select("src", "dst").collect() for x in e}
    assert not linked & merged and {r["id"] for r in rows if r["id_communaute"] is not None} == linked
    assert out.features.count() == len(rows)


def test_summary_and_evaluation(done):
    _, out = done
    got = {r["measure"]: r["n"] for r in out.summary().collect()}
    assert got["accepted"] == out.accepted.count() and got["links with confidence"] == out.edges.count()
    m = out.metrics.first()
    held = out.entities.count() - int(out.entities.count() * 0.7)
    assert m["tp"] + m["fp"] + m["fn"] + m["tn"] == held
    assert {r["segment"] for r in out.bias.collect()} <= set(phases.generator.SEGMENTS)
    assert out.retrain.first()["nouveaux_labels"] == out.entities.where("label_verite is not null").count()


def test_scoring_one_entity(done):
    _, out = done
    got = phases.score_one(out, 7).collect()
    assert len(got) == 1 and got[0]["id"] == 7 and 0 <= got[0]["score_risque"] <= 1


def test_labels_move_neighbours(spark, done):
    _, out = done
    link = out.edges.where("type = 'CAUSE_DE'").orderBy("src", "dst").first()
    labels = spark.createDataFrame([(link["src"], "FRAUDE")], "id bigint, label string")
    after = phases.record_label(out, labels).entities
    assert after.where((F.col("id") == link["src"]) & (F.col("label_verite") == "FRAUDE")).count() == 1
    old = out.entities.where(F.col("id") == link["dst"]).first()["score_risque"]
    assert after.where(F.col("id") == link["dst"]).first()["score_risque"] >= old
    before = out.entities.where("label_verite is not null").where(F.col("id") != link["src"]).count()
    assert after.where("label_verite is not null").where(F.col("id") != link["src"]).count() == before > 0
