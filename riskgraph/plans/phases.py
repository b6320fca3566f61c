"""The eight phases in order, and the smaller entry points, as compositions of operators.

Every phase reads all that the one before kept, and its result is written to the
shared folder, so a later phase never recomputes an earlier one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.config import FeedbackConfig, GraphConfig, IngestConfig, ResolutionConfig, ScoringConfig
from riskgraph.functions.cluster import materialize
from riskgraph.operators import communities, confidence, evaluation, ingest, links, resolution, scoring, topology
from riskgraph.sources import generator, tables

#: Attributes of which any shared one makes two identities suspicious.
IDENTITY = ["email", "adresse_ip", "telephone"]


@dataclass(frozen=True)
class Settings:
    ingest: IngestConfig = IngestConfig()
    resolution: ResolutionConfig = ResolutionConfig()
    graph: GraphConfig = GraphConfig()
    scoring: ScoringConfig = ScoringConfig()
    feedback: FeedbackConfig = FeedbackConfig()
    forest: bool = True  # False: the heuristic that needs no training


@dataclass(frozen=True)
class Graph:
    """Entities by ``id``, raw events by ``seq`` and links by ``src, dst, type``; ids are whole numbers."""

    entities: DataFrame
    events: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Outcome:
    """What the phases leave behind; ``entities`` carries rank, hub flag, community, score and decision."""

    entities: DataFrame
    accepted: DataFrame
    rejects: DataFrame
    merges: DataFrame
    event_vertices: DataFrame
    event_links: DataFrame
    edges: DataFrame
    features: DataFrame
    cliques: DataFrame
    closeness: DataFrame
    communities: DataFrame
    metrics: DataFrame
    bias: DataFrame
    retrain: DataFrame

    def summary(self) -> DataFrame:
        """``phase, measure, n``: the counts of each phase."""
        def n(phase: int, measure: str, df: DataFrame) -> DataFrame:
            return df.agg(F.lit(phase).alias("phase"), F.lit(measure).alias("measure"), F.count("*").alias("n"))

        parts = [
            n(1, "accepted", self.accepted), n(1, "rejected", self.rejects), n(2, "merged", self.merges),
            n(3, "causal links", self.event_links), n(3, "inactive links", self.edges.where("inactif")),
            n(4, "hubs", self.entities.where("est_hub")), n(4, "cliques", self.cliques), n(5, "links with confidence", self.edges),
            n(6, "communities", self.communities), n(7, "suspects", self.entities.where("decision_fraude <> 'NORMAL'")),
            n(8, "segments", self.bias),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def _number(c: str) -> Column:
    return F.substring(c, 5, 8).cast("bigint")


def generate(spark: SparkSession, n: int = 1000, seed: int = 42, as_of: str = "2024-07-01") -> Graph:
    """A seeded graph; entity keys become whole numbers."""
    ents = materialize(generator.entities(spark, n, seed, as_of))
    ev = generator.events(ents, seed, as_of)
    ev = ev.withColumns({c: _number(c) for c in ("id_entite_source", "id_entite_cible")})
    arrived = ingest.with_position(ev, ["horodatage", "id_source"], "seq")
    e = generator.edges(ents, seed, as_of).withColumns({c: _number(c) for c in ("src", "dst")})
    return Graph(
        ents.withColumn("id", _number("identifiant")), materialize(arrived), materialize(e)
    )


def build_graph(
    accepted: DataFrame, edges: DataFrame, as_of: str, cfg: GraphConfig | None = None,
    vertices: DataFrame | None = None, event_edges: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phase 3: event vertices, causal links between events, and links marked inactive by age.

    ``vertices`` and ``event_edges`` are those of earlier runs: known events get their
    flags refreshed, links that are there stay as they are, and new ones need both ends.
    """
    cols = ["id_source", "seq", "type_evenement", "horodatage", "montant", "id_entite_source", "id_entite_cible", "flags_semantiques"]
    fresh = accepted.select(*cols)
    old = fresh.limit(0) if vertices is None else vertices
    events = tables.upsert_events(old, fresh, as_of)
    found = links.causal_links(accepted, cfg).select(
        F.col("cause").alias("src"), F.col("effect").alias("dst"), F.lit("CAUSE_DE").alias("type"), "delta_secondes",
        F.to_timestamp(F.lit(as_of)).alias("date_creation"),
    )
    known = found.limit(0) if event_edges is None else event_edges
    return events, tables.add_edges(known, found, vertices=events, id_col="seq"), links.mark_inactive(edges, "date_creation", as_of, cfg)


def analyse(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Phase 4: ranks, hubs, cliques of sharing links, closeness; ranks run on causal links."""
    causal = edges.where("type = 'CAUSE_DE'").select("src", "dst")
    shared = edges.where("type <> 'CAUSE_DE'").select("src", "dst").distinct()
    ranks = materialize(topology.pagerank(causal))
    hubs = materialize(topology.hubs(topology.degrees(vertices.select("id"), edges.select("src", "dst"))))
    return ranks, hubs, topology.cliques(shared), topology.closeness(causal)


def first_scores(features: DataFrame, cfg: Settings) -> DataFrame:
    """Scores of the forest, or of the heuristic that needs no training."""
    if cfg.forest:
        return scoring.isolation_scores(features, "id", list(scoring.FEATURES), cfg.scoring)
    return scoring.heuristic(features)


def score(
    vertices: DataFrame, edges: DataFrame, events: DataFrame, ranks: DataFrame, hubs: DataFrame, members: DataFrame,
    synthetic: DataFrame, merges: DataFrame, as_of: str, cfg: Settings,
) -> tuple[DataFrame, DataFrame]:
    """Phase 7: features, and score and decision of every vertex in one job."""
    merged = merges.groupBy(F.col("survivor").alias("id")).agg(F.count("*").alias("nb_fusions"))
    found = scoring.features(
        vertices, edges, ranks=ranks, members=members, cohesions=communities.cohesion(edges, members), hub_flags=hubs,
        events=events, as_of=as_of, synthetic=synthetic, merges=merged,
    )
    found = materialize(found)
    first = first_scores(found, cfg)
    spread = scoring.propagate(vertices.select("id", F.col("score_risque").alias("risk")), edges, cfg.scoring)
    return found, materialize(scoring.composite(vertices, first, spread, cfg.scoring))


def evaluate(scored: DataFrame, cfg: FeedbackConfig | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phase 8: metrics on the held-out part, rates by segment, and whether to train again."""
    rows = scored.select(
        "id", "segment", "label_verite", F.coalesce(F.col("label_verite") == "FRAUDE", F.lit(False)).alias("truth"),
        (F.col("decision_fraude") != "NORMAL").alias("detected"),
    )
    return (
        evaluation.confusion(evaluation.held_out(rows, "id", cfg), "truth", "detected"),
        evaluation.bias(rows, "segment", "detected", cfg),
        evaluation.retrain_trigger(rows, "label_verite", None, cfg),
    )


def run(graph: Graph, as_of: str, cfg: Settings | None = None, before: Outcome | None = None) -> Outcome:
    """All phases over the whole graph.

    ``before`` is the outcome of the run before: its communities are what evolution is
    told against, and its event vertices and links are added to. Without it every
    community is new.
    """
    cfg = cfg or Settings()
    checked = materialize(ingest.validate(graph.events, as_of, cfg.ingest))
    accepted = checked.where("motif is null")
    rejects = materialize(tables.reject_records(checked.where("motif is not null"), as_of))

    merges = materialize(resolution.resolve(graph.entities.select("id", *_attributes(graph.entities, cfg)), "id", cfg.resolution))
    entities, moved = resolution.merge(graph.entities, graph.edges, merges, "id")
    entities = materialize(entities)

    earlier = (before.event_vertices, before.event_links) if before else (None, None)
    event_vertices, event_links, marked = build_graph(accepted, moved, as_of, cfg.graph, *earlier)
    event_vertices, event_links, edges = materialize(event_vertices), materialize(event_links), materialize(marked)

    ranks, hubs, cliques, closeness = analyse(entities, edges)

    # a link that events say nothing about keeps the confidence it was created with
    facts = confidence.event_facts(accepted)
    known = confidence.link_confidence(edges, facts, as_of).join(facts.select("src", "dst"), ["src", "dst"], "left_semi")
    fresh = known.withColumnRenamed("score_confiance", "fresh")
    edges = edges.join(fresh, ["src", "dst"], "left").withColumn("score_confiance", F.coalesce("fresh", "score_confiance")).drop("fresh")
    edges = materialize(edges)

    one = edges.groupBy("src", "dst").agg(F.max("score_confiance").alias("weight"))
    members = materialize(communities.detect(one))
    created = entities.select("id", "date_creation")
    known = before.entities.select("id", "id_communaute") if before else members.limit(0)
    groups = materialize(communities.summary(edges, members, created, known.where("id_communaute is not null"), as_of))

    synthetic = links.synthetic_identities(entities, "id", IDENTITY, "date_creation", as_of, cfg.resolution)
    found, decided = score(entities, edges, accepted, ranks, hubs, members, synthetic, merges, as_of, cfg)
    done = entities.drop("score_risque")
    for part in (ranks, hubs.select("id", "est_hub"), members, decided):
        done = tables.write_back(done, part, "id")
    done = materialize(done)
    metrics, bias, retrain = evaluate(done, cfg.feedback)
    return Outcome(done, accepted, rejects, merges, event_vertices, event_links, edges, found, cliques, closeness, groups, metrics, bias, retrain)


def _attributes(entities: DataFrame, cfg: Settings) -> list[str]:
    return [name for name, _ in cfg.resolution.weights if name in entities.columns]


def score_one(outcome: Outcome, key, cfg: Settings | None = None) -> DataFrame:
    """Score and decision of one entity from its stored features, as the batch scores it; the filter reaches the scans."""
    cfg = cfg or Settings()
    ids = outcome.entities.where(F.col("id") == F.lit(key))
    out = outcome.edges.where(F.col("src") == F.lit(key))
    risks = outcome.entities.join(out.select(F.col("dst").alias("id")).distinct(), "id", "left_semi").unionByName(ids)
    spread = scoring.propagate(risks.select("id", F.col("score_risque").alias("risk")).distinct(), out, cfg.scoring)
    first = first_scores(outcome.features, cfg).where(F.col("id") == F.lit(key))
    return scoring.composite(ids, first, spread, cfg.scoring)


def record_label(outcome: Outcome, labels: DataFrame, cfg: Settings | None = None) -> Outcome:
    """Stores labels (``id, label``) and moves the risks of neighbours and of cohesive communities."""
    cfg = cfg or Settings()
    done = evaluation.record_labels(outcome.entities, labels)
    risk = done.select("id", F.col("score_risque").alias("risk"))
    near = evaluation.feedback_neighbours(risk, outcome.edges, labels, cfg.feedback)
    risk = tables.write_back(done, near, "id").select("id", F.col("score_risque").alias("risk"))
    members = outcome.entities.where("id_communaute is not null").select("id", "id_communaute")
    cohesions = outcome.communities.select("id_communaute", "cohesion")
    wide = evaluation.feedback_community(risk, members, cohesions, labels, cfg.feedback)
    done = tables.write_back(tables.write_back(done, near, "id"), wide, "id")
    return replace(outcome, entities=materialize(done))
