"""Graph queries over all purchases, and community moves to their end."""

from riskgraph.operators import communities
from riskgraph.plans import catalogue


def test_moves_go_on_until_none_moves(spark):
    # weights grow along the path, so each pass carries the last label one vertex further
    path = [(i, i + 1, float(i + 1)) for i in range(40)]
    e = spark.createDataFrame(path, "src bigint, dst bigint, weight double")
    assert {r["id_communaute"] for r in communities.detect(e).collect()} == {0}
    assert communities.detect(e).count() == 41


def test_queries_without_sql_see_every_purchase(spark, small):
    bought = spark.read.parquet(f"{small}/events.parquet").where("event_type = 'purchase'")
    pairs = bought.selectExpr("user_id", "cast(get_json_object(props, '$.k') as bigint) k").where("user_id <> k").collect()
    ids = {x for p in pairs for x in p}
    assert {r["id"] for r in catalogue.pagerank_converged(spark, small).collect()} == ids
    assert {r["id"] for r in catalogue.communities(spark, small).collect()} == ids
