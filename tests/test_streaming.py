"""Stateful validators on file streams."""

import datetime as dt

from pyspark.sql import functions as F

from riskgraph.streaming import checks
from tests.test_operators import EVENT, T0, event


def feed(spark, tmp_path, rows):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], EVENT).schema).parquet(path)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_dedup_and_rules(spark, tmp_path):
    rows = [event(1, ident="a"), event(2, ident="a"), event(3, kind="X", ident="b")]
    s = checks.stateless(checks.dedup(feed(spark, tmp_path, rows), ["id_source"]), "2024-01-02 00:00:00")
    got = run(s, "dedup")
    assert got.count() == 2 and got.where("motif is null").count() == 1


def test_volumes(spark, tmp_path):
    rows = [event(i, at=T0 + dt.timedelta(minutes=i), ident="a") for i in range(3)]
    got = run(checks.volumes(feed(spark, tmp_path, rows), "id_source"), "volumes", "update")
    assert got.agg(F.max("volume")).first()[0] == 3


def test_outliers(spark, tmp_path):
    rows = [event(i, amount=10.0, at=T0 + dt.timedelta(seconds=i)) for i in range(10)] + [event(10, amount=99.0, at=T0 + dt.timedelta(hours=1))]
    got = run(checks.outliers(feed(spark, tmp_path, rows)), "outliers")
    assert [r["seq"] for r in got.where("is_outlier").collect()] == [10]


def test_causal_streams(spark, tmp_path):
    s = feed(spark, tmp_path, [event(1, "EMAIL"), event(2, "TRANSACTION", T0 + dt.timedelta(hours=1))])
    got = run(checks.causal(s, s), "causal")
    assert [(r["cause"], r["effect"]) for r in got.collect()] == [(1, 2)]


def test_split_sink(spark, tmp_path):
    s = checks.stateless(feed(spark, tmp_path, [event(1), event(2, kind="X")]), "2024-01-02 00:00:00")
    q = s.writeStream.foreachBatch(checks.split_sink(str(tmp_path / "ok"), str(tmp_path / "bad"))).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1 == spark.read.parquet(str(tmp_path / "bad")).count()
