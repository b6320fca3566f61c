"""Reading tables, projecting them onto the risk model, and writing results."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """A read query over named frames with bound parameters."""
    return spark.sql(sql, args=args or {}, **tables)


def risk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table ``events`` as risk events; arrival order is ``seq``."""
    return as_risk_events(read(spark, sf_dir, "events"))


def as_risk_events(e: DataFrame) -> DataFrame:
    """Rows of table ``events``, at rest or as a stream, as risk events."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.create_map(
        *(F.lit(x) for p in (("purchase", "TRANSACTION"), ("click", "EMAIL"), ("view", "SMS"), ("error", "LOG_ACCES"), ("signup", "APPROBATION")) for x in p)
    )
    source = F.when(F.col("event_id") % 10 == 0, "INCONNU").when(F.col("event_id") % 2 == 0, "INTERNE").otherwise("EXTERNE")
    return e.select(
        F.col("event_id").alias("seq"), F.col("event_id").alias("id_source"),
        F.try_element_at(kind, F.col("event_type")).alias("type_evenement"), source.alias("type_source"),
        F.col("ts").cast("timestamp").alias("horodatage"), F.col("value").alias("montant"),
        F.col("user_id").alias("id_entite_source"), k.alias("id_entite_cible"),
        (k / 100.0).alias("score_corroboration"), (F.col("event_id") % 7).cast("int").alias("nombre_sources"),
        (F.col("event_id") % 4).cast("int").alias("saut_hierarchique"),
    )


def purchase_edges(spark: SparkSession, sf_dir: str, above: float | None = None) -> DataFrame:
    """Distinct directed edges (user, k) of purchases, all or with a value above a limit, loops left out."""
    e = read(spark, sf_dir, "events").where("event_type = 'purchase'")
    if above is not None:
        e = e.where(F.col("value") > above)
    return (
        e.select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("bigint").alias("dst"))
        .where("src <> dst").distinct()
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str], refresh: list[str] | None = None) -> DataFrame:
    """``old`` with ``new``: absent keys are added; of present ones only ``refresh`` columns (all if None) change.

    ``new`` may hold a key several times: the last by its own columns' order wins.
    """
    rest = [c for c in old.columns if c not in keys]
    change = rest if refresh is None else refresh
    one = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in rest)))).where("_n = 1")
    one = one.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in rest), F.lit(True).alias("_is_new"))
    both = old.withColumn("_is_old", F.lit(True)).join(one, keys, "full_outer")

    def value(c: str) -> Column:
        new_c = F.col(f"_new_{c}")
        if c in change:
            return F.when(F.col("_is_new"), new_c).otherwise(F.col(c)).alias(c)
        return F.when(F.col("_is_old"), F.col(c)).otherwise(new_c).alias(c)

    return both.select(*keys, *(value(c) for c in rest))


def upsert_events(old: DataFrame, new: DataFrame, as_of: str, key: str = "id_source") -> DataFrame:
    """Event vertices: new ones are created, of known ones only the flags are refreshed and the update is dated."""
    cols = [c for c in old.columns if c not in ("date_creation", "date_mise_a_jour")]
    now = F.to_timestamp(F.lit(as_of))
    was = old.select(key, F.lit(True).alias("_was"), *(c for c in ("date_creation", "date_mise_a_jour") if c in old.columns)).dropDuplicates([key])
    hit = new.select(key, F.lit(True).alias("_hit")).distinct()
    both = upsert(old.select(*cols), new.select(*cols), [key], refresh=["flags_semantiques"]).join(was, key, "left").join(hit, key, "left")
    created = F.col("date_creation") if "date_creation" in old.columns else F.lit(None).cast("timestamp")
    updated = F.col("date_mise_a_jour") if "date_mise_a_jour" in old.columns else F.lit(None).cast("timestamp")
    return both.select(
        *cols, F.when(F.col("_was"), created).otherwise(now).alias("date_creation"),
        F.when(F.col("_was") & F.col("_hit"), now).otherwise(updated).alias("date_mise_a_jour"),
    )


def add_edges(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("src", "dst", "type"), vertices: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Edges that are not there yet, appended; only between ``vertices``, if these are given."""
    if vertices is not None:
        ids = vertices.select(F.col(id_col).alias("_id")).distinct()
        for end in ("src", "dst"):
            new = new.join(ids, F.col(end) == F.col("_id"), "left_semi")
    return old.unionByName(new.dropDuplicates(list(keys)).join(old, list(keys), "left_anti").select(*old.columns))


def delete_vertices(vertices: DataFrame, edges: DataFrame, ids: DataFrame, key: str = "identifiant") -> tuple[DataFrame, DataFrame]:
    """Vertices without ``ids`` and edges without an end among them."""
    gone = ids.select(F.col(key).alias("_id")).distinct()
    left = vertices.join(gone, F.col(key) == F.col("_id"), "left_anti")
    e = edges.join(gone, F.col("src") == F.col("_id"), "left_anti").join(gone, F.col("dst") == F.col("_id"), "left_anti")
    return left, e


def write_back(vertices: DataFrame, result: DataFrame, key: str = "identifiant") -> DataFrame:
    """``vertices`` with the columns of ``result`` set where it has the key."""
    new = [c for c in result.columns if c != key]
    r = result.select(key, *(F.col(c).alias(f"_r_{c}") for c in new), F.lit(True).alias("_hit"))
    out = vertices.join(r, key, "left")
    for c in new:
        old = F.col(c) if c in vertices.columns else F.lit(None)
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_r_{c}")).otherwise(old))
    return out.select(*dict.fromkeys([*vertices.columns, *new]))


def reject_records(rejected: DataFrame, as_of: str) -> DataFrame:
    """Audit rows of rejected events: a key, the reason, and the record as JSON of at most 500 characters."""
    record = F.to_json(F.struct(*(c for c in rejected.columns if c not in ("motif", "flags_semantiques"))))
    return rejected.select(
        F.expr("uuid()").alias("identifiant_rejet"),
        F.coalesce(F.col("id_source").cast("string"), F.lit("INCONNU")).alias("identifiant_source"),
        F.coalesce("type_evenement", F.lit("INCONNU")).alias("type_evenement"), F.col("motif").alias("motif_rejet"),
        F.to_timestamp(F.lit(as_of)).alias("horodatage_rejet"), F.left(record, F.lit(500)).alias("donnees_brutes"),
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Writes one immutable version of a table and reads it back."""
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


def commit(frames: dict[str, DataFrame], root: str) -> int:
    """Writes several tables as one version of ``root``; all of them become visible together, or none.

    Each goes into a folder of its own. Then a manifest with the next number names the
    folders; it is written aside and renamed, which succeeds for one writer only.
    """
    spark = next(iter(frames.values())).sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(conf)
    version = latest(spark, root) + 1
    mark = uuid.uuid4().hex
    folders = {name: f"{root.rstrip('/')}/data/{name}-{mark}" for name in frames}
    for name, df in frames.items():
        df.write.mode("error").parquet(folders[name])
    aside = path(f"{root.rstrip('/')}/manifest-{mark}.tmp")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(folders).encode()))
    out.close()
    final = path(f"{root.rstrip('/')}/manifest-{version:09d}.json")
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        raise RuntimeError(f"another writer has made version {version} of {root}")
    return version


def latest(spark: SparkSession, root: str) -> int:
    """The number of the last version of ``root``, 0 before the first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(root)
    found = folder.getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/manifest-*.json"))
    return max((int(f.getPath().getName()[9:-5]) for f in found or ()), default=0)


def open_version(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of one version of ``root``, the last by default; none before the first."""
    version = latest(spark, root) if version is None else version
    if not version:
        return {}
    text = spark.read.text(f"{root.rstrip('/')}/manifest-{version:09d}.json", wholetext=True).first()[0]
    return {name: spark.read.parquet(folder) for name, folder in json.loads(text).items()}


def wipe(spark: SparkSession, path: str, schema, sure: bool = False) -> None:
    """Replaces a table by an empty one; only on explicit request."""
    if not sure:
        raise ValueError("pass sure=True to empty a table")
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def violations(df: DataFrame, key: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows against the constraints: keys that are null or not unique, and required columns that are null."""
    twice = df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull())
    out = twice.select(F.col(key).cast("string").alias("key"), F.lit("unique").alias("rule"), F.col("count").alias("n"))
    for c in required:
        lost = df.where(F.col(c).isNull()).groupBy(F.col(key).cast("string").alias("key")).count()
        out = out.unionByName(lost.select("key", F.lit(f"required {c}").alias("rule"), F.col("count").alias("n")))
    return out
