"""What operators need from the cluster: their own code on executors, and a shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Bytes of an Arrow batch, where the session has no limit of its own; it bounds a Python worker's memory.
ARROW_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Removes a query's shuffle files at its end instead of when the driver next collects garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once per application.

    The package is zipped on the driver and handed to ``addPyFile``, so executors
    fetch it from the driver and no path has to exist on their machines. Batches of
    long rows are bounded by their bytes, which changes no result; the number of rows
    in a batch stays the session's.
    """
    if spark.conf.get(_BATCH) == "67108864b":  # the default
        spark.conf.set(_BATCH, ARROW_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.dirname(root)
    target = os.path.join(tempfile.mkdtemp(prefix="riskgraph_"), "riskgraph.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, base))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, as in tests, a temporary folder
    is used instead; on a cluster that would be one machine's own, so it is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if path:
        if current.isEmpty():
            sc.setCheckpointDir(path)
        return path
    if current.isDefined():
        return current.get()
    if sc.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="riskgraph_ck_"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/riskgraph/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """Writes ``df`` into the shared folder as Parquet and reads it back.

    This cuts lineage: a lost executor costs a re-read of files, never a
    recomputation of what came before. The shuffle files of the write go at its end. The
    files of ``instead``, an earlier result of this function that nobody reads any more,
    are removed; all others stay until ``release``, ``clean`` or until the folder goes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    tidy = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, tidy)
    if instead is not None:
        release(instead)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes the files of results of ``materialize`` that nobody reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._scratch)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clean(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application; frames that still read them fail afterwards."""
    _remove(spark, f"{shared_dir(spark).rstrip('/')}/riskgraph/{spark.sparkContext.applicationId}")


def hash_sample(df: DataFrame, keys: list[str], limit: int, salt: str) -> DataFrame:
    """At most ``limit`` rows, the first by a hash of ``keys``; the same ones whatever the partitioning.

    Rows beyond 1.5 times the hash that ``limit`` should reach are dropped before
    sorting, so what partitions send to the driver is bounded by the limit and
    doesn't grow with their number.
    """
    from pyspark.sql import functions as F

    n = df.count()
    h = F.xxhash64(*keys, F.lit(salt))
    out = df
    if n > 2 * limit:
        share = 1.5 * limit / n + 1e-6
        out = out.where(h < F.lit(int(-(2**63) + min(share, 0.999) * 2**64)))
    return out.orderBy(h, *keys).limit(limit)
