"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.session import settle

#: The shuffle files of a write are of no use when it is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: list[tuple[object, object]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a temporary folder; on a
    cluster a missing setting is an error, since a machine-local folder would
    not be seen by the other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write `df` as parquet into the shared folder and return a scan of it.

    Unlike an RDD checkpoint the copy is columnar and compressed, and later
    scans prune columns. The folders are removed when the driver ends.
    """
    spark = df.sparkSession
    settle(spark)
    path = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    kept = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, kept) if kept is not None else spark.conf.unset(_CLEANUP)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    _WRITTEN.append((where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where))
    scan = spark.read.schema(df.schema).parquet(path)
    scan._durable = _WRITTEN[-1]
    return scan


def release(*scans: DataFrame) -> None:
    """Remove the copies that `durable` gave, once nothing reads them any more; what was derived from them without a copy can't be read then."""
    for scan in scans:
        _WRITTEN.remove(scan._durable)
        fs, where = scan._durable
        fs.delete(where, True)


@atexit.register
def _clean() -> None:
    for fs, where in _WRITTEN:
        try:
            fs.delete(where, True)
        except Exception:  # the JVM may have ended first
            break
