"""Session settings used by tests, the bench and local work."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def settle(spark: SparkSession) -> None:
    """Turn off a planner feature of Spark 4.1 that fails with adaptive execution.

    A union of sides with equal hash partitioning keeps that partitioning, and its
    partitions are zipped; when adaptive execution has made the sides' partitions fewer in
    different ways, the job ends with "Can't zip RDDs with unequal numbers of partitions".
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with UTC time, AQE and Arrow on; `conf` adds or replaces settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= conf
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = SparkSession.builder.master(f"local[{cores}]").appName("tessera").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
