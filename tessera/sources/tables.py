"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.session import settle


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Scan `<folder>/<name>.parquet` (a file or a directory of parts).

    Only the named columns are read; with none named, all of them.
    """
    settle(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
