"""The canonical tables: one row per record, one time type, known databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT_DATABASE
from tessera.sources.tables import table


def database(c: str = "database_id") -> Column:
    """Null and empty database ids as the default one."""
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(DEFAULT_DATABASE))


def moment(c: str) -> Column:
    """A timestamp (UTC) from any of the text formats in use; null where there is none. Fractions of a second go."""
    return F.date_trunc("second", F.col(c).try_cast("timestamp"))


def node_id(c: str) -> Column:
    return F.nullif(F.lower(F.trim(F.col(c), F.lit(" \t"))), F.lit(""))


def one_row(t: DataFrame, key: str, *order: str) -> DataFrame:
    """Of the rows of each key the greatest by the columns of `order`, then by all others; nulls come last. Rows are taken whole, so none comes out that never was."""
    cols = [*order, *(c for c in t.columns if c != key and c not in order)]
    return t.groupBy(key).agg(F.max(F.struct(*cols)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in t.columns if c != key])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk_id: of rows delivered twice the one of the greatest access count, the latest; then the latest by its times."""
    t = table(spark, sf_dir, "chunks").where("chunk_id is not null")
    t = t.withColumns({"timestamp": moment("timestamp"), "last_accessed": moment("last_accessed"), "database_id": database()})
    return one_row(t, "chunk_id", "access_count", "last_accessed", "timestamp", "text", "source", "page", "tags", "metadata", "is_duplicate", "contradiction_flag", "database_id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (source, target, relationship): the edge made first. Edges without both ends or without a weight that is a number are left out."""
    t = table(spark, sf_dir, "connections").withColumns(
        {"source_chunk": node_id("source_chunk"), "target_chunk": node_id("target_chunk"), "database_id": database(), "created_at": moment("created_at"), "last_reinforced": moment("last_reinforced"), "last_seen": moment("last_seen")}
    )
    t = t.where("source_chunk is not null and target_chunk is not null and weight is not null and not isnan(weight)")
    keys = ["source_chunk", "target_chunk", "relationship"]
    rest = [c for c in t.columns if c not in keys]
    first = t.groupBy(*keys).agg(F.min(F.struct("created_at", "edge_id", *[c for c in rest if c not in ("created_at", "edge_id")])).alias("e"))
    return first.select(*keys, *[F.col(f"e.{c}").alias(c) for c in rest])


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per concept_id: the last update; `members` is the array of its member ids (normalised), `embedding_version` and `version` are never null."""
    from tessera.functions.text import json_ids

    t = table(spark, sf_dir, "concepts").where("concept_id is not null").withColumns({"database_id": database(), "created_at": moment("created_at"), "last_updated": moment("last_updated")})
    t = t.groupBy("concept_id").agg(F.max(F.struct("last_updated", *[c for c in t.columns if c not in ("concept_id", "last_updated")])).alias("c")).select("concept_id", "c.*")
    ids = F.filter(F.transform(json_ids(F.col("member_chunks")), lambda x: F.lower(F.trim(x, F.lit(" \t")))), lambda x: x != "")
    return t.withColumns({"members": F.array_sort(F.array_distinct(ids)), "version": F.coalesce("version", F.lit(1)), "embedding_version": F.coalesce("embedding_version", F.lit(0))})


def ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "ingest_events").where("event_id is not null").withColumns({"timestamp": moment("timestamp"), "database_id": database()})
    return one_row(t, "event_id", "timestamp", "chunks_stored", "chunks_skipped", "connections_seeded", "source", "tags", "database_id")


def co_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event; `ids` is the array of its distinct chunk ids in their order."""
    from tessera.functions.text import json_ids

    t = table(spark, sf_dir, "co_access_events").where("event_id is not null").withColumn("database_id", database())
    t = one_row(t, "event_id", "timestamp", "chunk_ids", "query_hash", "database_id", "query_embedding")
    return t.withColumn("ids", F.array_distinct(F.transform(json_ids(F.col("chunk_ids")), lambda x: F.lower(F.trim(x, F.lit(" \t"))))))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main vector collection: vec_id, v (doubles), label, database_id."""
    t = table(spark, sf_dir, "embeddings")
    return t.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label", F.concat(F.lit("db"), F.col("label") % 2).alias("database_id"))
