"""The graph of connections carried over to the vectors, for queries that need both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import views


def _vector_of(c: str, n: int) -> Column:
    """A chunk's vector: the first six hexadecimal digits of its id, modulo the number of vectors."""
    head = F.substring(F.lower(c), 1, 6)
    return F.when(head.rlike("^[0-9a-f]{6}$"), F.conv(head, 16, 10).cast("long") % n)


def vector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, relationship, w) between vectors."""
    n = views.vectors(spark, sf_dir).count()
    e = views.edges(spark, sf_dir).where("weight <= 1").select(_vector_of("source_chunk", n).alias("source"), _vector_of("target_chunk", n).alias("target"), "relationship", "weight")
    return e.where("source is not null and target is not null and source <> target").groupBy("source", "target", "relationship").agg(F.max("weight").alias("w"))


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, chunk_id, source, text): of each vector's chunks the one of least id."""
    n = views.vectors(spark, sf_dir).count()
    c = views.chunks(spark, sf_dir).select(_vector_of("chunk_id", n).alias("vec_id"), "chunk_id", "source", "text").where("vec_id is not null")
    return c.groupBy("vec_id").agg(F.min(F.struct("chunk_id", "source", "text")).alias("c")).select("vec_id", "c.*")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query vectors (q, v, database_id): every vector whose id is divisible by 20."""
    return views.vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "v", "database_id")


def vector_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(concept_id, members, v, confidence): a concept for each label, its vector the mean of its members'."""
    from tessera.operators.clusters import centroids

    t = views.vectors(spark, sf_dir)
    members = t.groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    mean = centroids(t.select(F.col("label").alias("k"), "v"))
    return members.join(mean, F.col("label") == F.col("k")).select(F.col("label").cast("int").alias("concept_id"), "members", "v", (0.3 + 0.05 * F.col("label")).alias("confidence"))
