"""Concepts: samples from outside a cluster, validation, merging of concepts alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import CONFIG
from tessera.functions.vectors import cosine
from tessera.operators.consolidate import merge_candidates


def sample_rows(df: DataFrame, id: str, n: int = 50, seed: str = "") -> DataFrame:
    """n rows that are as good as random and the same in every run: the least hashes of id and seed."""
    return df.orderBy(F.md5(F.concat(F.col(id).cast("string"), F.lit(seed))), id).limit(n)


def non_members(clusters: DataFrame, rows: DataFrame, id: str, sample: int = 50, n: int = 3) -> DataFrame:
    """(cluster, others): up to n ids outside each cluster (cluster, members), from one sample of `sample` rows.

    The sample has a fixed size, so it travels as a constant; clusters aren't paired with rows.
    """
    ids = [r[0] for r in sample_rows(rows.select(id), id, sample).collect()]
    kind = rows.schema[id].dataType.simpleString()
    picked = F.array(*[F.lit(x) for x in ids]).cast(f"array<{kind}>")
    return clusters.select("cluster", F.slice(F.filter(picked, lambda x: ~F.array_contains("members", x)), 1, n).alias("others"))


def validation(clusters: DataFrame, rows: DataFrame, id: str, n: int = 3) -> DataFrame:
    """(cluster, score): how much nearer to the cluster's vector its first members are than rows outside it, from 0 to 1.

    clusters: cluster, members, v. rows: id, v. A stand-in for a model's judgement; without
    members or without rows outside the score is 0.5.
    """
    out = non_members(clusters, rows, id, n=n).withColumnRenamed("cluster", "k")
    sides = clusters.join(out, F.col("cluster") == F.col("k")).select("cluster", F.col("v").alias("c"), F.slice(F.array_sort("members"), 1, n).alias("ins"), "others")
    flat = sides.select("cluster", "c", F.explode("ins").alias(id), F.lit(1).alias("inside")).unionByName(sides.select("cluster", "c", F.explode("others").alias(id), F.lit(0).alias("inside")))
    near = flat.join(rows.select(id, "v"), id).select("cluster", "inside", cosine(F.col("c"), F.col("v")).alias("sim"))
    mean = near.groupBy("cluster").agg(F.avg(F.when(F.col("inside") == 1, F.col("sim"))).alias("a"), F.avg(F.when(F.col("inside") == 0, F.col("sim"))).alias("b"))
    margin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("a") - F.col("b")))
    score = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), margin).otherwise(0.5)
    return clusters.select("cluster").join(mean, "cluster", "left").select("cluster", score.alias("score"))


def alike(concepts: DataFrame, jaccard: float = CONFIG.merge_jaccard, least: float = CONFIG.merge_cosine) -> DataFrame:
    """(a, b, jaccard, sim): pairs of concepts of one database that overlap and whose vectors are alike. concepts: concept_id, database_id, members, v."""
    pairs = merge_candidates(concepts, jaccard)
    x = concepts.select(F.col("concept_id").alias("a"), F.col("v").alias("va"))
    y = concepts.select(F.col("concept_id").alias("b"), F.col("v").alias("vb"))
    scored = pairs.join(x, "a").join(y, "b").select("a", "b", "jaccard", cosine(F.col("va"), F.col("vb")).alias("sim"))
    return scored.where(F.col("sim") >= least)


def cluster_prompt(texts: Column, n: int = 10, chars: int = 300) -> Column:
    """What a summariser is given of a cluster: the beginnings of its first texts, numbered."""
    return F.array_join(F.transform(F.slice(texts, 1, n), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(x, 1, chars))), "\n")
