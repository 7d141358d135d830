"""Scores of candidates: fusion, rescoring, layers, re-ranking, cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import CONFIG


def fused(vec: Column, graph: Column, prior: Column | float = 0.0, influence: Column | float = 0.0) -> Column:
    """Weighted sum of vector score, graph score and the learned prior with its influence."""
    p = prior if isinstance(prior, Column) else F.lit(prior)
    i = influence if isinstance(influence, Column) else F.lit(influence)
    return CONFIG.vector_weight * F.coalesce(vec, F.lit(0.0)) + CONFIG.graph_weight * F.coalesce(graph, F.lit(0.0)) + i * p


def rescored(df: DataFrame, score: str = "score", exponent: float = CONFIG.rescore_exponent) -> DataFrame:
    """Scores as top * (score / top) ** exponent within each query `q`; unchanged where the top isn't positive. Negative scores count as 0."""
    top = F.max(score).over(Window.partitionBy("q"))
    s = F.greatest(F.col(score), F.lit(0.0))
    return df.withColumn("_top", top).withColumn(score, F.when(F.col("_top") <= 0, F.col(score)).otherwise(F.col("_top") * F.pow(s / F.col("_top"), F.lit(exponent)))).drop("_top")


def merge_layers(*layers: DataFrame) -> DataFrame:
    """One row per (q, id): that of the greatest score, of equal ones that of the first layer. Layers: q, id, score, layer."""
    union = None
    for i, df in enumerate(layers):
        part = df.select("q", "id", "score", "layer", F.lit(i).alias("_n"))
        union = part if union is None else union.unionByName(part)
    best = union.groupBy("q", "id").agg(F.min(F.struct((-F.col("score")).alias("s"), "_n", "layer")).alias("b"))
    return best.select("q", "id", (-F.col("b.s")).alias("score"), F.col("b.layer").alias("layer"))


def ranked(df: DataFrame, boost: float = CONFIG.concept_boost) -> DataFrame:
    """(.., score, rank): rows of the concept layer get the boost, then all are ranked within `q`."""
    out = df.withColumn("score", F.col("score") + F.when(F.col("layer") == "concept", boost).otherwise(0.0))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id")))


def blended(df: DataFrame, rerank: str = "rerank_score", weight: float = CONFIG.rerank_weight) -> DataFrame:
    """Scores mixed with those of a re-ranker; rows without one (null) keep theirs."""
    return df.withColumn("score", F.when(F.col(rerank).isNull(), F.col("score")).otherwise((1 - weight) * F.col("score") + weight * F.col(rerank)))


def top_k(df: DataFrame, k: int, least: float | None = None, candidates: int | None = None) -> DataFrame:
    """The k best of each query. Of `candidates` best ones, if given, only those with at least `least` count; a query with a single row keeps it."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    out = df.withColumns({"_n": F.count("*").over(Window.partitionBy("q")), "rank": F.row_number().over(w)})
    if candidates is not None:
        out = out.where(F.col("rank") <= candidates)
    if least is not None:
        out = out.where((F.col("score") >= least) | (F.col("_n") <= 1))
    # a floor cuts the end of a ranking only, so ranks have no gaps
    return out.where(F.col("rank") <= k).drop("_n")


def upper_median(values: Column) -> Column:
    """The element at half the length, counted from 0, of the sorted values."""
    s = F.array_sort(values)
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))
