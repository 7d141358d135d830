"""Hybrid retrieval as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import CONFIG
from tessera.operators.expand import conflicts, expand
from tessera.operators.fusion import fused, rescored, top_k
from tessera.operators.knn import knn
from tessera.plans.durable import durable


def concept_hits(queries: DataFrame, concepts: DataFrame, k: int = CONFIG.concept_top_k, least: float = CONFIG.concept_min_score) -> DataFrame:
    """(q, concept_id, sim, rank): the concepts nearest to each query. concepts: concept_id, v."""
    return knn(queries, concepts.select(F.col("concept_id").alias("id"), "v"), k, floor=least).withColumnRenamed("id", "concept_id")


def concept_layer(hits: DataFrame, concepts: DataFrame, boost: float = CONFIG.concept_boost) -> DataFrame:
    """(q, id, score, layer, concept_id): members of the concepts found, scored by similarity and confidence. concepts: concept_id, members, confidence."""
    joined = hits.join(concepts.select("concept_id", "members", "confidence"), "concept_id")
    score = F.col("sim") + F.col("sim") * (0.5 + 0.5 * F.coalesce("confidence", F.lit(0.5))) * boost
    return joined.select("q", F.explode("members").alias("id"), score.alias("score"), F.lit("concept").alias("layer"), "concept_id")


def boosted_members(seeds: DataFrame, hits: DataFrame, concepts: DataFrame, boost: float = CONFIG.concept_boost) -> DataFrame:
    """(q, id, score, concept_id): members of found concepts that aren't seeds, scored from the query's weakest seed (0.5 without seeds); the first concept that has a member wins."""
    from pyspark.sql.window import Window

    weakest = seeds.groupBy("q").agg(F.min("score").alias("base"))
    rows = hits.join(concepts.select("concept_id", "members", "confidence"), "concept_id").join(weakest, "q", "left")
    score = F.coalesce("base", F.lit(0.5)) + F.col("sim") * (0.5 + 0.5 * F.coalesce("confidence", F.lit(0.5))) * boost
    rows = rows.select("q", "rank", "concept_id", F.explode("members").alias("id"), score.alias("score")).join(seeds.select("q", "id"), ["q", "id"], "left_anti")
    w = Window.partitionBy("q", "id").orderBy("rank", "concept_id")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("q", "id", "score", "concept_id")


def hybrid(
    queries: DataFrame,
    vectors: DataFrame,
    edges: DataFrame,
    top: int = 20,
    hops: int = CONFIG.max_hops,
    relationships: list[str] | None = None,
    least: float = CONFIG.min_score,
    candidates: int = CONFIG.rerank_candidates,
    prior: DataFrame | None = None,
    influence: float = 0.0,
    with_conflicts: bool = True,
    same: str | None = "database_id",
) -> DataFrame:
    """(q, id, score, rank, layer, depth, conflicts): the whole chain from query vectors to ranked results.

    Vector seeds, expansion over the graph, fusion with an optional prior (q, id,
    prior), the power rescore, contradictions in the whole pool, then the floor and the
    cut. A query without seeds has no rows; one with a single candidate keeps it whatever its score.
    """
    seeds = knn(queries, vectors, max(10, top), same).select("q", "id", F.col("sim").alias("score"))
    # the pool is read for the cut and for the contradictions; it is small beside what it is made from, so it is written once
    pool = durable(expand(seeds, edges, hops, relationships=relationships))
    graph = F.when(F.col("depth") > 0, F.col("score")).otherwise(0.0)
    if prior is not None:
        pool = pool.join(prior.select("q", "id", "prior"), ["q", "id"], "left")
        p = F.coalesce("prior", F.lit(0.0))
    else:
        p = F.lit(0.0)
    scored = rescored(pool.select("q", "id", "depth", "path", fused(F.col("vec"), graph, p, influence).alias("score")))
    cut = top_k(scored, top, least, candidates)
    if with_conflicts:
        # contradictions are looked for in the whole pool, before the cut
        found = conflicts(pool, edges)
        cut = cut.join(found, ["q", "id"], "left")
    else:
        cut = cut.withColumn("conflicts", F.lit(None))
    empty = F.array().cast(f"array<{pool.schema['id'].dataType.simpleString()}>")
    layer = F.when(F.col("depth") > 0, "graph").otherwise("vector").alias("layer")
    return cut.select("q", "id", "score", "rank", layer, "depth", F.coalesce(F.col("conflicts").cast(f"array<{pool.schema['id'].dataType.simpleString()}>"), empty).alias("conflicts"))
