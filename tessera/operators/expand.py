"""Bounded expansion of seeds over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import CONFIG
from tessera.functions.text import relationship_filter


def _best(df: DataFrame) -> DataFrame:
    """The best walk to each node of each query; ties go to the shorter, then to the first path."""
    one = df.groupBy("q", "id").agg(F.min(F.struct((-F.col("score")).alias("s"), "depth", "path", "vec")).alias("b"))
    return one.select("q", "id", (-F.col("b.s")).alias("score"), "b.depth", "b.path", "b.vec")


def expand(seeds: DataFrame, edges: DataFrame, hops: int = CONFIG.max_hops, decay: float = CONFIG.hop_decay, least: float = CONFIG.min_edge_weight, relationships: list[str] | None = None) -> DataFrame:
    """(q, id, score, depth, path, vec): every node within `hops` of a query's seeds with its best walk.

    seeds: q, id, score. edges: source, target, relationship, w. A step to depth d
    multiplies by decay ** d and the edge's weight; edges need a weight over `least`. The
    best walk by level is kept, so each level joins at most one row for each query and
    node. `vec` is the score of the seed where the walk began. An unknown or empty list of
    relationships is no filter. No seeds give no rows.
    """
    kept = relationship_filter(relationships)
    usable = edges.where((F.col("w") > least) & F.col("target").isNotNull()).select(F.col("source").alias("id"), "target", "relationship", "w")
    if kept:
        usable = usable.where(F.col("relationship").isin(kept))
    usable = usable.groupBy("id", "target").agg(F.max("w").alias("w"))
    level = seeds.select("q", "id", "score", F.lit(0).alias("depth"), F.array(F.col("id").cast("string")).alias("path"), F.col("score").alias("vec"))
    found = level
    for d in range(1, hops + 1):
        step = level.join(usable, "id").select(
            "q", F.col("target").alias("id"), (F.col("score") * F.pow(F.lit(decay), F.lit(d)) * F.col("w")).alias("score"), F.lit(d).alias("depth"), F.concat("path", F.array(F.col("target").cast("string"))).alias("path"), "vec"
        )
        level = _best(step)
        found = found.unionByName(level)
    return _best(found)


def conflicts(pool: DataFrame, edges: DataFrame) -> DataFrame:
    """(q, id, conflicts): for each node of a query's pool the other nodes of it that an edge of type `contradicts` links, sorted.

    pool: q, id. edges: source, target, relationship. Both directions count.
    """
    bad = edges.where("relationship = 'contradicts'").select("source", "target")
    both = bad.unionByName(bad.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    a = pool.select("q", "id").distinct()
    hit = a.join(both, F.col("id") == F.col("source")).select("q", "id", F.col("target").alias("other"))
    b = a.select(F.col("q").alias("q2"), F.col("id").alias("other2"))
    return hit.join(b, (F.col("q") == F.col("q2")) & (F.col("other") == F.col("other2"))).groupBy("q", "id").agg(F.array_sort(F.collect_set("other")).alias("conflicts"))


def inner_edges(pool: DataFrame, edges: DataFrame) -> DataFrame:
    """(q, source, target, relationship, w): edges with both ends in a query's pool; a pool of fewer than two nodes has none."""
    a = pool.select("q", "id").distinct()
    big = a.groupBy("q").count().where("count > 1").select("q")
    a = a.join(big, "q", "left_semi")
    left = a.join(edges, F.col("id") == F.col("source")).select("q", "source", "target", "relationship", "w")
    return left.join(a.select(F.col("q").alias("q2"), F.col("id").alias("id2")), (F.col("q") == F.col("q2")) & (F.col("target") == F.col("id2")), "left_semi")
