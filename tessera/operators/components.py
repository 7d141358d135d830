"""Connected components by union-find in bounded partitions.

Union-find runs inside bounded partitions of edges; of each partition only its
spanning forest is kept. Forests are merged in ever fewer partitions, as long
as each merged partition stays under a bound. What is left above the bound is
contracted: every vertex keeps one root, its other roots become edges between
roots, and the smaller graph goes through the same steps. Labels are then
handed down from the last level to the first. No task ever holds more edges
than the bound, however large a component is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import CONFIG
from tessera.operators.skew import lookup
from tessera.plans.durable import durable

#: Edges that one union-find may hold; about 300 MB of Python.
EDGES_PER_TASK = 2_000_000
_EDGE = "u long, v long"


def spanning_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, root) of every vertex that is not the least of its component."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(ids)))
    n = len(u)
    for a, b in zip(at[:n].tolist(), at[n:].tolist(), strict=True):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    root = np.array(parent, dtype=np.int64)
    while True:
        up = root[root]
        if np.array_equal(up, root):
            break
        root = up
    child = np.nonzero(root != np.arange(len(ids)))[0]
    return ids[child], ids[root[child]]


def _forest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if parts:
        u, v = spanning_forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        for at in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[at : at + 100_000]), pa.array(v[at : at + 100_000])], names=["u", "v"])


def _mixed(c: str, level: int) -> F.Column:
    return F.xxhash64(F.col(c), F.lit(level))


def components(edges: DataFrame, bound: int = EDGES_PER_TASK) -> DataFrame:
    """(id, root) of every vertex of `edges` (long u, long v) that is not its component's root.

    `root` is one vertex of the component, the same for all of it; the root
    itself has no row. Self-loops and nulls are ignored, repeats are harmless,
    an empty table gives an empty one.
    """
    spark = edges.sparkSession
    edges = edges.where("u is not null and v is not null and u <> v")
    pointers: list[DataFrame] = []
    level = 0
    known = edges.count()
    while True:
        # no partition is over the bound, however the edges were stored; small graphs still use all cores at first
        n = max(1, -(-known // bound), min(spark.sparkContext.defaultParallelism, known // 50_000))
        edges = edges.repartition(n)
        forest = durable(edges.mapInArrow(_forest_of, _EDGE))
        rows = forest.count()
        while n > 1 and (fewer := max(1, -(-rows // bound))) < n:
            # merging some partitions at a time keeps the first merges parallel
            n = max(fewer, -(-n // 8))
            forest = durable(forest.repartition(n).mapInArrow(_forest_of, _EDGE))
            rows = forest.count()
        if n == 1:
            top = forest.select(F.col("u").alias("id"), F.col("v").alias("root"))
            break
        # An order that changes with the level keeps chains from forming: a long path loses two thirds of its ends.
        best = forest.groupBy("u").agg(F.min(F.struct(_mixed("v", level).alias("o"), "v")).alias("m")).select("u", F.col("m.v").alias("m"))
        pointer = _ends(best)
        k = pointer.select(F.col("u").alias("k"), F.col("m").alias("t"))
        half = forest.join(pointer, "u").select("v", F.col("m").alias("u"))
        moved = lookup(half, "v", k, "k", how="left").select("u", F.coalesce("t", "v").alias("v"))
        edges = durable(moved.where("u <> v").distinct())
        pointers.append(pointer)
        known = edges.count()
        level += 1
        if known == 0:
            top = spark.createDataFrame([], "id long, root long")
            break
    for pointer in reversed(pointers):
        # the smaller graph has only ends of pointers, so no vertex has both a pointer and a label
        named = lookup(pointer, "m", top.withColumnRenamed("id", "k"), "k", how="left")
        top = durable(named.select(F.col("u").alias("id"), F.coalesce("root", "m").alias("root")).unionByName(top))
    return top


def _ends(pointer: DataFrame) -> DataFrame:
    """Follow pointers (u -> m, always to a lesser vertex) to where they end, in steps that double."""
    chain = durable(pointer)
    while True:
        nxt = chain.select(F.col("u").alias("k"), F.col("m").alias("m2"))
        joined = durable(lookup(chain, "m", nxt, "k", how="left").select("u", F.coalesce("m2", "m").alias("m"), F.col("m2").isNotNull().alias("moved")))
        chain = joined.select("u", "m")
        if not joined.where("moved").limit(1).count():
            return chain


def connected_components(edges: DataFrame, bound: int = EDGES_PER_TASK) -> DataFrame:
    """(id, component): the least id of each vertex's component. edges: a, b of any type, taken as undirected; nulls link nothing, a self-loop is a vertex of its own."""
    both = durable(edges.where("a is not null and b is not null").select("a", "b"))
    codes = durable(both.select(F.col("a").alias("k")).unionByName(both.select(F.col("b").alias("k"))).distinct().withColumn("code", F.monotonically_increasing_id()))
    half = lookup(both, "a", codes.withColumnRenamed("code", "u"), "k")
    coded = lookup(half, "b", codes.withColumnRenamed("code", "v"), "k").select("u", "v")
    label = components(durable(coded), bound).withColumnRenamed("id", "code")
    named = durable(codes.join(label, "code", "left").select(F.col("k").alias("id"), F.coalesce("root", "code").alias("root")))
    least = named.groupBy(F.col("root").alias("k")).agg(F.min("id").alias("component"))
    return lookup(named, "root", least, "k").select("id", "component")


def strong_components(edges: DataFrame, least: float = CONFIG.cluster_min_weight, size: int = CONFIG.cluster_min_size) -> DataFrame:
    """(id, component, n) of the components of at least `size` vertices over edges of at least `least`. edges: source_chunk, target_chunk, weight."""
    strong = edges.where((F.col("weight") >= least) & (F.col("source_chunk") != F.col("target_chunk"))).select(F.col("source_chunk").alias("a"), F.col("target_chunk").alias("b"))
    found = durable(connected_components(strong))
    big = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= size)
    return lookup(found, "component", big.withColumnRenamed("component", "k"), "k")


def splittable(edges: DataFrame, least: float = CONFIG.cluster_min_weight, size: int = CONFIG.cluster_min_size) -> DataFrame:
    """(component, parts): strong components that fall into at least two parts of `size` when edges need 0.1 more."""
    whole = strong_components(edges, least, size)
    inner = strong_components(edges, least + 0.1, size)
    joined = inner.select("id", F.col("component").alias("part")).join(whole.select("id", "component"), "id")
    return joined.groupBy("component").agg(F.countDistinct("part").alias("parts")).where("parts > 1")
