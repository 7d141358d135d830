"""Relational read-outs: counts, listings, the graph, sources, event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import RELATIONSHIPS
from tessera.operators.skew import lookup


def clamp_limit(n: int, low: int, high: int) -> int:
    return max(low, min(high, n))


def stats_counts(chunks: DataFrame, edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Chunks, connections and concepts of each database; a database without rows of a kind has 0."""
    parts = [
        df.groupBy("database_id").count().select("database_id", *[F.col("count").alias(c) if c == n else F.lit(0).cast("long").alias(c) for c in ("chunks", "connections", "concepts")])
        for df, n in ((chunks, "chunks"), (edges, "connections"), (concepts, "concepts"))
    ]
    all_parts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return all_parts.groupBy("database_id").agg(*[F.sum(c).alias(c) for c in ("chunks", "connections", "concepts")])


def relationship_counts(edges: DataFrame) -> DataFrame:
    """Edges of each known relationship, 0 included; others are not counted."""
    counts = [F.count_if(F.col("relationship") == r).alias(r) for r in RELATIONSHIPS]
    one = edges.agg(*counts)
    return one.unpivot([], list(RELATIONSHIPS), "relationship", "n")


def top_sources(chunks: DataFrame, n: int = 10) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), F.asc_nulls_last("source")).limit(n)


def recent_chunks(chunks: DataFrame, n: int = 10) -> DataFrame:
    return chunks.select("chunk_id", "source", F.substring("text", 1, 80).alias("preview"), "timestamp").orderBy(F.desc_nulls_last("timestamp"), "chunk_id").limit(n)


def chunk_listing(chunks: DataFrame, database: str, search: str | None = None, source: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a database's chunks, newest first. `search` is matched without case; % and _ in it are wildcards."""
    df = chunks.where(F.col("database_id") == database)
    if source is not None:
        df = df.where(F.col("source") == source)
    if search:
        # the backslash is no escape sign here
        df = df.where(F.lower("text").like("%" + search.lower().replace("\\", "\\\\") + "%"))
    df = df.select("chunk_id", "source", "page", F.substring("text", 1, 300).alias("preview"), "timestamp", "access_count").orderBy(F.desc_nulls_last("timestamp"), "chunk_id")
    return df.offset(max(0, offset)).limit(clamp_limit(limit, 1, 200))


def graph_links(edges: DataFrame, least: float = 0.1) -> DataFrame:
    return edges.where(F.col("weight") >= least).select("edge_id", "source_chunk", "target_chunk", "relationship", "weight", "confidence")


def graph_nodes(edges: DataFrame, chunks: DataFrame, least: float = 0.1) -> DataFrame:
    """Chunks at an end of a link, with a preview of their text."""
    links = edges.where(F.col("weight") >= least)
    ends = links.select(F.col("source_chunk").alias("k")).union(links.select(F.col("target_chunk").alias("k"))).distinct()
    return chunks.join(ends, F.lower("chunk_id") == F.col("k"), "left_semi").select("chunk_id", "source", F.substring("text", 1, 80).alias("preview"), "access_count")


def sources_rollup(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Per source: chunks, the number of edges from its latest chunk (null if none), the latest time."""
    out = edges.groupBy("source_chunk").agg(F.count("*").alias("edges_out"))
    joined = lookup(chunks.select("chunk_id", F.lower("chunk_id").alias("node"), "source", "timestamp"), "node", out.withColumnRenamed("source_chunk", "k"), "k", how="left")
    return joined.groupBy("source").agg(F.count("*").alias("chunks"), F.max_by("edges_out", F.struct("timestamp", "chunk_id")).alias("connections"), F.max("timestamp").alias("last_timestamp"))


def recent_ingests(events: DataFrame, n: int = 5) -> DataFrame:
    return events.select("event_id", "source", "chunks_stored", "chunks_skipped", "connections_seeded", "timestamp").orderBy(F.desc_nulls_last("timestamp"), "event_id").limit(clamp_limit(n, 1, 50))


def ingests_since(events: DataFrame, database: str, since: Column, limit: int = 100) -> DataFrame:
    """A database's events from a moment on, newest first."""
    df = events.where((F.col("database_id") == database) & (F.col("timestamp") >= since))
    return df.select("event_id", "source", "chunks_stored", "timestamp").orderBy(F.desc("timestamp"), "event_id").limit(clamp_limit(limit, 1, 500))


def since_as_text(events: DataFrame, since: str) -> DataFrame:
    """The filter as plain text comparison has it: a `T` sorts after a blank, so rows of the same day always pass. `timestamp` is text."""
    return events.where(F.col("timestamp") >= since)


def concept_listing(concepts: DataFrame) -> DataFrame:
    return concepts.select("concept_id", "label", F.size("members").alias("n_members"), "confidence", "version", "last_updated", "database_id").orderBy(F.desc_nulls_last("last_updated"), "concept_id")


def stale_concepts(concepts: DataFrame, limit: int | None = None) -> DataFrame:
    """Concepts whose vector is older than their text; blank summaries have none."""
    df = concepts.where((F.col("embedding_version") < F.col("version")) & (F.coalesce(F.trim("summary"), F.lit("")) != "")).select("concept_id", "version", "embedding_version")
    return df if limit is None else df.orderBy("concept_id").limit(limit)


def untyped_batch(edges: DataFrame, n: int = 10) -> DataFrame:
    """The next edges without a type, by id."""
    return edges.where("relationship = 'related_to'").select("edge_id", "source_chunk", "target_chunk", "weight").orderBy("edge_id").limit(n)


def untyped_sources(edges: DataFrame) -> DataFrame:
    return edges.where("relationship = 'related_to'").select("source_chunk").distinct()


def untyped_ranked(edges: DataFrame) -> DataFrame:
    """Each source's untyped edges in the order in which they are typed."""
    w = Window.partitionBy("source_chunk").orderBy(F.desc("weight"), F.desc_nulls_last("confidence"), F.desc_nulls_last("created_at"), "edge_id")
    return edges.where("relationship = 'related_to'").select("source_chunk", "edge_id", "weight", F.row_number().over(w).alias("rank"))


def hot_chunks(chunks: DataFrame, above: int = 3) -> DataFrame:
    return chunks.where(F.col("access_count") > above).select("chunk_id", "access_count")


def decay_candidates(edges: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Edges last seen, else reinforced, else made before a number of days."""
    cut = as_of - F.make_interval(days=F.lit(days))
    return edges.where((F.col("last_seen") < cut) | (F.col("last_seen").isNull() & (F.col("last_reinforced") < cut)) | (F.col("last_seen").isNull() & F.col("last_reinforced").isNull() & (F.col("created_at") < cut)))


def edges_per_source(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges that leave the chunks of each source."""
    joined = lookup(edges.select("source_chunk"), "source_chunk", chunks.select(F.lower("chunk_id").alias("k"), "source"), "k")
    return joined.groupBy("source").agg(F.count("*").alias("edges"))
