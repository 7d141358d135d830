"""Ingestion: batches, duplicates, seed edges, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import CONFIG
from tessera.operators.knn import knn, nearest_stored


def seed_edges(found: DataFrame) -> DataFrame:
    """Edges from each query to what was found for it, whatever its similarity; none to itself. found: q, id, sim."""
    return found.where("q <> id").select(
        F.col("q").alias("source"), F.col("id").alias("target"), F.lit("related_to").alias("relationship"), F.lit(CONFIG.seed_weight).alias("weight"), F.lit(CONFIG.seed_confidence).alias("confidence"), F.col("sim").alias("avg_sim"), F.lit(1).alias("seen_count")
    )


def insert_or_ignore(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose keys are neither stored nor repeated; of repeated ones the least row stays."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]) if rest else new.distinct()
    return one.join(stored.select(*keys).distinct(), keys, "left_anti")


def chunk_key(source: Column, index: Column, text: Column) -> Column:
    """A chunk's id: the same for the same source, place and text."""
    return F.sha2(F.concat_ws("\x1f", F.coalesce(source, F.lit("")), index.cast("string"), F.coalesce(text, F.lit(""))), 256)


def ingest_batch(batch: DataFrame, stored: DataFrame, check_duplicates: bool = True, threshold: float = CONFIG.duplicate_threshold, fan_out: int = CONFIG.seed_fan_out, defer: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept rows, seed edges) of one batch against what was stored before it.

    Both: id, v, database_id. Duplicates within a batch are not looked for, as they
    are searched before anything of the batch is stored. With both toggles set
    (no check, deferred graph) nothing is searched.
    """
    queries = batch.select(F.col("id").alias("q"), "v", "database_id")
    kept = batch
    if check_duplicates:
        hits = nearest_stored(queries, stored, 1, "database_id", threshold)
        kept = batch.join(hits.select(F.col("q").alias("id")), "id", "left_anti")
    if defer:
        return kept, seed_edges(knn(queries.where("false"), stored, fan_out))
    found = nearest_stored(kept.select(F.col("id").alias("q"), "v", "database_id"), stored, fan_out, "database_id")
    return kept, seed_edges(found)


def deferred_edges(batch: DataFrame, stored: DataFrame, fan_out: int = CONFIG.seed_fan_out) -> DataFrame:
    """Seed edges searched after all is stored: a row meets itself first, which leaves one edge less."""
    return seed_edges(nearest_stored(batch.select(F.col("id").alias("q"), "v", "database_id"), stored, fan_out, "database_id"))


def event_of(counts: DataFrame, as_of: Column) -> DataFrame:
    """Ingest events with ids made from what they report. counts: source, chunks_stored, chunks_skipped, connections_seeded, tags, database_id."""
    return counts.select(
        F.sha2(F.concat_ws("\x1f", "source", "database_id", as_of.cast("string")), 256).alias("event_id"), "source", "chunks_stored", "chunks_skipped", "connections_seeded", F.to_json("tags").alias("tags"), as_of.alias("timestamp"), "database_id"
    )
