"""Streams: a watched folder, co-access events into edge weights, periodic consolidation."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.functions.providers import Providers
from tessera.operators import consolidate as O
from tessera.operators.catalog import Snapshots
from tessera.plans.durable import durable
from tessera.sources.files import documents_of, is_supported


def _start(writer, available_now: bool, every: str) -> StreamingQuery:  # noqa: ANN001
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


_FILES = "path string, modificationTime timestamp, length long, content binary"


def _supported(files: DataFrame) -> DataFrame:
    return files.where(is_supported(F.regexp_replace("path", r"^[a-z]+:/*", "/")))


def watch_folder(spark: SparkSession, folder: str, ingest: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, every: str = "10 seconds", files_per_batch: int = 32, providers: Providers | None = None) -> StreamingQuery:
    """New files under a folder, of every supported kind and read as such, go to `ingest` in batches (path, kind, text, metadata, error), each file once (the checkpoint keeps what was seen).

    A changed file isn't new to the stream; `scan_folder` takes those too.
    """
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_per_batch)).load(folder)
    return _start(_supported(files).writeStream.foreachBatch(lambda df, n: ingest(documents_of(df, providers=providers), n)).option("checkpointLocation", checkpoint), available_now, every)


def scan_folder(spark: SparkSession, folder: str, ledger: Snapshots, ingest: Callable[[DataFrame, int], None], providers: Providers | None = None) -> int:
    """One look at a folder: files that are new or were changed since they were last read go to `ingest`; returns how many.

    The ledger (snapshot `files`: path, modified) is written after `ingest` has returned, so a file is read again if that fails.
    """
    files = _supported(spark.read.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(folder))
    if not ledger.version("files"):
        ledger.write("files", spark.createDataFrame([], "path string, modified timestamp"))
    last = ledger.read("files").groupBy("path").agg(F.max("modified").alias("last"))
    listed = files.select("path", F.col("modificationTime").alias("modified")).join(last, "path", "left")
    fresh = durable(listed.where("last is null or modified > last").select("path", "modified"))
    n = fresh.count()
    if n:
        ingest(documents_of(files.join(fresh.select("path"), "path", "left_semi"), providers=providers), ledger.version("files"))
        ledger.append("files", fresh)
    return n


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch)).parquet(folder)


def co_access_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, a, b, times): pairs accessed together in each window of event time; events later than the watermark are dropped.

    An addition to what the project it serves has. events: ts, ids.
    """
    pairs = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice(F.col("ids"), i + 2, F.size("ids")), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))
    flat = events.withWatermark("ts", late).where(F.size("ids") > 1).select("ts", F.explode(pairs).alias("p"))
    return flat.groupBy(F.window("ts", window), "p.a", "p.b").agg(F.count("*").alias("times"))


def hebbian_stream(events: DataFrame, state: Snapshots, checkpoint: str, available_now: bool = False, every: str = "5 minutes") -> StreamingQuery:
    """Each batch of co-access events (ids) strengthens the edges of the snapshot `edges` once.

    A batch number is written with the snapshot, so a batch that is run again after a
    failure changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        now = state.read("edges")
        done = now.agg(F.max("batch")).first()[0] if "batch" in now.columns else None
        if done is not None and done >= number:
            return
        new = O.hebbian_updates(O.co_access_pairs(batch), now)
        state.write("edges", O.apply_weights(now.drop("batch"), new).withColumn("batch", F.lit(number)))

    return _start(events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint), available_now, every)


def consolidation_tick(edges: DataFrame, chunks: DataFrame, events: DataFrame, as_of: datetime, hebbian: bool = True, vectors: DataFrame | None = None) -> DataFrame:
    """Edges after one tick: hot edges reinforced, all decayed, then those of co-access strengthened and, given vectors, new ones made.

    chunks: node, access_count. vectors: id, v; two chunks accessed together that no edge links get one if their
    cosine is over the bound. Each part is a pure step, so a tick is one plan.
    """
    now = F.lit(as_of).cast("timestamp")
    out = O.apply_weights(edges, O.reinforced(edges, chunks))
    out = O.apply_weights(out, O.decayed(out, now))
    if not hebbian:
        return out
    pairs = O.co_access_pairs(events)
    if vectors is None:
        return O.apply_weights(out, O.hebbian_updates(pairs, out))
    new = O.hebbian_new(pairs, edges, O.pair_similarity(O.hebbian_new(pairs, edges).select("a", "b"), vectors))
    key = F.sha2(F.concat_ws("\x1f", "a", "b", "relationship"), 256)
    values = {"edge_id": key, "source_chunk": F.col("a"), "target_chunk": F.col("b"), "confidence": F.lit(0.5), "created_at": now, "last_reinforced": now, "last_seen": now, "avg_sim": F.col("sim"), "seen_count": F.lit(1), "access_count": F.col("times"), "support_count": F.lit(0), "contradict_count": F.lit(0), "evidence_score": F.lit(0.0), "weight_version": F.lit(1)}
    new = new.withColumns(values)
    # an edge belongs to the database of the chunk it leaves
    home = vectors.select(F.col("id").alias("a"), "database_id") if "database_id" in vectors.columns else vectors.select(F.col("id").alias("a"), F.lit(None).cast("string").alias("database_id"))
    new = new.join(home, "a")
    added = new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in edges.schema.fields])
    return O.apply_weights(out, O.hebbian_updates(pairs, out)).unionByName(added)


class Cadence:
    """When each part of the worker last ran; kept in the snapshot `cadence` (name, at), so a restart fires nothing early."""

    # Seconds between runs.
    EVERY = {"hebbian": 300, "cluster": 86_400, "train": 600}

    def __init__(self, state: Snapshots) -> None:
        self.state = state
        if not state.version("cadence"):
            state.write("cadence", state.spark.createDataFrame([], "name string, at timestamp"))

    def last(self, name: str) -> datetime | None:
        return self.state.read("cadence").where(F.col("name") == name).agg(F.max("at")).first()[0]

    def due(self, name: str, now: datetime) -> bool:
        """Whether a part's time has come; one that never ran is due."""
        last = self.last(name)
        return last is None or (now - last).total_seconds() >= self.EVERY[name]

    def ran(self, name: str, now: datetime) -> None:
        self.state.append("cadence", self.state.spark.createDataFrame([(name, now)], "name string, at timestamp"))


def consolidation_worker(spark: SparkSession, ticks: DataFrame, run: Callable[[int], None], checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """Call `run` at fixed intervals, never two at once; an error ends the stream rather than being swallowed. `ticks` is any stream, such as a rate source."""
    return ticks.writeStream.foreachBatch(lambda _, n: run(n)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
