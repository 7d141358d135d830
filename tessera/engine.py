"""The library's surface: databases, ingestion, retrieval, answers and consolidation over versioned tables.

State lives in snapshots under a folder. Every call that changes something writes the
next version of the tables it touches; everything that reads returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import BENCHMARK_QUERIES, CONFIG, DEFAULT_DATABASE, UNLABELED
from tessera.functions.chunkers import chunk_table
from tessera.functions.providers import Providers, embed_column, rerank_column
from tessera.functions.text import is_citation_chunk, is_glossary_chunk, source_label
from tessera.operators import consolidate as O
from tessera.operators import concepts as P
from tessera.operators import context as C
from tessera.operators import ingest as I
from tessera.operators import prior as M
from tessera.operators import retrieve as R
from tessera.operators.catalog import Snapshots, create_database, delete_database
from tessera.operators.clusters import centroids, leader_clusters
from tessera.operators.components import splittable, strong_components
from tessera.operators.expand import inner_edges
from tessera.operators.documents import script_seconds, script_segments
from tessera.operators.fusion import blended, merge_layers, ranked, top_k
from tessera.operators.knn import knn
from tessera.plans.durable import durable
from tessera.operators.readouts import stats_counts
from tessera.sources.files import kind_of, read_documents
from tessera.streaming.jobs import Cadence, consolidation_tick, scan_folder

_SCHEMAS = {
    "memory_databases": "id string, name string, created_at long, description string, config_json string",
    "chunks": "chunk_id string, text string, source string, page int, timestamp timestamp, access_count int, last_accessed timestamp, tags array<string>, metadata map<string,string>, is_duplicate int, contradiction_flag int, database_id string, v array<double>",
    "connections": "edge_id string, source_chunk string, target_chunk string, relationship string, weight double, confidence double, created_at timestamp, last_reinforced timestamp, database_id string, access_count int, support_count int, contradict_count int, seen_count int, last_seen timestamp, avg_sim double, evidence_score double, weight_version int",
    "concepts": "concept_id string, label string, summary string, members array<string>, created_at timestamp, last_updated timestamp, database_id string, confidence double, version int, embedding_version int, v array<double>",
    "ingest_events": "event_id string, source string, chunks_stored int, chunks_skipped int, connections_seeded int, tags string, timestamp timestamp, database_id string",
    "co_access_events": "event_id string, ids array<string>, query_hash string, query_embedding string, timestamp long, database_id string",
    "access_log": "chunk_id string, n long, at timestamp",
    "image_vectors": "path string, v array<double>, database_id string",
    "benchmark_runs": "run_at timestamp, chunks long, connections long, query string, ids array<string>, scores array<double>, ms double",
    "associative_memory": "model_id string, weights array<struct<shape:array<int>,data:array<double>>>, num_concepts int, trained_on int, last_trained long, database_id string",
}


class Engine:
    """One store of databases, chunks, connections, concepts and logs."""

    def __init__(self, spark: SparkSession, root: str, providers: Providers | None = None, dims: int = CONFIG.embed_dims, clock: Callable[[], datetime] | None = None) -> None:
        self.spark, self.store, self.p, self.dims = spark, Snapshots(spark, root), providers or Providers(), dims
        self.clock = clock or (lambda: datetime.now(UTC).replace(tzinfo=None))
        for name, schema in _SCHEMAS.items():
            if not self.store.version(name):
                self.store.write(name, spark.createDataFrame([], schema))
        if self.table("memory_databases").isEmpty():
            self._create(DEFAULT_DATABASE, DEFAULT_DATABASE)

    # ---- tables and databases

    def table(self, name: str) -> DataFrame:
        """A table as it is now; accesses are logged as additions and counted when chunks are read."""
        df = self.store.read(name)
        if name != "chunks":
            return df
        log = self.store.read("access_log").groupBy(F.col("chunk_id").alias("k")).agg(F.sum("n").alias("n"), F.max("at").alias("at"))
        seen = df.join(log, F.col("chunk_id") == F.col("k"), "left")
        return seen.withColumns({"access_count": (F.coalesce("access_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("int"), "last_accessed": F.greatest("last_accessed", "at")}).select(*df.columns)

    def compact(self) -> None:
        """Write tables of many additions as one, and the logged accesses into the chunks. For times without other writers: one that ends between two tables leaves accesses that count twice."""
        self.store.write("chunks", self.table("chunks"))
        self.store.write("access_log", self.spark.createDataFrame([], _SCHEMAS["access_log"]))
        for name in _SCHEMAS:
            if self.store.additions(name) > 1:
                self.store.write(name, self.store.read(name))

    def _now(self) -> Column:
        return F.lit(self.clock()).cast("timestamp")

    def _append(self, name: str, rows: DataFrame) -> int:
        """Append rows with the table's columns; missing ones are null. Returns how many there were."""
        kinds = self.table(name).schema
        cols = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields]
        return self.store.append(name, rows.select(*[c.alias(f.name) for c, f in zip(cols, kinds.fields, strict=True)]))

    def _create(self, id: str, name: str) -> None:
        row = self.spark.range(1).select(F.lit(id).alias("id"), F.lit(name).alias("name"), F.unix_timestamp(self._now()).alias("created_at"), F.lit(None).cast("string").alias("description"), F.lit("{}").alias("config_json"))
        self._append("memory_databases", row)

    def list_databases(self) -> DataFrame:
        return self.table("memory_databases").orderBy("name")

    def create_database(self, name: str, description: str | None = None) -> str:
        self.store.write("memory_databases", create_database(self.table("memory_databases"), name, self._now(), description))
        return f"db_{name.strip()}"

    def delete_database(self, database: str, full: bool = False) -> None:
        names = [n for n in _SCHEMAS if n not in ("memory_databases", "access_log", "benchmark_runs")]
        catalog, tables = delete_database(self.table("memory_databases"), {n: self.store.read(n) for n in names}, database, full)
        for n, df in tables.items():
            self.store.write(n, df)
        self.store.write("memory_databases", catalog)

    # ---- ingestion

    def ingest(self, folder: str, database: str = DEFAULT_DATABASE, **options: object) -> dict[str, int]:
        """All files under a folder; those that can't be read are skipped."""
        docs = read_documents(self.spark, folder, providers=self.p).where("error is null").select(source_label(F.col("path")).alias("source"), "text", "kind", "metadata")
        return self.ingest_table(docs, database, **options)

    def watch(self, folder: str, database: str = DEFAULT_DATABASE, every: float = 0) -> int:
        """New and changed files under a folder; with `every`, again after so many seconds until the process ends. Returns how many were read in all."""
        from time import sleep

        def take(docs: DataFrame, _: int) -> None:
            self.ingest_table(docs.where("error is null").select(source_label(F.col("path")).alias("source"), "text", "kind", "metadata"), database)

        total = scan_folder(self.spark, folder, self.store, take, self.p)
        while every > 0:
            sleep(every)
            total += scan_folder(self.spark, folder, self.store, take, self.p)
        return total

    def ingest_text(self, source: str, text: str, database: str = DEFAULT_DATABASE, **options: object) -> dict[str, int]:
        return self.ingest_table(self.spark.createDataFrame([(source, text, "text")], "source string, text string, kind string"), database, **options)

    def ingest_table(self, docs: DataFrame, database: str = DEFAULT_DATABASE, strategy: str = "token", tags: list[str] | str | None = None, check_duplicates: bool = True, defer_graph: bool = False, threshold: float = CONFIG.duplicate_threshold) -> dict[str, int]:
        """Cut, filter, embed, compare with what is stored, store, seed edges, log. docs: source, text, kind, and metadata if there is any.

        Tags are a list or a text with commas. Duplicates among the new chunks themselves are kept, as the search comes before the store.
        """
        tags = [x for t in tags.split(",") if (x := t.strip())] if isinstance(tags, str) else tags
        cut = chunk_table(docs, "source", "text", strategy, "kind", "metadata" if "metadata" in docs.columns else None)
        good = cut.where(~is_citation_chunk(F.col("text")) & ~is_glossary_chunk(F.col("text")))
        keyed = good.select(I.chunk_key(F.col("source"), F.col("index"), F.col("text")).alias("id"), "source", "index", "text", "metadata")
        new = durable(embed_column(keyed, "text", "v", self.p.embed).withColumn("database_id", F.lit(database)))
        stored = self.table("chunks").where("v is not null").select(F.col("chunk_id").alias("id"), "v", "database_id")
        new_ids = new.join(stored.select("id"), "id", "left_anti") if check_duplicates else new
        kept, seeds = I.ingest_batch(new_ids.select("id", "v", "database_id"), stored, check_duplicates, threshold, defer=defer_graph)
        kept, seeds = durable(new.join(kept.select("id"), "id", "left_semi")), durable(seeds)
        n = self._append("chunks", kept.select(F.col("id").alias("chunk_id"), "text", "source", F.col("index").alias("page"), self._now().alias("timestamp"), F.lit(0).alias("access_count"), F.array(*map(F.lit, tags or [])).cast("array<string>").alias("tags"), "metadata", F.lit(0).alias("is_duplicate"), F.lit(0).alias("contradiction_flag"), "database_id", "v"))
        if defer_graph:
            stored = self.table("chunks").where("v is not null").select(F.col("chunk_id").alias("id"), "v", "database_id")
            seeds = I.deferred_edges(kept.select("id", "v", "database_id"), stored)
        edges = self._seed(seeds, database)
        total = new.count()
        out = {"stored": n, "skipped": total - n, "connections": edges}
        label = docs.select(F.min("source")).first()[0]
        row = self.spark.createDataFrame([(label, n, total - n, edges, tags or [], database)], "source string, chunks_stored int, chunks_skipped int, connections_seeded int, tags array<string>, database_id string")
        self._append("ingest_events", I.event_of(row, self._now()))
        return out

    def _seed(self, seeds: DataFrame, database: str) -> int:
        rows = seeds.withColumnsRenamed({"source": "source_chunk", "target": "target_chunk"})
        fresh = I.insert_or_ignore(rows, self.table("connections"), ["source_chunk", "target_chunk", "relationship"])
        zero = {c: F.lit(0) for c in ("access_count", "support_count", "contradict_count")}
        return self._append("connections", fresh.withColumns({"edge_id": F.sha2(F.concat_ws("\x1f", "source_chunk", "target_chunk", "relationship"), 256), "created_at": self._now(), "database_id": F.lit(database), "evidence_score": F.lit(0.0), "weight_version": F.lit(1), **zero}))

    # ---- retrieval

    def _queries(self, texts: list[str], database: str) -> DataFrame:
        df = self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "q int, question string")
        return embed_column(df, "question", "v", self.p.embed).withColumn("database_id", F.lit(database))

    def _rows(self) -> DataFrame:
        return self.table("chunks").where("v is not null").select(F.col("chunk_id").alias("id"), "v", "database_id")

    def _edges(self, database: str) -> DataFrame:
        return self.table("connections").where(F.col("database_id") == database).select(F.col("source_chunk").alias("source"), F.col("target_chunk").alias("target"), "relationship", F.col("weight").alias("w"))

    def retrieve(self, texts: list[str], database: str = DEFAULT_DATABASE, top: int = 20, hops: int = CONFIG.max_hops, relationships: list[str] | None = None, least: float = CONFIG.min_score, log: bool = True) -> DataFrame:
        """(q, id, score, rank, layer, depth, conflicts, text, source): hybrid results of each text, re-ranked if a model is given.

        With `log`, the results count as accessed: events are logged and counters grow.
        """
        top, hops = (int(top) if top and top > 0 else 20), max(0, int(hops))
        queries = self._queries(texts, database)
        model = self._prior(database)
        prior = None
        if model.trained_on:
            scores = self._concept_predictions(queries, model)
            prior = M.chunk_scores(M.membership(self.table("concepts").where(F.col("database_id") == database)), scores)
        found = R.hybrid(queries, self._rows(), self._edges(database), max(top, CONFIG.rerank_candidates) if self.p.rerank else top, hops, relationships, least if not self.p.rerank else -1.0, prior=prior, influence=model.influence())
        texts_of = self.table("chunks").select(F.col("chunk_id").alias("id"), "text", "source")
        out = found.join(texts_of, "id").join(queries.select("q", "question"), "q")
        if self.p.rerank:
            several = F.count("*").over(_per_query()) > 1
            scored = out.withColumn("rerank_score", F.when(several, rerank_column(F.col("question"), F.col("text"), self.p.rerank)))
            out = top_k(blended(scored).drop("rerank_score", "rank"), top, least)
        out = durable(out.drop("question").withColumn("database_id", F.lit(database)))
        if log and not out.isEmpty():
            self._log(out, queries, database)
        return out.orderBy("q", "rank")

    def _log(self, results: DataFrame, queries: DataFrame, database: str) -> None:
        ms = F.lit(int(self.clock().timestamp() * 1000)).cast("long")
        rows = results.select("q", "id", "rank").join(queries.select("q", F.col("question").alias("query_text")), "q")
        events = O.co_access_log(rows, ms).withColumn("database_id", F.lit(database))
        vec = queries.select(F.sha2(F.coalesce("question", F.lit("")), 256).alias("h"), F.to_json("v").alias("query_embedding")).dropDuplicates(["h"])
        events = events.join(vec, F.col("query_hash") == F.col("h"), "left").drop("h")
        self._append("co_access_events", events)
        self._append("access_log", results.groupBy(F.col("id").alias("chunk_id")).agg(F.count("*").alias("n")).withColumn("at", self._now()))

    def retrieve_by_vector(self, vectors: DataFrame, k: int = 10) -> DataFrame:
        """Nearest chunks of query vectors (q, v, database_id)."""
        return knn(vectors, self._rows(), k, "database_id")

    def _concept_rows(self, database: str) -> DataFrame:
        return self.table("concepts").where((F.col("database_id") == database) & F.col("v").isNotNull() & (F.trim("label") != ""))

    def retrieve_concepts(self, texts: list[str], database: str = DEFAULT_DATABASE, k: int = CONFIG.concept_top_k, least: float = CONFIG.concept_min_score) -> DataFrame:
        c = self._concept_rows(database)
        hits = R.concept_hits(self._queries(texts, database), c.select("concept_id", "v"), k, least)
        return hits.join(c.select("concept_id", "label", "summary", F.coalesce("confidence", F.lit(0.5)).alias("confidence")), "concept_id")

    def expand_with_concepts(self, texts: list[str], database: str = DEFAULT_DATABASE, k: int = CONFIG.concept_top_k, most: int = 20) -> DataFrame:
        c = self._concept_rows(database)
        hits = R.concept_hits(self._queries(texts, database), c.select("concept_id", "v"), k)
        layer = R.concept_layer(hits, c.select("concept_id", "members", "confidence"))
        return top_k(layer, most)

    def query_answer(self, question: str, database: str = DEFAULT_DATABASE, with_concepts: bool = True) -> dict:
        """Answer, evidence, concepts, the edges among the evidence and the sources of one question."""
        queries = self._queries([question], database)
        seeds = knn(queries, self._rows(), CONFIG.context_top_k, "database_id").select("q", "id", F.col("sim").alias("score"), F.lit("vector").alias("layer"))
        layers = [seeds]
        concepts = self.retrieve_concepts([question], database) if with_concepts else None
        if with_concepts:
            layers.append(self.expand_with_concepts([question], database).select("q", "id", "score", "layer"))
        merged = ranked(merge_layers(*layers))
        rows = merged.join(self.table("chunks").select(F.col("chunk_id").alias("id"), "text", "source"), "id")
        ctx = C.contexts(rows, concepts)
        answer = C.answers(ctx, queries.select("q", "question"), self.p.answer).first()
        best = C.evidence(rows)
        return {
            "answer": answer["answer"],
            "sources": list(answer["sources"]),
            "evidence": [r.asDict() for r in best.select("id", "score", "source", F.substring("text", 1, 300).alias("text")).orderBy(F.desc("score"), "id").collect()],
            "concepts_used": [r["label"] for r in concepts.orderBy("rank").collect()] if with_concepts else [],
            "graph_edges": [r.asDict() for r in inner_edges(best, self._edges(database)).orderBy(F.desc("w"), "source", "target").collect()],
            "database": database,
        }

    # ---- consolidation

    def classify(self, limit: int | None = None) -> None:
        """Type untyped edges by the classifier; contradictions flag both chunks."""
        edges = self.table("connections")
        todo = edges.where("relationship = 'related_to'").orderBy("edge_id")
        todo = todo.limit(limit) if limit is not None else todo
        nodes = self.table("chunks").select(F.col("chunk_id").alias("node"), "text")
        label_of = self.p.classify

        def one(a: str | None, b: str | None) -> str | None:
            try:
                return label_of(a, b)
            except Exception:
                return None

        @F.pandas_udf("string")
        def label(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

        new = O.classified(O.with_texts(todo, nodes), label("source_text", "target_text"), self._now()).drop("source_text", "target_text")
        new = durable(new)
        # a triplet is unique, so an edge whose new type is taken keeps its own
        taken = edges.select("source_chunk", "target_chunk", "relationship")
        new = durable(new.where("relationship <> 'related_to'").join(taken, ["source_chunk", "target_chunk", "relationship"], "left_anti").unionByName(new.where("relationship = 'related_to'")).select(*edges.columns))
        self.store.write("connections", edges.join(new.select("edge_id"), "edge_id", "left_anti").unionByName(new))
        if not new.where("relationship = 'contradicts'").isEmpty():
            chunks = self.store.read("chunks").withColumn("node", F.col("chunk_id"))
            self.store.write("chunks", O.flagged(chunks, self.table("connections")).drop("node"))

    def tick(self, since_ms: int = 0, hebbian: bool = True) -> None:
        """Reinforce, decay and strengthen edges once."""
        events = self.table("co_access_events").where(F.col("timestamp") > since_ms)
        nodes = self.table("chunks").select(F.col("chunk_id").alias("node"), "access_count")
        vectors = self.store.read("chunks").where("v is not null").select(F.col("chunk_id").alias("id"), "v", "database_id")
        self.store.write("connections", consolidation_tick(self.table("connections"), nodes, events, self.clock(), hebbian, vectors))

    def cluster(self, database: str = DEFAULT_DATABASE, least: float = CONFIG.leader_cosine) -> int:
        """Replace a database's concepts by leader clusters of its chunks."""
        rows = self.table("chunks").where((F.col("database_id") == database) & F.col("v").isNotNull())
        found = leader_clusters(rows.select("database_id", F.col("chunk_id").alias("id"), F.col("timestamp").alias("ts"), "v"), least)
        joined = found.join(rows.select(F.col("chunk_id").alias("id"), "text", "v"), "id")
        return self._store_concepts(joined.select(F.concat(F.lit("leader "), F.col("cluster").cast("string")).alias("k"), "id", "text", "v"), database, replace=True)

    def abstract(self, database: str = DEFAULT_DATABASE) -> int:
        """A concept for each component of strong edges of at least three chunks; one that overlaps an existing concept renews it under its id, an equal one changes nothing."""
        edges = self.table("connections").where(F.col("database_id") == database)
        comp = strong_components(edges)
        rows = comp.join(self.table("chunks").select(F.col("chunk_id").alias("id"), "text", "v"), "id").where("text is not null")
        enough = rows.groupBy("component").count().where(F.col("count") >= CONFIG.cluster_min_size).select("component")
        loose = splittable(edges).select(F.col("component").alias("k"))
        made = self._store_concepts(rows.join(enough, "component").select(F.col("component").alias("k"), "id", "text", "v"), database, replace=False, splits=loose)
        self.merge_concepts(database)
        return made

    def merge_concepts(self, database: str = DEFAULT_DATABASE) -> int:
        """Fold concepts of a database that overlap and are alike; what takes others gets a summary of its members anew. Returns how many went."""
        every = self.table("concepts")
        mine = every.where(F.col("database_id") == database)
        into = durable(O.merge_pairs(P.alike(mine.where("v is not null")).select("a", "b")))
        n = into.count()
        if n:
            out = O.merged(mine, into, self._now())
            taken = out.join(into.select(F.col("into").alias("concept_id")).distinct(), "concept_id", "left_semi").select(F.col("concept_id").alias("k"), F.explode("members").alias("id"))
            named = self._named(taken.join(self.store.read("chunks").select(F.col("chunk_id").alias("id"), "text"), "id"))
            fresh = out.join(named.withColumnsRenamed({"k": "concept_id", "label": "new_label", "summary": "new_summary"}), "concept_id", "left")
            fresh = fresh.withColumns({"label": F.coalesce("new_label", "label"), "summary": F.coalesce("new_summary", "summary")}).select(*every.columns)
            self.store.write("concepts", every.where(F.coalesce("database_id", F.lit("")) != database).unionByName(durable(fresh)))
        return n

    def _named(self, rows: DataFrame) -> DataFrame:
        """(k, label, summary) of clusters (k, id, text)."""
        summarise, label_of = self.p.summarise, self.p.label

        def make(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("id")
            texts = [t[:300] for t in part["text"].iloc[:10] if isinstance(t, str)]
            return pd.DataFrame({"k": [part["k"].iloc[0]], "label": [(label_of(texts) or UNLABELED)[:60]], "summary": [summarise(texts)]})

        # ten texts speak for a cluster, so no large one is gathered
        from pyspark.sql.window import Window

        few = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id"))).where("n <= 10").select("k", "id", "text")
        return few.groupBy("k").applyInPandas(make, "k string, label string, summary string")

    def _validated(self, fresh: DataFrame) -> DataFrame:
        """(k, score): how well each cluster (k, summary, members, v) holds together, by a model if there is one, else by its vectors."""
        chunks = self.store.read("chunks").where("v is not null").select(F.col("chunk_id").alias("id"), "v", "text")
        clusters = fresh.withColumnRenamed("k", "cluster")
        if not self.p.validate:
            return P.validation(clusters.select("cluster", "members", "v"), chunks, "id").withColumnRenamed("cluster", "k")
        model = self.p.validate
        sides = P.non_members(clusters.select("cluster", "members"), chunks, "id").join(clusters, "cluster")
        flat = sides.select("cluster", "summary", F.explode(F.slice("members", 1, 3)).alias("id"), F.lit(True).alias("inside")).unionByName(sides.select("cluster", "summary", F.explode("others").alias("id"), F.lit(False).alias("inside")))
        texts = flat.join(chunks.select("id", "text"), "id").groupBy("cluster").agg(F.first("summary").alias("s"), F.collect_list(F.when(F.col("inside"), F.col("text"))).alias("a"), F.collect_list(F.when(~F.col("inside"), F.col("text"))).alias("b"))

        def one(s: str, a: list[str], b: list[str]) -> float:
            try:
                return min(1.0, max(0.0, float(model(s, list(a), list(b)))))
            except Exception:
                return 0.5

        @F.pandas_udf("double")
        def score(s: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([one(*x) for x in zip(s, a, b, strict=True)])

        return texts.select(F.col("cluster").alias("k"), score("s", "a", "b").alias("score"))

    def _store_concepts(self, rows: DataFrame, database: str, replace: bool, splits: DataFrame | None = None) -> int:
        named = self._named(rows)
        members = rows.groupBy("k").agg(F.array_sort(F.collect_set("id")).alias("members"))
        mean = centroids(rows.select("k", "v").where("v is not null"))
        fresh = members.join(named, "k").join(mean, "k", "left").select("k", "label", "summary", "members", "v")
        old = self.table("concepts")
        mine = old.where(F.col("database_id") == database)
        others = old.where(F.coalesce("database_id", F.lit("")) != database)
        new_id = F.concat(F.lit("concept:"), F.sha2(F.concat_ws("\x1f", F.lit(database), F.col("k")), 256))
        base = {"created_at": self._now(), "last_updated": self._now(), "database_id": F.lit(database), "confidence": F.lit(0.5), "version": F.lit(1), "embedding_version": F.lit(1)}
        cols = old.columns
        if replace:
            made = durable(fresh.withColumns({"concept_id": new_id, **base}).select(*cols))
            self.store.write("concepts", others.unionByName(made))
            return made.count()
        fresh = durable(fresh)
        scored = durable(self._validated(fresh))
        fresh = fresh.join(scored, "k", "left").withColumn("score", F.coalesce("score", F.lit(0.5)))
        # matches are greedy in the order of clusters, over the overlaps only
        found = O.matched_once(O.overlaps(fresh.select(F.col("k").alias("cluster"), "members"), mine.select("concept_id", "members")))
        match = found.select(F.col("cluster").alias("k"), F.col("concept_id").alias("old_id"), "jaccard")
        joined = fresh.join(match, "k", "left").where("jaccard is null or jaccard < 1")
        before = mine.select(F.col("concept_id").alias("old_id"), F.col("version").alias("old_version"), F.col("created_at").alias("old_created"), F.col("embedding_version").alias("old_embedding"))
        joined = joined.join(before, "old_id", "left")
        if splits is not None:
            # a cluster that doesn't hold together waits until its parts are clusters of their own
            joined = joined.join(splits.withColumn("loose", F.lit(True)), "k", "left").where(f"score >= {CONFIG.validation_least} or loose is null")
        renewed = {
            "concept_id": F.coalesce("old_id", new_id), **base, "created_at": F.coalesce("old_created", self._now()), "confidence": F.col("score"),
            "version": F.coalesce(F.col("old_version") + 1, F.lit(1)), "embedding_version": F.coalesce("old_embedding", F.lit(1)),
        }
        made = durable(joined.withColumns(renewed).select(*cols))
        kept = mine.join(made.select("concept_id"), "concept_id", "left_anti")
        self.store.write("concepts", others.unionByName(kept.select(*cols)).unionByName(made))
        return made.count()

    def sync_concepts(self) -> int:
        """Embed the summaries of concepts whose vector is older than their text."""
        from tessera.operators.readouts import stale_concepts
        c = self.table("concepts")
        stale = durable(stale_concepts(c).select("concept_id"))
        todo = embed_column(c.join(stale, "concept_id", "left_semi"), "summary", "v", self.p.embed).withColumn("embedding_version", F.col("version"))
        self.store.write("concepts", c.join(stale, "concept_id", "left_anti").unionByName(todo.select(*c.columns)))
        return stale.count()

    def _prior(self, database: str) -> M.Prior:
        concepts = [r[0] for r in self.table("concepts").where(F.col("database_id") == database).select("concept_id").orderBy("concept_id").collect()]
        rows = self.table("associative_memory").where(self._is_model(database)).toLocalIterator()
        return M.Prior.from_rows((r.asDict(recursive=True) for r in rows), self.dims, concepts)

    def _is_model(self, database: str) -> Column:
        """Whether a row has a part of a database's model."""
        return F.substring_index("model_id", "\x1f", 1) == M.model_id(database)

    def _concept_predictions(self, queries: DataFrame, model: M.Prior) -> DataFrame:
        import numpy as np

        rows = queries.select("q", "v").collect()  # the stated queries of one call
        p = model.predict(np.array([r["v"] for r in rows]))
        flat = [(r["q"], c, float(p[i, j])) for i, r in enumerate(rows) for j, c in enumerate(model.concepts)]
        return self.spark.createDataFrame(flat, "q int, concept_id string, score double")

    def train(self, database: str = DEFAULT_DATABASE, since_ms: int = 0) -> int:
        """Train the database's prior on its events; returns on how many it has been trained in all."""
        events = self.table("co_access_events").where((F.col("timestamp") > since_ms) & (F.col("database_id") == database))
        mine = self.table("concepts").where(F.col("database_id") == database)
        model = self._prior(database)
        model = M.train(M.training_set(events, mine, self.dims), model.concepts, self.dims, prior=model)
        old = self.table("associative_memory")
        state = old.where(~self._is_model(database))
        for row in model.to_rows(database, int(self.clock().timestamp() * 1000)):
            new = self.spark.createDataFrame([row | {"database_id": database}], _SCHEMAS["associative_memory"], verifySchema=False)
            state = state.unionByName(new.select(*old.columns))
        self.store.write("associative_memory", state)
        return model.trained_on

    def run_due(self, database: str = DEFAULT_DATABASE, batch: int | None = None) -> list[str]:
        """One turn of the worker: what is always done, and what is due by the clock, in its fixed order. Returns the names of what ran."""
        cadence, now = Cadence(self.store), self.clock()
        ran = ["classify", "tick"]
        self.classify(batch)
        hebbian = cadence.due("hebbian", now)
        since = cadence.last("hebbian")
        self.tick(int(since.timestamp() * 1000) if since else 0, hebbian)
        if hebbian:
            cadence.ran("hebbian", now)
            ran.append("hebbian")
        if cadence.due("cluster", now) or self.table("concepts").where(F.col("database_id") == database).isEmpty():
            self.cluster(database)
            cadence.ran("cluster", now)
            ran.append("cluster")
        if cadence.due("train", now):
            since = cadence.last("train")
            self.train(database, int(since.timestamp() * 1000) if since else 0)
            cadence.ran("train", now)
            ran.append("train")
        self.abstract(database)
        self.sync_concepts()
        return [*ran, "abstract", "sync"]

    # ---- images, overviews, benchmark

    def ingest_images(self, folder: str, database: str = DEFAULT_DATABASE) -> int:
        """Vectors of the images under a folder; those that can't be embedded are left out. Returns how many were stored."""
        embed = self.p.embed_image
        if embed is None:
            raise ValueError("no model for images is given")

        def one(path: str) -> list[float] | None:
            try:
                return [float(x) for x in embed(path)] or None
            except Exception:
                return None

        @F.pandas_udf("array<double>")
        def vector(paths: pd.Series) -> pd.Series:
            return paths.map(one)

        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").where(kind_of(F.col("path")) == "image")
        known = self.table("image_vectors").where(F.col("database_id") == database).select("path")
        rows = files.join(known, "path", "left_anti").select("path", vector("path").alias("v"), F.lit(database).alias("database_id"))
        return self._append("image_vectors", rows.where("v is not null"))

    def nearest_images(self, vectors: DataFrame, k: int = 10) -> DataFrame:
        """(q, id, sim, rank): the nearest images of query vectors (q, v, database_id)."""
        return knn(vectors, self.table("image_vectors").select(F.col("path").alias("id"), "v", "database_id"), k, "database_id")

    def audio_overview(self, question: str, database: str = DEFAULT_DATABASE, form: str = "dialogue") -> dict:
        """A spoken overview of what is stored about a question: script, segments, seconds, and sound if there is a voice.

        Eight results over two hops, the five best as evidence; without results it is an error.
        """
        best = self.retrieve([question], database, 8, 2, log=False).orderBy("rank").limit(CONFIG.max_evidence).collect()
        if not best:
            raise LookupError(f"nothing is stored about {question!r}")
        evidence = "\n\n".join(f"---- Source: {r['source']}\n{r['text'].strip()}" for r in best)
        script = self.p.script(question, evidence, form)
        row = self.spark.createDataFrame([(script,)], "t string").select(script_segments(F.col("t"), form).alias("s")).select("s", script_seconds(F.col("s")).alias("n")).first()
        parts = [(x["speaker"], x["text"]) for x in row["s"]]
        return {"script": script, "segments": parts, "seconds": row["n"], "sources": list(dict.fromkeys(r["source"] for r in best)), "sound": b"".join(self.p.speak(*p) for p in parts) if self.p.speak else None}

    def benchmark(self, database: str = DEFAULT_DATABASE, top: int = 5, keep: int = 10) -> DataFrame:
        """(query, ms, n, top_score, mean_score, overlap): the fixed queries, with how much of each result the run before had. The last `keep` runs are kept."""
        from time import perf_counter

        rows, chunks, edges = [], self.store.read("chunks").count(), self.table("connections").count()
        for q in BENCHMARK_QUERIES:
            began = perf_counter()
            got = self.retrieve([q], database, top, log=False).orderBy("rank").collect()
            rows.append((self.clock(), chunks, edges, q, [r["id"] for r in got], [float(r["score"]) for r in got], (perf_counter() - began) * 1000))
        at = rows[0][0]
        fresh = durable(self.spark.createDataFrame([(at, *r[1:]) for r in rows], _SCHEMAS["benchmark_runs"]))
        history = self.table("benchmark_runs")
        before = history.agg(F.max("run_at")).first()[0]
        old = history.where(F.col("run_at") == before).select("query", F.col("ids").alias("old"))
        recent = history.select("run_at").distinct().orderBy(F.desc("run_at")).limit(keep - 1)
        self.store.write("benchmark_runs", durable(history.join(recent, "run_at", "left_semi")).unionByName(fresh))
        same = F.size(F.array_intersect("ids", "old")) / F.greatest(F.size("ids"), F.size("old"), F.lit(1))
        mean = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("scores"), F.lit(1))
        return fresh.join(old, "query", "left").select("query", "ms", F.size("ids").alias("n"), F.array_max("scores").alias("top_score"), mean.alias("mean_score"), F.when(F.col("old").isNotNull(), same).alias("overlap"))

    def stats(self) -> DataFrame:
        """Chunks, connections and concepts of each database."""
        return stats_counts(self.store.read("chunks"), self.table("connections"), self.table("concepts"))

    def consolidate(self, database: str = DEFAULT_DATABASE) -> dict[str, int]:
        """Everything once: type all edges, reinforce, decay and strengthen, cluster if there are no concepts, train, abstract, sync."""
        self.classify()
        self.tick()
        clustered = self.cluster(database) if self.table("concepts").where(F.col("database_id") == database).isEmpty() else 0
        trained = self.train(database)
        return {"clustered": clustered, "trained_on": trained, "abstracted": self.abstract(database), "synced": self.sync_concepts()}


def _per_query():  # noqa: ANN202
    from pyspark.sql.window import Window

    return Window.partitionBy("q")
