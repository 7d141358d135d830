"""Queries over the relational read-outs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import readouts as R
from tessera.plans.registry import query
from tessera.plans.sql import with_views
from tessera.sources import views as V

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _text_time(df, *cols):  # noqa: ANN001, ANN202
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


@query("stats_counts", with_views("chunks_v edges_v concepts_v", """
select database_id, cast(sum(a) as bigint) as chunks, cast(sum(b) as bigint) as connections, cast(sum(c) as bigint) as concepts from (
 select database_id, 1 as a, 0 as b, 0 as c from chunks_v union all select database_id, 0, 1, 0 from edges_v union all select database_id, 0, 0, 1 from concepts_v) group by 1"""))
def stats_counts(spark, d):
    return R.stats_counts(V.chunks(spark, d), V.edges(spark, d), V.concepts(spark, d))


@query("relationship_counts", with_views("edges_v", """
select r.relationship, count(e.edge_id) as n from (values ('supports'),('contradicts'),('example_of'),('caused_by'),('related_to')) r(relationship)
left join edges_v e on e.relationship=r.relationship group by 1"""))
def relationship_counts(spark, d):
    return R.relationship_counts(V.edges(spark, d))


@query("top_sources", with_views("chunks_v", "select source, count(*) as chunks from chunks_v group by 1 order by 2 desc, 1 nulls last limit 10"))
def top_sources(spark, d):
    return R.top_sources(V.chunks(spark, d))


@query("recent_chunks", with_views("chunks_v", f"select chunk_id, source, substr(text,1,80) as preview, {TS.format('ts')} as timestamp from chunks_v order by ts desc nulls last, chunk_id limit 10"))
def recent_chunks(spark, d):
    return _text_time(R.recent_chunks(V.chunks(spark, d)), "timestamp")


@query("chunk_listing_search", with_views("chunks_v", f"""select chunk_id, source, page, substr(text,1,300) as preview, {TS.format('ts')} as timestamp, access_count
from chunks_v where database_id='default' and lower(text) like '%query%vector%' order by ts desc nulls last, chunk_id limit 50 offset 5"""))
def chunk_listing_search(spark, d):
    return _text_time(R.chunk_listing(V.chunks(spark, d), "default", "Query%Vector", offset=5), "timestamp")


@query("graph_export_links", with_views("edges_v", "select edge_id, source_chunk, target_chunk, relationship, weight, confidence from edges_v where weight>=0.1"))
def graph_export_links(spark, d):
    return R.graph_links(V.edges(spark, d))


@query("graph_export_nodes", with_views("edges_v chunks_v", """select chunk_id, source, substr(text,1,80) as preview, access_count from chunks_v where lower(chunk_id) in
(select source_chunk from edges_v where weight>=0.1 union select target_chunk from edges_v where weight>=0.1)"""))
def graph_export_nodes(spark, d):
    return R.graph_nodes(V.edges(spark, d), V.chunks(spark, d))


@query("sources_rollup", with_views("edges_v chunks_v", f"""select source, count(*) as chunks, max(case when rn=1 then n end) as connections, {TS.format('max(ts)')} as last_timestamp from (
select c.*, o.n, row_number() over (partition by c.source order by c.ts desc nulls last, c.chunk_id desc) as rn
from chunks_v c left join (select source_chunk, count(*) as n from edges_v group by 1) o on lower(c.chunk_id)=o.source_chunk) group by source"""))
def sources_rollup(spark, d):
    return _text_time(R.sources_rollup(V.chunks(spark, d), V.edges(spark, d)), "last_timestamp")


@query("ingest_recent", with_views("ingest_v", f"select event_id, source, chunks_stored, chunks_skipped, connections_seeded, {TS.format('ts')} as timestamp from ingest_v order by ts desc nulls last, event_id limit 5"))
def ingest_recent(spark, d):
    return _text_time(R.recent_ingests(V.ingest_events(spark, d)), "timestamp")


@query("ingest_since", with_views("ingest_v", f"select event_id, source, chunks_stored, {TS.format('ts')} as timestamp from ingest_v where database_id='default' and ts>=timestamp '2025-06-01 12:00:00' order by ts desc, event_id limit 100"))
def ingest_since(spark, d):
    return _text_time(R.ingests_since(V.ingest_events(spark, d), "default", F.lit("2025-06-01 12:00:00").cast("timestamp")), "timestamp")


@query("ingest_since_text", "select event_id, timestamp from ingest_events where timestamp >= '2025-06-01 12:00:00'")
def ingest_since_text(spark, d):
    from tessera.sources.tables import table

    return R.since_as_text(table(spark, d, "ingest_events", "event_id", "timestamp"), "2025-06-01 12:00:00")


@query("concept_listing", with_views("concepts_v", f"select concept_id, label, cast(len(members) as int) as n_members, confidence, version, {TS.format('last_updated')} as last_updated, database_id from concepts_v"))
def concept_listing(spark, d):
    return _text_time(R.concept_listing(V.concepts(spark, d)), "last_updated")


@query("stale_concepts", with_views("concepts_v", "select concept_id, version, embedding_version from concepts_v where embedding_version<version and coalesce(trim(summary),'')<>''"))
def stale_concepts(spark, d):
    return R.stale_concepts(V.concepts(spark, d))


@query("untyped_edge_batch", with_views("edges_v", "select edge_id, source_chunk, target_chunk, weight from edges_v where relationship='related_to' order by edge_id limit 10"))
def untyped_edge_batch(spark, d):
    return R.untyped_batch(V.edges(spark, d))


@query("untyped_sources", with_views("edges_v", "select distinct source_chunk from edges_v where relationship='related_to'"))
def untyped_sources(spark, d):
    return R.untyped_sources(V.edges(spark, d))


@query("untyped_by_source", with_views("edges_v", """select source_chunk, edge_id, weight, cast(row_number() over (partition by source_chunk order by weight desc, confidence desc nulls last, created_at desc nulls last, edge_id) as int) as rank
from edges_v where relationship='related_to'"""))
def untyped_by_source(spark, d):
    return R.untyped_ranked(V.edges(spark, d))


@query("hot_chunks", with_views("chunks_v", "select chunk_id, access_count from chunks_v where access_count>3"))
def hot_chunks(spark, d):
    return R.hot_chunks(V.chunks(spark, d))


@query("decay_candidates", with_views("edges_v", "select edge_id from edges_v where coalesce(last_seen,last_reinforced,created_at) < timestamp '2025-12-25 00:00:00'"))
def decay_candidates(spark, d):
    return R.decay_candidates(V.edges(spark, d), F.lit("2026-01-01 00:00:00").cast("timestamp")).select("edge_id")


@query("edges_per_source", with_views("edges_v chunks_v", "select c.source, count(*) as edges from edges_v e join chunks_v c on lower(c.chunk_id)=e.source_chunk group by 1"))
def edges_per_source(spark, d):
    return R.edges_per_source(V.edges(spark, d), V.chunks(spark, d))


@query("databases_list", "select id, name from memory_databases order by name, id")
def databases_list(spark, d):
    from tessera.sources.tables import table

    return table(spark, d, "memory_databases", "id", "name").orderBy("name", "id")
