"""Queries over edge dynamics, concepts, components, the prior, and mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import CONFIG
from tessera.operators import catalog as C
from tessera.operators import clusters as L
from tessera.operators import components as P
from tessera.operators import consolidate as O
from tessera.operators import ingest as I
from tessera.operators import prior as M
from tessera.plans.registry import query
from tessera.plans.sql import with_views
from tessera.sources import views as V
from tessera.sources.tables import table

_NOW = "timestamp '2026-01-01 00:00:00'"


def _now():  # noqa: ANN202
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def _nodes(spark, d):  # noqa: ANN001, ANN202
    return V.chunks(spark, d).withColumn("node", F.lower("chunk_id"))


_BASE = "case {r} when 'supports' then 0.8 when 'contradicts' then 0.7 when 'example_of' then 0.75 when 'caused_by' then 0.75 else 0.3 end"
_SIM = "case when avg_sim>0 then avg_sim else 0.5 end"
_CONF = "(cast({s} as double)+1)/({s}+{c}+2)"
_REC = f"case when last_seen is null then 1.0 else 0.5+0.5*exp(-greatest((epoch({_NOW})-epoch(last_seen))/86400.0,0)/30) end"
_CONF0 = _CONF.format(s="support_count", c="contradict_count")


@query("edge_reweight", with_views("edges_v", f"""select edge_id, greatest(0.05,least(1.0, {_BASE.format(r='relationship')}*{_SIM}*(0.5+0.5*{_CONF0})*{_REC})) as weight,
 {_BASE.format(r='relationship')}*{_CONF0}*{_SIM} as evidence_score from edges_v"""), doubles="weight evidence_score")
def edge_reweight(spark, d):
    return O.reweighted(V.edges(spark, d), _now()).select("edge_id", "weight", "evidence_score")


_LAB = "case hash_n%4 when 0 then 'supports' when 1 then 'contradicts' when 2 then 'caused_by' else null end"
_S1 = "(support_count+case when rel in ('supports','example_of','caused_by') then 1 else 0 end)"
_C1 = "(contradict_count+case when rel='contradicts' then 1 else 0 end)"


@query("classify_apply", with_views("edges_v", f"""select edge_id, rel as relationship, cast({_S1} as int) as support_count, cast({_C1} as int) as contradict_count, seen_count+1 as seen_count, weight_version+1 as weight_version,
 greatest(0.05,least(1.0,{_BASE.format(r='rel')}*{_SIM}*(0.5+0.5*{_CONF.format(s=_S1,c=_C1)}))) as weight, {_CONF.format(s=_S1,c=_C1)} as confidence from (
 select * replace (coalesce(seen_count,0) as seen_count, coalesce(weight_version,1) as weight_version), coalesce({_LAB.replace('hash_n',"cast('0x'||substr(edge_id,1,4) as int)")},'related_to') as rel from edges_v where relationship='related_to')"""), doubles="weight confidence")
def classify_apply(spark, d):
    """A stand-in for the classifier labels by the edge's id; an error of it is a null."""
    n = F.conv(F.substring("edge_id", 1, 4), 16, 10).cast("int") % 4
    label = F.when(n == 0, "supports").when(n == 1, "contradicts").when(n == 2, "caused_by")
    return O.classified(V.edges(spark, d), label, _now()).select("edge_id", "relationship", "support_count", "contradict_count", "seen_count", "weight_version", "weight", "confidence")


@query("edge_texts", with_views("edges_v chunks_v", "select e.edge_id, substr(a.text,1,200) as source_text, substr(b.text,1,200) as target_text from edges_v e join chunks_v a on lower(a.chunk_id)=e.source_chunk join chunks_v b on lower(b.chunk_id)=e.target_chunk where e.relationship='related_to' and a.text is not null and b.text is not null"))
def edge_texts(spark, d):
    e = V.edges(spark, d).where("relationship = 'related_to'").select("edge_id", "source_chunk", "target_chunk")
    return O.with_texts(e, _nodes(spark, d)).select("edge_id", F.substring("source_text", 1, 200).alias("source_text"), F.substring("target_text", 1, 200).alias("target_text"))


@query("contradiction_flags", with_views("edges_v chunks_v", """select chunk_id, greatest(coalesce(contradiction_flag,0), case when lower(chunk_id) in (select source_chunk from edges_v where relationship='contradicts' union select target_chunk from edges_v where relationship='contradicts') then 1 else 0 end) as contradiction_flag from chunks_v"""))
def contradiction_flags(spark, d):
    return O.flagged(_nodes(spark, d), V.edges(spark, d)).select("chunk_id", "contradiction_flag")


@query("reinforce_edges", with_views("edges_v chunks_v", """select e.edge_id, greatest(0.05,least(1.0,e.weight+0.02+0.08*least(1.0,c.access_count/20.0)*coalesce(e.confidence,0.5)*coalesce(e.avg_sim,0))) as weight
 from edges_v e join chunks_v c on lower(c.chunk_id)=e.source_chunk where c.access_count>3"""), doubles="weight")
def reinforce_edges(spark, d):
    return O.reinforced(V.edges(spark, d), _nodes(spark, d))


@query("decay_edges", with_views("edges_v", f"""select edge_id, greatest(0.05, weight*(1-(0.01/ln(1+greatest(1,coalesce(access_count,0))))*case when (epoch({_NOW})-epoch(coalesce(last_reinforced,created_at)))/86400.0>7 then 1.5 else 1.0 end)) as weight from edges_v"""), doubles="weight")
def decay_edges(spark, d):
    return O.decayed(V.edges(spark, d), _now())


_PAIRS = """, pairs as (select least(x,y) as a, greatest(x,y) as b, count(*) as times from (select ids[i] as x, ids[j] as y from coaccess_v, range(1,200) r(i), range(1,200) s(j) where i<j and j<=len(ids) ) group by 1,2)"""


@query("coaccess_pairs", with_views("coaccess_v", _PAIRS + " select * from pairs"))
def coaccess_pairs(spark, d):
    return O.co_access_pairs(V.co_access(spark, d))


@query("hebbian_update", with_views("coaccess_v edges_v", _PAIRS + """, one as (select least(source_chunk,target_chunk) as a, greatest(source_chunk,target_chunk) as b, edge_id, weight from edges_v
 qualify row_number() over (partition by least(source_chunk,target_chunk), greatest(source_chunk,target_chunk) order by source_chunk>target_chunk, edge_id)=1)
 select edge_id, greatest(0.05,least(1.0,1-(1-weight)*pow(0.95,times))) as weight, times from pairs join one using (a,b)"""), doubles="weight")
def hebbian_update(spark, d):
    return O.hebbian_updates(coaccess_pairs(spark, d), V.edges(spark, d))


@query("hebbian_new_edges", with_views("coaccess_v edges_v", _PAIRS + """ select a, b, 'co_accessed' as relationship, greatest(0.05,least(1.0,1-0.95*pow(0.95,times-1))) as weight, times from pairs p
 where not exists (select 1 from edges_v e where least(e.source_chunk,e.target_chunk)=p.a and greatest(e.source_chunk,e.target_chunk)=p.b)"""), doubles="weight")
def hebbian_new_edges(spark, d):
    return O.hebbian_new(coaccess_pairs(spark, d), V.edges(spark, d))


_VEC = "cast(cast('0x'||substr({0},1,6) as bigint) % (select count(*) from vectors_v) as bigint)"


@query("hebbian_gated", with_views("coaccess_v edges_v vectors_v", _PAIRS + f""", new as (select a, b, times from pairs p where not exists (select 1 from edges_v e where least(e.source_chunk,e.target_chunk)=p.a and greatest(e.source_chunk,e.target_chunk)=p.b)),
 two as (select a, b, times, {_VEC.format("a")} as x, {_VEC.format("b")} as y from new where regexp_full_match(substr(a,1,6),'[0-9a-f]{{6}}') and regexp_full_match(substr(b,1,6),'[0-9a-f]{{6}}'))
 select a, b, 'co_accessed' as relationship, greatest(0.05,least(1.0,1-0.95*pow(0.95,times-1))) as weight, times, list_cosine_similarity(x.v,y.v) as sim from two join vectors_v x on x.vec_id=two.x join vectors_v y on y.vec_id=two.y where list_cosine_similarity(x.v,y.v)>0.1"""), doubles="weight sim")
def hebbian_gated(spark, d):
    """New edges between chunks accessed together whose vectors are alike; these vectors are close to random, so the bound is low."""
    from tessera.sources import graphs as G

    v = V.vectors(spark, d)
    pairs, edges = coaccess_pairs(spark, d), V.edges(spark, d)
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    of = ends.withColumn("vec_id", G._vector_of("id", v.count())).where("vec_id is not null").join(v.select("vec_id", "v"), "vec_id").select("id", "v")
    return O.hebbian_new(pairs, edges, O.pair_similarity(O.hebbian_new(pairs, edges).select("a", "b"), of), 0.1)


@query("access_bump", with_views("coaccess_v chunks_v", "select c.chunk_id, coalesce(c.access_count,0)+t.times as access_count, t.times from chunks_v c join (select id, count(*) as times from coaccess_v, unnest(ids) u(id) group by 1) t on t.id=lower(c.chunk_id)"))
def access_bump(spark, d):
    return O.access_bump(_nodes(spark, d), V.co_access(spark, d))


@query("coaccess_since", with_views("coaccess_v", "select event_id, ids, ts as timestamp from coaccess_v where ts>1760000000000 and database_id='default'"))
def coaccess_since(spark, d):
    return V.co_access(spark, d).where("timestamp > 1760000000000 and database_id = 'default'").select("event_id", "ids", "timestamp")


@query("coaccess_log", with_views("seeds_v", """select sha256(cast(q as varchar)||chr(31)||'1767225600000') as event_id, sha256('query '||cast(q as varchar)) as query_hash, list(cast(id as varchar) order by rk) as ids, 1767225600000 as timestamp from seeds_v where rk<=5 group by q"""))
def coaccess_log(spark, d):
    from tessera.plans.queries_retrieval import knn_topk_filtered

    r = knn_topk_filtered(spark, d).where("rank <= 5").withColumn("query_text", F.concat(F.lit("query "), F.col("q").cast("string")))
    return O.co_access_log(r, F.lit(1767225600000).cast("long"))


def _closure(name: str, least: float) -> str:
    """SQL of the strong components over edges of at least a weight, as CTEs that end in `name` (id, component, n)."""
    return f""", {name}_e as (select source_chunk as a, target_chunk as b from edges_v where weight>={least} and source_chunk<>target_chunk union select target_chunk, source_chunk from edges_v where weight>={least} and source_chunk<>target_chunk),
 {name}_r(a,b) as (select a, a from {name}_e union select r.a, e.b from {name}_r r join {name}_e e on e.a=r.b),
 {name} as (select id, component, n from (select id, component, count(*) over (partition by component) as n from (select a as id, min(b) as component from {name}_r group by a)) where n>=3)"""


@query("connected_components", with_views("edges_v", _closure("c", 0.6) + " select * from c").replace("WITH", "WITH RECURSIVE", 1))
def connected_components(spark, d):
    """Components of at least three chunks over edges of at least 0.6."""
    return P.strong_components(V.edges(spark, d))


@query("strong_edge_split", with_views("edges_v", _closure("c", 0.6) + _closure("d", 0.7) + " select c.component, count(distinct d.component) as parts from d join c using (id) group by 1 having count(distinct d.component)>1").replace("WITH", "WITH RECURSIVE", 1))
def strong_edge_split(spark, d):
    return P.splittable(V.edges(spark, d))


@query("jaccard_match", with_views("concepts_v", """select cluster, concept_id, overlap, jaccard from (select *, row_number() over (partition by cluster order by jaccard desc, concept_id) as n from (
 select a.concept_id as cluster, b.concept_id, count(*) as overlap, count(*)*1.0/(any_value(len(a.members))+any_value(len(b.members))-count(*)) as jaccard
 from (select concept_id, members, unnest(members) as m from concepts_v) a join (select concept_id, members, unnest(members) as m from concepts_v) b on a.m=b.m and a.concept_id<>b.concept_id group by 1,2)) where n=1"""), doubles="jaccard")
def jaccard_match(spark, d):
    """Each concept as a cluster against all other concepts."""
    from pyspark.sql.window import Window

    c = V.concepts(spark, d)
    found = O.overlaps(c.select(F.col("concept_id").alias("cluster"), "members"), c).where("cluster <> concept_id")
    w = Window.partitionBy("cluster").orderBy(F.desc("jaccard"), "concept_id")
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


@query("jaccard_best", with_views("concepts_v", """select a.concept_id as cluster, min(b.concept_id) as concept_id, 1.0 as jaccard from concepts_v a join concepts_v b on a.members=b.members where len(a.members)>0 group by 1"""), doubles="jaccard")
def jaccard_best(spark, d):
    """Each concept as a cluster against all concepts, itself among them: the best is the first with the same members."""
    c = V.concepts(spark, d)
    return O.best_jaccard(c.select(F.col("concept_id").alias("cluster"), "members"), c).select("cluster", "concept_id", "jaccard")


@query("concept_merge_candidates", with_views("concepts_v", """select a, b, jaccard from (select a.concept_id as a, b.concept_id as b, count(*)*1.0/(any_value(len(a.members))+any_value(len(b.members))-count(*)) as jaccard
 from (select concept_id, database_id, members, unnest(members) as m from concepts_v) a join (select concept_id, database_id, members, unnest(members) as m from concepts_v) b on a.m=b.m and a.concept_id<b.concept_id and a.database_id=b.database_id group by 1,2) where jaccard>=0.3"""), doubles="jaccard")
def concept_merge_candidates(spark, d):
    return O.merge_candidates(V.concepts(spark, d), 0.3)


@query("centroids", with_views("vectors_v", "select label, list(m order by pos) as v from (select label, pos, avg(v[pos]) as m from vectors_v, range(1,65) t(pos) group by 1,2) group by 1"), doubles="v[]")
def centroids(spark, d):
    return L.centroids(V.vectors(spark, d).select(F.col("label").alias("k"), "v")).select(F.col("k").alias("label"), "v")


@query("leader_clusters")
def leader_clusters(spark, d):
    """Leader clustering of all vectors in each database; the threshold suits these vectors."""
    return L.leader_clusters(V.vectors(spark, d).select("database_id", F.col("vec_id").alias("id"), F.col("vec_id").alias("ts"), "v"), 0.35)


@query("chunk_membership", with_views("concepts_v", "select id, list_sort(list(distinct concept_id)) as concepts from (select concept_id, unnest(members) as id from concepts_v) group by 1"))
def chunk_membership(spark, d):
    return M.membership(V.concepts(spark, d))


@query("chunk_concept_score", with_views("concepts_v", "select 'all' as q, id, greatest(0.0, max(coalesce(confidence,0.5)-0.3)) as prior from (select confidence, unnest(members) as id from concepts_v) group by id"), doubles="prior")
def chunk_concept_score(spark, d):
    c = V.concepts(spark, d)
    return M.chunk_scores(M.membership(c), c.select(F.lit("all").alias("q"), "concept_id", (F.coalesce("confidence", F.lit(0.5)) - 0.3).alias("score")))


@query("mlp_training_set", """WITH ev as (select event_id, max(chunk_ids) as chunk_ids, max(query_embedding) as qe from co_access_events where event_id is not null group by 1),
""" + with_views("concepts_v", """ select event_id, list_sort(list(distinct concept_id)) as concepts from (select event_id, unnest(ids) as id from (select event_id, list_transform(list_filter(json_extract(chunk_ids,'$[*]'), lambda x: json_type(x)='VARCHAR' and (x->>'$')<>''), lambda x: lower(trim(x->>'$',' '||chr(9)))) as ids from ev where json_valid(chunk_ids) and json_valid(qe) and json_array_length(qe)=384)) e
 join (select concept_id, unnest(members) as m from concepts_v) c on c.m=e.id group by 1""").removeprefix("WITH "))
def mlp_training_set(spark, d):
    return M.training_set(V.co_access(spark, d), V.concepts(spark, d), CONFIG.embed_dims).select("event_id", "concepts")


@query("mlp_influence", with_views("coaccess_v", "select database_id, count(*) as samples, least(0.15, 0.15*count(*)/100) as influence from coaccess_v group by 1"), doubles="influence")
def mlp_influence(spark, d):
    return V.co_access(spark, d).groupBy("database_id").agg(F.count("*").alias("samples")).withColumn("influence", M.influence(F.col("samples")))


@query("concept_order", with_views("concepts_v", "select concept_id, cast(row_number() over (order by concept_id)-1 as int) as n from concepts_v"))
def concept_order(spark, d):
    return M.concept_index(V.concepts(spark, d))


@query("edge_insert_ignore", with_views("edges_v", """select source_chunk, target_chunk, relationship, weight from (select nullif(lower(trim(target_chunk,' '||chr(9))),'') as source_chunk, nullif(lower(trim(source_chunk,' '||chr(9))),'') as target_chunk, relationship, min(weight) as weight from connections where weight is not null and cast(weight as varchar)<>'nan' group by 1,2,3) n
 where source_chunk is not null and target_chunk is not null and relationship is not null and not exists (select 1 from edges_v e where e.source_chunk=n.source_chunk and e.target_chunk=n.target_chunk and e.relationship=n.relationship)"""))
def edge_insert_ignore(spark, d):
    """Every connection turned round, inserted where its triplet is new."""
    new = table(spark, d, "connections", "source_chunk", "target_chunk", "relationship", "weight").where("weight is not null and not isnan(weight) and relationship is not null")
    new = new.select(V.node_id("target_chunk").alias("source_chunk"), V.node_id("source_chunk").alias("target_chunk"), "relationship", "weight").where("source_chunk is not null and target_chunk is not null")
    return I.insert_or_ignore(new, V.edges(spark, d), ["source_chunk", "target_chunk", "relationship"]).select("source_chunk", "target_chunk", "relationship", "weight")


@query("db_cascade_delete", """select t, n from (select 'catalog' as t, count(*) as n from memory_databases where id<>'db_thesis' union all select 'chunks', count(*) from chunks where coalesce(database_id,'')<>'db_thesis'
 union all select 'connections', count(*) from connections where coalesce(database_id,'')<>'db_thesis' union all select 'concepts', count(*) from concepts where coalesce(database_id,'')<>'db_thesis'
 union all select 'ingest_events', count(*) from ingest_events where coalesce(database_id,'')<>'db_thesis' union all select 'co_access_events', count(*) from co_access_events)""")
def db_cascade_delete(spark, d):
    names = ("chunks", "connections", "concepts", "ingest_events", "co_access_events")
    catalog, tables = C.delete_database(table(spark, d, "memory_databases"), {n: table(spark, d, n, "database_id") for n in names}, "db_thesis")
    out = catalog.groupBy(F.lit("catalog").alias("t")).agg(F.count("*").alias("n"))
    for n, df in tables.items():
        out = out.unionByName(df.groupBy(F.lit(n).alias("t")).agg(F.count("*").alias("n")))
    return out


@query("db_backfill", "select database_id, count(*) as n from (select coalesce(nullif(database_id,''),'default') as database_id from connections) group by 1")
def db_backfill(spark, d):
    return C.backfill(table(spark, d, "connections", "database_id")).groupBy("database_id").agg(F.count("*").alias("n"))


@query("database_create", "select id, name from memory_databases union all select 'db_field notes', 'field notes'")
def database_create(spark, d):
    return C.create_database(table(spark, d, "memory_databases"), " field notes ", _now()).select("id", "name")


@query("ingest_counters", with_views("ingest_v", "select database_id, cast(sum(chunks_stored) as bigint) as stored, cast(sum(chunks_skipped) as bigint) as skipped, cast(sum(connections_seeded) as bigint) as seeded, count(*) as events from ingest_v group by 1"))
def ingest_counters(spark, d):
    e = V.ingest_events(spark, d)
    return e.groupBy("database_id").agg(F.sum("chunks_stored").alias("stored"), F.sum("chunks_skipped").alias("skipped"), F.sum("connections_seeded").alias("seeded"), F.count("*").alias("events"))


@query("rolling_rate", with_views("ingest_v", """select event_id, (n-1)/nullif(span,0) as rate from (select event_id, count(*) over w as n, epoch(ts)-epoch(min(ts) over w) as span from ingest_v where ts is not null window w as (partition by database_id order by ts, event_id rows between 9 preceding and current row))"""), doubles="rate")
def rolling_rate(spark, d):
    """Completions a second over the last ten of each database."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("database_id").orderBy("timestamp", "event_id").rowsBetween(-9, 0)
    span = F.col("timestamp").cast("double") - F.min("timestamp").over(w).cast("double")
    return V.ingest_events(spark, d).where("timestamp is not null").select("event_id", ((F.count("*").over(w) - 1) / F.nullif(span, F.lit(0.0))).alias("rate"))


@query("last_runs", with_views("ingest_v", "select database_id, event_id from (select database_id, event_id, row_number() over (partition by database_id order by ts desc nulls last, event_id) as n from ingest_v) where n<=10"))
def last_runs(spark, d):
    """Of each database the ten last events stay."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("database_id").orderBy(F.desc_nulls_last("timestamp"), "event_id")
    return V.ingest_events(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 10").select("database_id", "event_id")
