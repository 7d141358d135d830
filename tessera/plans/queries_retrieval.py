"""Queries over vectors and the graph: seeds, expansion, fusion, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import BENCHMARK_QUERIES
from tessera.operators import expand as X
from tessera.operators import fusion as S
from tessera.operators import knn as K
from tessera.operators import retrieve as R
from tessera.plans.registry import query
from tessera.plans.sql import walks, with_views
from tessera.sources import graphs as G
from tessera.sources import views as V

_CENTROIDS = """select label as concept_id, list(m order by pos) as v, any_value(0.3+0.05*label) as confidence from
 (select label, pos, avg(v[pos]) as m from vectors_v, range(1,65) t(pos) group by label,pos) group by label"""
_HITS = f""", cents as ({_CENTROIDS}), hits as (select q, concept_id, sim, rank, confidence from (select q.vec_id as q, concept_id, c.confidence, list_cosine_similarity(q.v,c.v) as sim,
 row_number() over (partition by q.vec_id order by list_cosine_similarity(q.v,c.v) desc, concept_id) as rank from vectors_v q, cents c where q.vec_id%20=0 and list_cosine_similarity(q.v,c.v)>=0.2) where rank<=3)
"""


def _rows(spark, d):  # noqa: ANN001, ANN202
    return V.vectors(spark, d).withColumnRenamed("vec_id", "id")


def _seeds(spark, d):  # noqa: ANN001, ANN202
    return K.knn(G.queries(spark, d), _rows(spark, d), 10, "database_id").select("q", "id", F.col("sim").alias("score"))


def _hits(spark, d):  # noqa: ANN001, ANN202
    return R.concept_hits(G.queries(spark, d), G.vector_concepts(spark, d), least=0.2)


@query("knn_topk", with_views("vectors_v", """select q, id, sim, cast(rank as int) as rank from (select q.vec_id as q, c.vec_id as id, list_cosine_similarity(q.v,c.v) as sim,
 row_number() over (partition by q.vec_id order by list_cosine_similarity(q.v,c.v) desc, c.vec_id) as rank from vectors_v q, vectors_v c where q.vec_id%20=0) where rank<=10"""), doubles="sim")
def knn_topk(spark, d):
    return K.knn(G.queries(spark, d), _rows(spark, d), 10)


@query("knn_topk_filtered", with_views("seeds_v", "select q, id, score as sim, cast(rk as int) as rank from seeds_v"), doubles="sim")
def knn_topk_filtered(spark, d):
    return K.knn(G.queries(spark, d), _rows(spark, d), 10, "database_id")


@query("knn_batch_seed", with_views("knn_v", "select vec_id as source, target_id as target, 'related_to' as relationship, 0.3 as weight, 0.5 as confidence, sim as avg_sim, 1 as seen_count from knn_v"), doubles="weight confidence avg_sim")
def knn_batch_seed(spark, d):
    from tessera.operators.ingest import seed_edges

    return seed_edges(K.knn(G.queries(spark, d), _rows(spark, d), 6, drop_self=True))


@query("ingest_deferred", with_views("seeds_v", "select q as source, id as target, 'related_to' as relationship, 0.3 as weight, 0.5 as confidence, score as avg_sim, 1 as seen_count from seeds_v where rk<=6 and q<>id"), doubles="weight confidence avg_sim")
def ingest_deferred(spark, d):
    """Edges of the query vectors seeded after all are stored: each meets itself first."""
    from tessera.operators.ingest import deferred_edges

    rows = _rows(spark, d).select("id", "v", "database_id")
    return deferred_edges(G.queries(spark, d).select(F.col("q").alias("id"), "v", "database_id"), rows)


_BATCH = """, near as (select q.vec_id as q, c.vec_id as c, list_cosine_similarity(q.v,c.v) as sim, row_number() over (partition by q.vec_id order by list_cosine_similarity(q.v,c.v) desc, c.vec_id) as rk
 from vectors_v q join vectors_v c on q.database_id=c.database_id where q.vec_id%20=0 and c.vec_id%20<>0), dup as (select q from near where rk=1 and sim>=0.4)"""


@query("ingest_kept", with_views("vectors_v", _BATCH + " select vec_id as id from vectors_v where vec_id%20=0 and vec_id not in (select q from dup)"))
def ingest_kept(spark, d):
    """The query vectors as a batch against all others: what is left without duplicates of stored rows."""
    return _batch(spark, d)[0].select("id")


@query("ingest_seeds", with_views("vectors_v", _BATCH + " select q as source, c as target, 'related_to' as relationship, 0.3 as weight, 0.5 as confidence, sim as avg_sim, 1 as seen_count from near where rk<=6 and q not in (select q from dup)"), doubles="weight confidence avg_sim")
def ingest_seeds(spark, d):
    return _batch(spark, d)[1]


def _batch(spark, d):  # noqa: ANN001, ANN202
    from tessera.operators.ingest import ingest_batch

    new = G.queries(spark, d).select(F.col("q").alias("id"), "v", "database_id")
    stored = _rows(spark, d).where("id % 20 <> 0").select("id", "v", "database_id")
    return ingest_batch(new, stored, threshold=0.4)


@query("benchmark_queries", "select * from (values " + ", ".join("(%d, '%s')" % (i, q.replace("'", "''")) for i, q in enumerate(BENCHMARK_QUERIES)) + ") t(q, query)")
def benchmark_queries(spark, d):
    return spark.createDataFrame(list(enumerate(BENCHMARK_QUERIES)), "q int, query string")


@query("duplicate_check", with_views("knn_v", "select vec_id as q, target_id as id, sim from knn_v where rk=1 and sim>=0.4"), doubles="sim")
def duplicate_check(spark, d):
    return K.duplicates(G.queries(spark, d), _rows(spark, d), 0.4)


@query("hop1_expand", with_views("vedges_v seeds_v", "," + walks(1) + " select q, id, score, depth, path, vec from walks_v"), doubles="score vec")
def hop1_expand(spark, d):
    return X.expand(_seeds(spark, d), G.vector_edges(spark, d), 1)


@query("hop2_expand", with_views("vedges_v seeds_v", "," + walks(2) + " select q, id, score, depth, path, vec from walks_v"), doubles="score vec")
def hop2_expand(spark, d):
    return X.expand(_seeds(spark, d), G.vector_edges(spark, d), 2)


@query("hop2_filtered", with_views("vedges_v seeds_v", "," + walks(2, "e.relationship in ('supports','caused_by')") + " select q, id, score, depth, path, vec from walks_v"), doubles="score vec")
def hop2_filtered(spark, d):
    return X.expand(_seeds(spark, d), G.vector_edges(spark, d), 2, relationships=[" Supports", "caused_by", "nonsense"])


@query("candidate_hydrate", with_views("vedges_v seeds_v vchunks_v", "," + walks(1) + " select w.q, w.id, w.score, c.chunk_id, c.source, substr(c.text,1,220) as preview from walks_v w join vchunks_v c on c.vec_id=w.id"), doubles="score")
def candidate_hydrate(spark, d):
    from tessera.operators.skew import lookup

    pool = X.expand(_seeds(spark, d), G.vector_edges(spark, d), 1).select("q", "id", "score")
    c = G.vector_chunks(spark, d).select(F.col("vec_id").alias("k"), "chunk_id", "source", F.substring("text", 1, 220).alias("preview"))
    return lookup(pool, "id", c, "k")


_BAD = ", bad as (select source, target from vedges_v where relationship='contradicts' union select target, source from vedges_v where relationship='contradicts')"


@query("conflict_pairs", with_views("vedges_v seeds_v", "," + walks(1) + _BAD + " select a.q, a.id, list_sort(list(distinct b.id)) as conflicts from walks_v a join bad on bad.source=a.id join walks_v b on b.q=a.q and b.id=bad.target group by 1,2"))
def conflict_pairs(spark, d):
    e = G.vector_edges(spark, d)
    return X.conflicts(X.expand(_seeds(spark, d), e, 1), e)


@query("explain_edges", with_views("vedges_v seeds_v", "select s.q, e.source, e.target, e.relationship, e.w from seeds_v s join vedges_v e on e.source=s.id join seeds_v t on t.q=s.q and t.id=e.target"), doubles="w")
def explain_edges(spark, d):
    return X.inner_edges(_seeds(spark, d), G.vector_edges(spark, d))


@query("concept_search", with_views("vectors_v", _HITS + "select q, concept_id, sim, cast(rank as int) as rank from hits"), doubles="sim")
def concept_search(spark, d):
    return _hits(spark, d)


_LAYER = ", layer as (select h.q, u.id, h.sim+h.sim*(0.5+0.5*h.confidence)*0.08 as score, 'concept' as layer, h.concept_id from hits h join vconcepts_v c using (concept_id), unnest(c.members) u(id))"


@query("concept_expand", with_views("vectors_v vconcepts_v", _HITS + _LAYER + " select q, id, score, layer, cast(concept_id as int) as concept_id from layer"), doubles="score")
def concept_expand(spark, d):
    return R.concept_layer(_hits(spark, d), G.vector_concepts(spark, d))


@query("concept_boost", with_views("vectors_v vconcepts_v seeds_v", _HITS + """, weak as (select q, min(score) as base from seeds_v group by q)
 select q, id, score, cast(concept_id as int) as concept_id from (select h.q, u.id, coalesce(w.base,0.5)+h.sim*(0.5+0.5*h.confidence)*0.08 as score, h.concept_id,
 row_number() over (partition by h.q,u.id order by h.rank,h.concept_id) as n from hits h join vconcepts_v c using (concept_id) left join weak w on w.q=h.q, unnest(c.members) u(id)
 where not exists (select 1 from seeds_v s where s.q=h.q and s.id=u.id)) where n=1"""), doubles="score")
def concept_boost(spark, d):
    return R.boosted_members(_seeds(spark, d), _hits(spark, d), G.vector_concepts(spark, d))


_MERGED = ", merged as (select q, id, score, layer from (select *, row_number() over (partition by q,id order by score desc, n) as r from (select q, id, score, 'vector' as layer, 0 as n from seeds_v union all select q,id,score,layer,1 from layer)) where r=1)"


@query("merge_layers", with_views("vectors_v vconcepts_v seeds_v", _HITS + _LAYER + _MERGED + " select * from merged"), doubles="score")
def merge_layers(spark, d):
    return S.merge_layers(_seeds(spark, d).withColumn("layer", F.lit("vector")), R.concept_layer(_hits(spark, d), G.vector_concepts(spark, d)))


@query("rank_layers", with_views("vectors_v vconcepts_v seeds_v", _HITS + _LAYER + _MERGED + """ select q, id, s as score, layer, cast(row_number() over (partition by q order by s desc, id) as int) as rank
 from (select *, score+case when layer='concept' then 0.08 else 0 end as s from merged)"""), doubles="score")
def rank_layers(spark, d):
    return S.ranked(merge_layers(spark, d))


_FUSED = ", fused as (select q, id, depth, 0.6*vec+0.25*case when depth>0 then score else 0 end as score from walks_v)"
_POWER = ", power as (select q, id, depth, case when top<=0 then score else top*pow(greatest(score,0)/top,2.5) end as score from (select *, max(score) over (partition by q) as top from fused))"


@query("fuse_scores", with_views("vedges_v seeds_v", "," + walks(2) + _FUSED + " select q, id, score from fused"), doubles="score")
def fuse_scores(spark, d):
    w = X.expand(_seeds(spark, d), G.vector_edges(spark, d), 2)
    return w.select("q", "id", S.fused(F.col("vec"), F.when(F.col("depth") > 0, F.col("score"))).alias("score"))


@query("power_rescore", with_views("vedges_v seeds_v", "," + walks(2) + _FUSED + _POWER + " select q, id, score from power"), doubles="score")
def power_rescore(spark, d):
    return S.rescored(fuse_scores(spark, d))


@query("blend_rerank", with_views("seeds_v", "select q, id, case when id%3=0 then score else 0.6*score+0.4*(id%10)/10.0 end as score from seeds_v"), doubles="score")
def blend_rerank(spark, d):
    # a stand-in for a re-ranker's scores: two rows of three have one
    s = _seeds(spark, d).withColumn("rerank_score", F.when(F.col("id") % 3 != 0, (F.col("id") % 10) / 10.0))
    return S.blended(s).select("q", "id", "score")


@query("final_filter_topk", with_views("vedges_v seeds_v", "," + walks(2) + _FUSED + _POWER + """ select q, id, score, cast(rank as int) as rank from (select *, row_number() over (partition by q order by score desc, id) as rank, count(*) over (partition by q) as n from power)
 where rank<=20 and (score>=0.05 or n<=1) and rank<=5"""), doubles="score")
def final_filter_topk(spark, d):
    return S.top_k(power_rescore(spark, d), 5, 0.05, 20)


@query("hybrid_retrieve", with_views("vedges_v seeds_v", "," + walks(2) + _FUSED + _POWER + _BAD + """, conf as (select a.q, a.id, list_sort(list(distinct b.id)) as conflicts from walks_v a join bad on bad.source=a.id join walks_v b on b.q=a.q and b.id=bad.target group by 1,2),
 ranked as (select *, row_number() over (partition by q order by score desc, id) as rank, count(*) over (partition by q) as n from power)
 select r.q, r.id, r.score, cast(r.rank as int) as rank, case when depth>0 then 'graph' else 'vector' end as layer, depth, coalesce(c.conflicts, []) as conflicts from ranked r left join conf c on c.q=r.q and c.id=r.id
 where rank<=20 and (score>=0.05 or n<=1) and rank<=10"""), doubles="score")
def hybrid_retrieve(spark, d):
    """The flagship: query vectors to ranked results in one plan. The floor suits these vectors, whose nearest cosines are under 0.6."""
    return R.hybrid(G.queries(spark, d), _rows(spark, d), G.vector_edges(spark, d), top=10, least=0.05)


ANN_CELLS, ANN_PROBES = 256, 96


@query("ann_topk", doubles="sim")
def ann_topk(spark, d):
    """Approximate neighbours by small cells, three eighths of which are looked into; the recall of these settings is measured in the tests.

    These vectors are close to random, which is the hardest case for cells.
    """
    rows = _rows(spark, d)
    index = K.CellIndex.fit(rows, cells=ANN_CELLS)
    return index.search(G.queries(spark, d), index.assign(rows), 10, probes=ANN_PROBES)


@query("score_distribution", with_views("seeds_v", "select q, min(score) as least, list_sort(list(score))[cast(floor(count(*)/2) as bigint)+1] as median, avg(score) as mean, max(score) as most from seeds_v group by q"), doubles="least median mean most")
def score_distribution(spark, d):
    return _seeds(spark, d).groupBy("q").agg(F.min("score").alias("least"), S.upper_median(F.collect_list("score")).alias("median"), F.avg("score").alias("mean"), F.max("score").alias("most"))


@query("benchmark_overlap", with_views("seeds_v", "select a.q, count(b.id) as overlap from (select * from seeds_v where rk<=5) a left join (select * from seeds_v where rk between 3 and 7) b on a.q=b.q and a.id=b.id group by 1"))
def benchmark_overlap(spark, d):
    """The five best of one run against those of another (here ranks 3 to 7 stand for the other run)."""
    r = K.knn(G.queries(spark, d), _rows(spark, d), 10, "database_id")
    now = r.where("rank <= 5").groupBy("q").agg(F.collect_set("id").alias("a"))
    before = r.where("rank between 3 and 7").groupBy("q").agg(F.collect_set("id").alias("b"))
    return now.join(before, "q", "left").select("q", F.size(F.array_intersect("a", F.coalesce("b", F.array().cast("array<bigint>")))).cast("long").alias("overlap"))
