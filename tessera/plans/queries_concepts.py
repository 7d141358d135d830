"""Queries over samples, validation and merging of concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import concepts as P
from tessera.plans.registry import query
from tessera.plans.sql import with_views
from tessera.sources import graphs as G
from tessera.sources import views as V

_SAMPLE = ", sample as (select vec_id, row_number() over (order by md5(cast(vec_id as varchar)), vec_id) as r from vectors_v qualify r<=50)"
_OTHERS = _SAMPLE + ", others as (select concept_id, vec_id from (select c.concept_id, s.vec_id, row_number() over (partition by c.concept_id order by s.r) as n from vconcepts_v c, sample s where not list_contains(c.members, s.vec_id)) where n<=3)"


def _concepts(spark, d):  # noqa: ANN001, ANN202
    return G.vector_concepts(spark, d)


def _rows(spark, d):  # noqa: ANN001, ANN202
    return V.vectors(spark, d).withColumnRenamed("vec_id", "id")


@query("random_sample", with_views("vectors_v", _SAMPLE + " select vec_id as id from sample"))
def random_sample(spark, d):
    return P.sample_rows(_rows(spark, d).select("id"), "id")


@query("non_member_sample", with_views("vectors_v vconcepts_v", _OTHERS + " select cast(concept_id as int) as cluster, list_sort(list(vec_id)) as others from others group by 1"))
def non_member_sample(spark, d):
    c = _concepts(spark, d).withColumnRenamed("concept_id", "cluster")
    return P.non_members(c, _rows(spark, d), "id").select("cluster", F.array_sort("others").alias("others"))


@query("concept_validation", with_views("vectors_v vconcepts_v", _OTHERS + """, cents as (select label as concept_id, list(m order by pos) as v from (select label, pos, avg(v[pos]) as m from vectors_v, range(1,65) t(pos) group by 1,2) group by 1),
 ins as (select concept_id, unnest(members[1:3]) as vec_id from vconcepts_v),
 a as (select concept_id, avg(list_cosine_similarity(c.v,x.v)) as s from ins join cents c using (concept_id) join vectors_v x using (vec_id) group by 1),
 b as (select concept_id, avg(list_cosine_similarity(c.v,x.v)) as s from others join cents c using (concept_id) join vectors_v x using (vec_id) group by 1)
 select cast(concept_id as int) as cluster, coalesce(greatest(0.0,least(1.0,a.s-b.s)),0.5) as score from a join b using (concept_id)"""), doubles="score")
def concept_validation(spark, d):
    return P.validation(_concepts(spark, d).withColumnRenamed("concept_id", "cluster"), _rows(spark, d), "id")


@query("concepts_alike", with_views("vectors_v vconcepts_v", """, cents as (select label as concept_id, list(m order by pos) as v from (select label, pos, avg(v[pos]) as m from vectors_v, range(1,65) t(pos) group by 1,2) group by 1),
 twice as (select cast(concept_id as varchar) as id, members, v from vconcepts_v join cents using (concept_id) union all select cast(concept_id as varchar)||'b', members[1:cast(floor(len(members)*0.8) as bigint)], v from vconcepts_v join cents using (concept_id))
 select a, b, jaccard, sim from (select x.id as a, y.id as b, len(list_intersect(x.members,y.members))*1.0/len(list_distinct(list_concat(x.members,y.members))) as jaccard, list_cosine_similarity(x.v,y.v) as sim from twice x, twice y where x.id<y.id) where jaccard>=0.7 and sim>=0.85"""), doubles="jaccard sim")
def concepts_alike(spark, d):
    """The concepts of the labels beside copies of them with four fifths of their members."""
    c = _concepts(spark, d).select(F.col("concept_id").cast("string").alias("concept_id"), F.lit("default").alias("database_id"), "members", "v")
    less = c.withColumns({"concept_id": F.concat("concept_id", F.lit("b")), "members": F.slice("members", F.lit(1), F.floor(F.size("members") * 0.8).cast("int"))})
    return P.alike(c.unionByName(less))
