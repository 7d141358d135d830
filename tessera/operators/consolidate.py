"""Consolidation: typing, reinforcement, decay, co-access, conflicts. Each step maps a state to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import CONFIG, SUPPORTING
from tessera.functions import weights as W
from tessera.functions.vectors import cosine
from tessera.operators.skew import hot_keys, lookup
from tessera.plans.durable import durable

#: Parts that a member many hold is dealt to.
_PARTS = 64


def reweighted(edges: DataFrame, as_of: Column) -> DataFrame:
    """Edges with `weight` and `evidence_score` computed anew from their type, counters, similarity and last sight."""
    args = [F.col(c) for c in ("relationship", "support_count", "contradict_count", "avg_sim")]
    return edges.withColumns({"weight": W.computed_weight(*args, F.col("last_seen"), as_of), "evidence_score": W.evidence_score(*args)})


def classified(edges: DataFrame, label: Column, as_of: Column, learning: bool = True) -> DataFrame:
    """Untyped edges with a label: counters, confidence, weight and version follow; a null label (a classifier's error) is related_to.

    The edge is seen now, so its recency is 1. Without learning the weight is the base
    weight, the confidence a half and the evidence 0.
    """
    rel = F.coalesce(label, F.lit("related_to"))
    support = F.col("support_count") + F.when(rel.isin(*SUPPORTING), 1).otherwise(0)
    contra = F.col("contradict_count") + F.when(rel == "contradicts", 1).otherwise(0)
    seen = F.coalesce("seen_count", F.lit(0)) + 1
    if learning:
        weight = W.computed_weight(rel, support, contra, F.col("avg_sim"), as_of, as_of)
        confidence, evidence = W.edge_confidence(support, contra), W.evidence_score(rel, support, contra, F.col("avg_sim"))
    else:
        weight, confidence, evidence = W.base_weight(rel), F.lit(0.5), F.lit(0.0)
    return edges.where("relationship = 'related_to'").withColumns(
        {"relationship": rel, "support_count": support, "contradict_count": contra, "seen_count": seen, "weight": weight, "confidence": confidence, "evidence_score": evidence, "last_seen": as_of, "last_reinforced": as_of, "weight_version": F.coalesce("weight_version", F.lit(1)) + 1}
    )


def with_texts(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges with the texts of both ends (source_text, target_text); edges with an end that has none are skipped. chunks: node, text."""
    c = chunks.select(F.col("node").alias("k"), "text").where("text is not null")
    return lookup(lookup(edges, "source_chunk", c.withColumnRenamed("text", "source_text"), "k"), "target_chunk", c.withColumnRenamed("text", "target_text"), "k")


def flagged(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks with contradiction_flag set where a contradiction has them at an end; set flags stay. chunks: node, .."""
    bad = edges.where("relationship = 'contradicts'")
    ends = bad.select(F.col("source_chunk").alias("k")).union(bad.select(F.col("target_chunk").alias("k"))).distinct().withColumn("hit", F.lit(1))
    out = chunks.join(ends, F.col("node") == F.col("k"), "left")
    return out.withColumn("contradiction_flag", F.greatest(F.coalesce("contradiction_flag", F.lit(0)), F.coalesce("hit", F.lit(0)))).drop("k", "hit")


def reinforced(edges: DataFrame, chunks: DataFrame, learning: bool = True, above: int = CONFIG.hot_access) -> DataFrame:
    """(edge_id, weight) of the edges that leave chunks accessed more than `above` times. chunks: node, access_count."""
    hot = chunks.where(F.col("access_count") > above).select(F.col("node").alias("k"), F.col("access_count").alias("hot_access"))
    joined = lookup(edges.select("edge_id", "source_chunk", "weight", "confidence", "avg_sim"), "source_chunk", hot, "k")
    new = W.reinforced(F.col("weight"), F.col("hot_access"), F.coalesce("confidence", F.lit(0.5)), F.coalesce("avg_sim", F.lit(0.0))) if learning else F.least(F.lit(1.0), F.col("weight") + 0.05)
    return joined.select("edge_id", new.alias("weight"))


def decayed(edges: DataFrame, as_of: Column) -> DataFrame:
    """(edge_id, weight) of all edges after one step of decay."""
    last = F.coalesce("last_reinforced", "created_at")
    return edges.select("edge_id", W.decayed(F.col("weight"), F.coalesce("access_count", F.lit(0)), last, as_of).alias("weight"))


def co_access_pairs(events: DataFrame) -> DataFrame:
    """(a, b, times): how often two chunks were accessed together, a < b. events: ids (distinct).

    Pairs are made within one event, whose ids are those of one query's results and so few.
    """
    pairs = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice(F.col("ids"), i + 2, F.size("ids")), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))
    return events.where(F.size("ids") > 1).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("times"))


def hebbian_updates(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, weight, times): edges between chunks accessed together, strengthened `times` times.

    Of several edges between two chunks, whatever their type, the one from the lesser to the
    greater id is taken, then that of least id.
    """
    keyed = edges.select(F.least("source_chunk", "target_chunk").alias("a"), F.greatest("source_chunk", "target_chunk").alias("b"), F.struct((F.col("source_chunk") > F.col("target_chunk")).alias("back"), "edge_id", "weight").alias("e"))
    one = keyed.groupBy("a", "b").agg(F.min("e").alias("e"))
    return pairs.join(one, ["a", "b"]).select("e.edge_id", W.hebbian(F.col("e.weight"), F.col("times")).alias("weight"), "times")


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, sim): the cosine of the vectors of pairs (a, b); a pair with an end without a vector has no row. vectors: id, v."""
    v = vectors.select(F.col("id").alias("k"), "v").where("v is not null")
    both = lookup(lookup(pairs, "a", v.withColumnRenamed("v", "va"), "k"), "b", v.withColumnRenamed("v", "vb"), "k")
    return both.select("a", "b", cosine(F.col("va"), F.col("vb")).alias("sim"))


def hebbian_new(pairs: DataFrame, edges: DataFrame, similarity: DataFrame | None = None, least: float = CONFIG.hebbian_cosine) -> DataFrame:
    """(a, b, relationship, weight, times): edges of type co_accessed for pairs without any edge.

    similarity: a, b, sim; given, only pairs over `least` get an edge.
    """
    known = edges.select(F.least("source_chunk", "target_chunk").alias("a"), F.greatest("source_chunk", "target_chunk").alias("b")).distinct()
    new = pairs.join(known, ["a", "b"], "left_anti")
    if similarity is not None:
        new = new.join(similarity.where(F.col("sim") > least).select("a", "b", "sim"), ["a", "b"])
    return new.select("a", "b", F.lit("co_accessed").alias("relationship"), W.hebbian_new(F.col("times")).alias("weight"), "times", *(["sim"] if similarity is not None else []))


def access_bump(chunks: DataFrame, events: DataFrame) -> DataFrame:
    """(chunk_id, access_count, times): access counts after the events. chunks: chunk_id, node, access_count; events: ids."""
    times = events.select(F.explode("ids").alias("k")).groupBy("k").agg(F.count("*").alias("times"))
    joined = chunks.select("chunk_id", "node", "access_count").join(times, F.col("node") == F.col("k"))
    return joined.select("chunk_id", (F.coalesce("access_count", F.lit(0)) + F.col("times")).alias("access_count"), "times")


def co_access_log(results: DataFrame, as_of_ms: Column) -> DataFrame:
    """Log rows of queries: results (q, query_text, id, rank) to one event each with its distinct ids in rank order, the query's SHA-256 and the time."""
    ids = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id")))), lambda x: x["id"]))
    one = results.groupBy("q", "query_text").agg(ids.alias("ids"))
    return one.select(F.sha2(F.concat_ws("\x1f", F.col("q").cast("string"), as_of_ms.cast("string")), 256).alias("event_id"), F.sha2(F.coalesce("query_text", F.lit("")), 256).alias("query_hash"), "ids", as_of_ms.alias("timestamp"))


def apply_weights(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the weights of `new` (edge_id, weight) where it has them."""
    n = new.select(F.col("edge_id").alias("k"), F.col("weight").alias("new_weight"))
    return edges.join(n, F.col("edge_id") == F.col("k"), "left").withColumn("weight", F.coalesce("new_weight", "weight")).drop("k", "new_weight")


def member_overlaps(x: DataFrame, y: DataFrame) -> DataFrame:
    """(x, y, overlap, jaccard) of all pairs that share a member. x: x, members. y: y, members.

    Overlaps are counted over shared members, so pairs without one are never made. A member that
    many hold on either side is split: one side's rows of it are dealt to parts and the other side's go to each.
    """
    a = x.select("x", F.size("members").alias("na"), F.explode(F.array_distinct("members")).alias("m"))
    b = y.select("y", F.size("members").alias("nb"), F.explode(F.array_distinct("members")).alias("m"))
    hot = hot_keys(a, "m")
    parts = F.when(F.col("m").isin(hot), F.lit(_PARTS)).otherwise(F.lit(1)) if hot else F.lit(1)
    a = a.withColumn("part", F.pmod(F.xxhash64("x"), parts).cast("int"))
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    both = a.join(b, ["m", "part"]).groupBy("x", "y").agg(F.count("*").alias("overlap"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return both.select("x", "y", "overlap", (F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).alias("jaccard"))


def overlaps(clusters: DataFrame, concepts: DataFrame) -> DataFrame:
    """(cluster, concept_id, overlap, jaccard) of every cluster (cluster, members) with every concept (concept_id, members) that shares a member."""
    found = member_overlaps(clusters.select(F.col("cluster").alias("x"), "members"), concepts.select(F.col("concept_id").alias("y"), "members"))
    return found.withColumnsRenamed({"x": "cluster", "y": "concept_id"})


def best_jaccard(clusters: DataFrame, concepts: DataFrame) -> DataFrame:
    """(cluster, concept_id, overlap, jaccard): of each cluster (cluster, members) the concept (concept_id, members) of greatest Jaccard, ties by id."""
    w = Window.partitionBy("cluster").orderBy(F.desc("jaccard"), "concept_id")
    return overlaps(clusters, concepts).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def matched_once(scored: DataFrame) -> DataFrame:
    """(cluster, concept_id, jaccard): in the order of clusters each takes its best concept that none before it has taken, ties by id. scored: all overlaps.

    Every cluster asks for its best concept; a concept keeps the first of those that ask and the pairs of the others
    go; this is repeated until all that ask are kept. What comes out is the match in the order of clusters, and nothing is collected.
    """
    left = durable(scored.select("cluster", "concept_id", "jaccard"))
    while True:
        asks = left.groupBy("cluster").agg(F.min(F.struct((-F.col("jaccard")).alias("o"), "concept_id")).alias("b")).select("cluster", F.col("b.concept_id").alias("concept_id"), (-F.col("b.o")).alias("jaccard"))
        asks = durable(asks)
        first = asks.groupBy(F.col("concept_id").alias("k")).agg(F.min("cluster").alias("holder"))
        refused = asks.join(first, F.col("concept_id") == F.col("k")).where("cluster <> holder").select("cluster", "concept_id")
        if refused.isEmpty():
            return asks
        left = durable(left.join(refused, ["cluster", "concept_id"], "left_anti"))


def merge_candidates(concepts: DataFrame, jaccard: float = CONFIG.merge_jaccard) -> DataFrame:
    """(a, b, jaccard): pairs of concepts, a < b, of one database whose members overlap enough. concepts: concept_id, database_id, members."""
    x = concepts.select(F.struct("database_id", "concept_id").alias("x"), "members")
    found = member_overlaps(x, x.withColumnRenamed("x", "y")).where("x.database_id = y.database_id and x.concept_id < y.concept_id")
    return found.select(F.col("x.concept_id").alias("a"), F.col("y.concept_id").alias("b"), "jaccard").where(F.col("jaccard") >= jaccard)


def merge_pairs(candidates: DataFrame) -> DataFrame:
    """(gone, into): which concept takes which when candidate pairs (a, b) are folded in their order; a concept that is gone takes no part.

    A pair counts unless a pair before it has removed one of its ends. A concept is only removed by a lesser one, so a concept
    stays exactly if none that stays is paired with it from below; it goes into the least that does.
    """
    pairs = left = durable(candidates.select("a", "b").where("a < b").distinct())
    gone = left.select("b").where("false")
    while True:
        # those that nothing undecided threatens stay, and remove what they are paired with
        staying = durable(left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti"))
        now = durable(left.join(staying, "a", "left_semi").select("b").distinct())
        if now.isEmpty():
            break
        gone = durable(gone.unionByName(now))
        for end, out in (("a", staying.withColumnRenamed("a", "k")), ("b", now.withColumnRenamed("b", "k")), ("a", now.withColumnRenamed("b", "k"))):
            left = left.join(out, F.col(end) == F.col("k"), "left_anti")
        left = durable(left)
    by = pairs.join(gone, "b", "left_semi").join(gone.withColumnRenamed("b", "a"), "a", "left_anti")
    return by.groupBy(F.col("b").alias("gone")).agg(F.min("a").alias("into"))


def merged(concepts: DataFrame, into: DataFrame, as_of: Column) -> DataFrame:
    """Concepts with the members of those that go into them, their version the greatest of all plus one; the others are as they were. into: gone, into."""
    gone = into.select(F.col("gone").alias("k"), "into")
    named = concepts.select("concept_id", "members", "version").join(gone, F.col("concept_id") == F.col("k"), "left")
    grouped = named.select(F.coalesce("into", "concept_id").alias("k"), "members", "version", F.col("into").isNotNull().alias("taken"))
    new = grouped.where("taken").select("k").distinct().join(grouped.drop("taken"), "k")
    new = new.groupBy("k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("new_members"), (F.max("version") + 1).alias("new_version"))
    kept = concepts.join(gone.select("k"), F.col("concept_id") == F.col("k"), "left_anti").join(new, F.col("concept_id") == F.col("k"), "left")
    return kept.withColumns({"members": F.coalesce("new_members", "members"), "version": F.coalesce("new_version", "version").cast("int"), "last_updated": F.when(F.col("new_version").isNotNull(), as_of).otherwise(F.col("last_updated"))}).select(*concepts.columns)
