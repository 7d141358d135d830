"""Operators against brute force and on odd input: nulls, ties, empty tables, clashing columns."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.operators import consolidate as O
from tessera.operators import context as X
from tessera.operators import documents as D
from tessera.operators import fusion as S
from tessera.operators import ingest as I
from tessera.operators import knn as K
from tessera.operators import readouts as R
from tessera.operators.clusters import Leaders, centroids, leader_clusters
from tessera.operators.components import connected_components, splittable, strong_components
from tessera.operators.expand import conflicts, expand, inner_edges
from tessera.operators.prior import dense_index
from tessera.operators.skew import hot_keys, lookup
from tessera.plans.registry import query

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def vecs(spark, m, tags=None):
    rows = [(i, v.tolist(), (tags or {}).get(i, "a")) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id int, v array<double>, tag string")


def test_knn_is_exact(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 16))
    rows = vecs(spark, m).repartition(5)
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("q"), "v")
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = n @ n.T
    for block in (4, 4096):
        got = K.knn(queries, rows, 7, drop_self=True, block=block).orderBy("q", "rank").collect()
        for q in range(0, 300, 20):
            best = sorted((-sims[q, i], i) for i in range(300) if i != q)[:7]
            assert [r.id for r in got if r.q == q] == [i for _, i in best]


def test_knn_ties_nulls_and_sizes(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0])], "id int, v array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "q int, v array<double>")
    assert [(r.q, r.id) for r in K.knn(q, rows, 2).orderBy("rank").collect()] == [(9, 1), (9, 2)]
    assert K.knn(q.where("false"), rows, 2).count() == 0
    assert K.knn(q, rows.where("false"), 2).count() == 0


def test_index_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    m = base[rng.integers(0, 40, 2000)] + 0.4 * rng.normal(size=(2000, 24))
    rows = vecs(spark, m)
    q = rows.where("id % 20 = 0").select(F.col("id").alias("q"), "v")
    index = K.CellIndex.fit(rows, cells=32, sample=1000)
    assigned = index.assign(rows)
    assert assigned.count() == 2000
    exact = {(r.q, r.id) for r in K.knn(q, rows, 10).collect()}
    found = {(r.q, r.id) for r in index.search(q, assigned, 10, probes=10).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def walks_by_hand(seeds, edges, hops):
    best = {}
    level = {(q, i): (s, (str(i),), s) for q, i, s in seeds}
    for d in range(hops + 1):
        for k, (s, p, v) in level.items():
            if k not in best or s > best[k][0]:
                best[k] = (s, p, v, d)
        nxt = {}
        for (q, i), (s, p, v) in level.items():
            for a, b, _, w in edges:
                if a == i and w > 0.3:
                    t = s * 0.9 ** (d + 1) * w
                    if (q, b) not in nxt or t > nxt[q, b][0]:
                        nxt[q, b] = (t, (*p, str(b)), v)
        level = nxt
    return best


@SLOW
@given(st.integers(0, 10_000))
def test_expand_is_best_walk(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(8), rng.randrange(8), rng.choice(["supports", "contradicts"]), round(rng.random(), 3)) for _ in range(20)]
    seeds = [(1, rng.randrange(8), 0.9), (2, rng.randrange(8), 0.5)]
    got = expand(spark.createDataFrame(seeds, "q int, id int, score double"), spark.createDataFrame(edges, "source int, target int, relationship string, w double"), 2).collect()
    want = walks_by_hand(seeds, edges, 2)
    assert {(r.q, r.id) for r in got} == set(want)
    for r in got:
        assert r.score == pytest.approx(want[r.q, r.id][0]) and r.depth == want[r.q, r.id][3]


def test_expand_edges_of_three_tenths_and_filters(spark):
    e = spark.createDataFrame([(1, 2, "supports", 0.3), (1, 3, "caused_by", 0.31), (3, 3, "supports", 1.0), (3, 1, "supports", 1.0)], "source int, target int, relationship string, w double")
    s = spark.createDataFrame([(0, 1, 1.0)], "q int, id int, score double")
    assert {r.id for r in expand(s, e).collect()} == {1, 3}
    assert {r.id for r in expand(s, e, relationships=["bad", ""]).collect()} == {1, 3}
    assert {r.id for r in expand(s, e, relationships=["supports"]).collect()} == {1}
    assert expand(s.where("false"), e).count() == 0
    far = expand(spark.createDataFrame([("s", "seed", 1.0)], "q string, id string, score double"), spark.createDataFrame([("seed", "mid", "supports", 1.0), ("mid", "far", "supports", 1.0)], "source string, target string, relationship string, w double"))
    assert {r.id: len(r.path) for r in far.collect()}["far"] == 3


def test_conflicts_both_ways(spark):
    e = spark.createDataFrame([("a", "b", "contradicts", 0.5), ("a", "z", "contradicts", 0.5), ("b", "c", "supports", 0.5)], "source string, target string, relationship string, w double")
    p = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "q int, id string")
    assert {(r.q, r.id): r.conflicts for r in conflicts(p, e).collect()} == {(1, "a"): ["b"], (1, "b"): ["a"]}
    assert {(r.q, r.source, r.target) for r in inner_edges(p, e).collect()} == {(1, "a", "b"), (1, "b", "c")}


def test_rescore_and_cuts(spark):
    df = spark.createDataFrame([(1, 1, 0.8), (1, 2, 0.4), (1, 3, -0.2), (2, 1, -0.5), (3, 1, 0.1)], "q int, id int, score double")
    got = {(r.q, r.id): r.score for r in S.rescored(df).collect()}
    assert got[1, 1] == pytest.approx(0.8) and got[1, 2] == pytest.approx(0.8 * 0.5**2.5) and got[1, 3] == 0 and got[2, 1] == -0.5
    assert {(r.q, r.id) for r in S.top_k(df, 5, 0.35).collect()} == {(1, 1), (1, 2), (2, 1), (3, 1)}
    two = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2)], "q int, id int, score double")
    assert S.top_k(two, 5, 0.35).count() == 0
    merged = S.merge_layers(df.withColumn("layer", F.lit("vector")), df.withColumn("layer", F.lit("concept")))
    assert {r.layer for r in merged.collect()} == {"vector"}
    assert spark.range(1).select(S.upper_median(F.array(*map(F.lit, [4.0, 1.0, 3.0, 2.0]))).alias("m")).first().m == 3.0


def test_components_and_splits(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(pairs, "a int, b int")
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {(x, root(x)) for p in pairs for x in p}
    for bound in (10, 1_000_000):
        assert {(r.id, r.component) for r in connected_components(df, bound).collect()} == want
    assert connected_components(df.where("false")).count() == 0
    e = spark.createDataFrame([("a", "b", 0.6), ("b", "c", 0.6), ("x", "y", 0.9), ("a", "z", 0.59)], "source_chunk string, target_chunk string, weight double")
    assert {r.id for r in strong_components(e).collect()} == {"a", "b", "c"}
    e = spark.createDataFrame([(f"{p}{i}", f"{p}{i + 1}", 0.9) for p in "ab" for i in range(3)] + [("a0", "b0", 0.6)], "source_chunk string, target_chunk string, weight double")
    assert [(r.component, r.parts) for r in splittable(e).collect()] == [("a0", 2)]


def test_leaders(spark):
    v = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 0.9]]
    rows = spark.createDataFrame([("d", i, i, x) for i, x in enumerate(v)] + [("e", 9, 0, [1.0, 1.0])], "database_id string, id int, ts int, v array<double>")
    got = {(r.database_id, r.id): r.cluster for r in leader_clusters(rows).collect()}
    assert got == {("d", 0): 0, ("d", 1): 0, ("d", 2): 1, ("d", 3): 1, ("e", 9): 0}
    lead = Leaders(0.85)
    assert [lead.add(np.array(x)) for x in v] == [0, 0, 1, 1]
    mean = {r.k: r.v for r in centroids(rows.select(F.col("database_id").alias("k"), "v")).collect()}
    assert mean["d"] == pytest.approx([0.5, 0.5])


def test_co_access(spark):
    ev = spark.createDataFrame([(["b", "a", "c"],), (["a", "b"],), (["a"],), ([],)], "ids array<string>")
    pairs = O.co_access_pairs(ev)
    assert {(r.a, r.b): r.times for r in pairs.collect()} == {("a", "b"): 2, ("b", "c"): 1, ("a", "c"): 1}
    e = spark.createDataFrame([("e1", "b", "a", 0.4), ("e2", "a", "b", 0.5)], "edge_id string, source_chunk string, target_chunk string, weight double")
    up = O.hebbian_updates(pairs, e).collect()
    assert [(r.edge_id, r.times) for r in up] == [("e2", 2)] and up[0].weight == pytest.approx(1 - 0.5 * 0.95**2)
    new = {(r.a, r.b) for r in O.hebbian_new(pairs, e, spark.createDataFrame([("a", "c", 0.41), ("b", "c", 0.4)], "a string, b string, sim double")).collect()}
    assert new == {("a", "c")}


def test_concept_matching(spark):
    cl = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "d"]), (3, ["q"])], "cluster int, members array<string>")
    co = spark.createDataFrame([("x", ["a", "b", "c"]), ("y", ["d"])], "concept_id string, members array<string>")
    best = {r.cluster: (r.concept_id, r.jaccard) for r in O.best_jaccard(cl, co).collect()}
    assert best[1] == ("x", 1.0) and best[2] == ("x", 0.5) and 3 not in best
    # a cluster whose best is taken takes its next best
    assert {(r.cluster, r.concept_id) for r in O.matched_once(O.overlaps(cl, co)).collect()} == {(1, "x"), (2, "y")}
    concepts = spark.createDataFrame([("a", ["1", "2"], 1), ("b", ["2", "3"], 4), ("c", ["9"], 1)], "concept_id string, members array<string>, version int").withColumn("last_updated", F.lit(None).cast("timestamp"))
    into = O.merge_pairs(spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string"))
    left = {r.concept_id: (r.members, r.version, r.last_updated is None) for r in O.merged(concepts, into, F.current_timestamp()).collect()}
    assert left == {"a": (["1", "2", "3"], 5, False), "c": (["9"], 1, True)}


def test_matching_and_merging_are_those_of_a_fold(spark):
    rng = random.Random(11)
    scored = [(c, f"k{k:02d}", rng.choice([0.1, 0.25, 0.5, 1.0])) for c in range(15) for k in rng.sample(range(12), 4)]
    used, want = set(), {}
    for c in range(15):
        for _, k in sorted((-j, k) for x, k, j in scored if x == c and k not in used)[:1]:
            want[c] = k
            used.add(k)
    df = spark.createDataFrame(scored, "cluster int, concept_id string, jaccard double")
    assert {r.cluster: r.concept_id for r in O.matched_once(df).collect()} == want
    assert O.matched_once(df.where("false")).count() == 0
    pairs = sorted({tuple(sorted(rng.sample(range(20), 2))) for _ in range(30)})
    gone = {}
    for a, b in pairs:
        if a not in gone and b not in gone:
            gone[b] = a
    got = O.merge_pairs(spark.createDataFrame(pairs, "a int, b int"))
    assert {r.gone: r.into for r in got.collect()} == gone


def test_a_member_that_many_hold_is_split(spark, monkeypatch):
    monkeypatch.setattr(O, "hot_keys", lambda df, key: ["h"])
    cl = spark.createDataFrame([(i, ["h", f"m{i}", "h"]) for i in range(20)], "cluster int, members array<string>")
    co = spark.createDataFrame([(f"c{i}", ["h", f"m{i}"]) for i in range(5)], "concept_id string, members array<string>")
    got = {(r.cluster, r.concept_id): (r.overlap, r.jaccard) for r in O.overlaps(cl, co).collect()}
    assert len(got) == 100 and got[1, "c1"] == (2, 2 / 3) and got[1, "c2"] == (1, 0.25)


def test_insert_ignore_and_ingest_toggles(spark):
    new = spark.createDataFrame([("a", "b", 1.0), ("a", "b", 2.0), ("c", "d", 1.0)], "s string, t string, w double")
    old = spark.createDataFrame([("c", "d")], "s string, t string")
    assert [(r.s, r.w) for r in I.insert_or_ignore(new, old, ["s", "t"]).collect()] == [("a", 1.0)]
    rows = spark.createDataFrame([("x", [1.0, 0.0], "d"), ("y", [0.0, 1.0], "d")], "id string, v array<double>, database_id string")
    batch = spark.createDataFrame([("n", [1.0, 0.0], "d"), ("m", [1.0, 1.0], "d"), ("m2", [1.0, 1.0], "d")], "id string, v array<double>, database_id string")
    kept, seeds = I.ingest_batch(batch, rows)
    assert {r.id for r in kept.collect()} == {"m", "m2"}
    assert {(r.source, r.target) for r in seeds.collect()} == {(a, b) for a in ("m", "m2") for b in ("x", "y")}
    kept, seeds = I.ingest_batch(batch, rows, check_duplicates=False, defer=True)
    assert kept.count() == 3 and seeds.count() == 0
    stored = rows.unionByName(batch)
    assert all(r.source != r.target for r in I.deferred_edges(batch, stored).collect())


def test_context(spark):
    rows = [(1, c, f"source-{c}.pdf", f"Chunk text for {c}", s) for c, s in (("a", 0.5), ("b", 0.9), ("c", 0.7))] + [(2, f"k{i}", "one.pdf", chr(97 + i) * 2000, 1 - i / 100) for i in range(20)] + [(3, "n", "s", None, 0.5)]
    df = spark.createDataFrame(rows, "q int, id string, source string, text string, score double")
    con = spark.createDataFrame([(1, "SSA Form", "Static Single Assignment", 1)], "q int, label string, summary string, rank int")
    got = {r.q: r for r in X.contexts(df, con).collect()}
    assert got[1].chunk_ids == ["b", "c", "a"] and got[1].context.startswith("=== Relevant Concepts ===\n\n• SSA Form: Static Single Assignment\n")
    assert got[1].labels == ["SSA Form"] and got[1].sources == ["source-b.pdf", "source-c.pdf", "source-a.pdf"]
    assert len(got[2].chunk_ids) == 0 or len(got[2].context) <= 2100
    assert got[3].context == "----\nSource: s\n\n\n\n----"
    assert X.contexts(df.where("false")).count() == 0
    same = spark.createDataFrame([(1, f"x{i}", "s", "y" * 300, 1.0) for i in range(5)], "q int, id string, source string, text string, score double")
    assert X.without_near_repeats(same).count() == 1


def test_frames(spark):
    lines = spark.createDataFrame([(1, 10), (1, 20), (1, 20)], "k int, start int")
    frames = spark.createDataFrame([(1, 0.0), (1, 10.0), (1, 11.0), (1, 21.0), (2, 1.0)], "k int, frame double")
    assert {(r.frame, r.line_start) for r in D.frames_into_lines(lines, frames, "k").collect()} == {(0.0, 10.0), (10.0, 10.0), (11.0, 20.0)}


def test_video_is_merged(spark):
    lines = spark.createDataFrame([(1, 5, "first"), (1, 65, "second")], "k int, start long, line string")
    frames = spark.createDataFrame([(1, 0.0, "a door"), (1, 30.0, "a hall"), (1, 90.0, "gone")], "k int, frame double, description string")
    assert D.merged_transcript(lines, frames, "k").first().text == "\n[VISUAL at 0:00] a door\n\n[0:05] first\n\n[VISUAL at 0:30] a hall\n\n[1:05] second"
    assert D.merged_transcript(lines, frames.where("false"), "k").first().text == "[0:05] first\n[1:05] second"


def test_scripts(spark):
    df = spark.createDataFrame([("One. Two! Three?", "ALEX: hi there\nnoise\nSAM: yes")], "a string, b string")
    r = df.select(D.script_segments(F.col("a"), "monologue").alias("m"), D.script_segments(F.col("b"), "dialogue").alias("d"), D.script_segments(F.col("a"), "interview").alias("i"), D.safe_filename(F.lit("A b/C!")).alias("f"), D.script_seconds(D.script_segments(F.col("b"), "dialogue")).alias("s")).first()
    assert [x.text for x in r.m] == ["One. Two!", "Three?"] and r.i == r.m
    assert [(x.speaker, x.text) for x in r.d] == [("ALEX", "hi there"), ("SAM", "yes")] and r.f == "a_b_c_" and r.s == 1


def test_catalog(spark, tmp_path):
    s = C.Snapshots(spark, f"file://{tmp_path}")
    assert s.version("t") == 0
    with pytest.raises(FileNotFoundError):
        s.read("t")
    assert s.write("t", spark.range(3)) == 1
    assert s.append("t", spark.range(3, 5)) == 2 and s.read("t").count() == 5 and s.read("t", 1).count() == 3
    assert s.write("t", s.read("t").where("id > 0")) == 3 and s.read("t").count() == 4
    s.vacuum("t", keep=1)
    assert s.read("t").count() == 4
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "id int, database_id string")
    assert [r.database_id for r in C.backfill(df).orderBy("id").collect()] == ["default", "default", "x"]
    wide = C.evolve(df, spark.createDataFrame([], "id int, n int, s string").schema, {"n": 7})
    assert wide.columns == ["id", "database_id", "n", "s"] and wide.first().n == 7
    with pytest.raises(Exception, match="3 numbers"):
        C.check_dimensions(spark.createDataFrame([([1.0],)], "v array<double>"), "v", 3).collect()


def test_lookup_with_hot_keys(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"), F.col("id").alias("n"))
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k5", 3)], "d string, x int")
    assert hot_keys(rows, "k") == ["hot"] and hot_keys(rows.limit(10), "k") == []
    plain = rows.join(dim, F.col("k") == F.col("d")).drop("d")
    assert lookup(rows, "k", dim, "d").exceptAll(plain).count() == 0 and lookup(rows, "k", dim, "d").count() == plain.count()
    assert lookup(rows, "k", dim, "d", how="left").count() == 30_000


def test_dense_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "x string")
    assert {r.x: r.n for r in dense_index(df, "x").collect()} == {"a": 0, "b": 1, "c": 2}
    assert dense_index(df.where("false"), "x").count() == 0


def test_readouts_on_empty_tables(spark):
    e = spark.createDataFrame([], "edge_id string, source_chunk string, target_chunk string, relationship string, weight double, database_id string")
    assert {r.n for r in R.relationship_counts(e).collect()} == {0}
    c = spark.createDataFrame([], "chunk_id string, source string, text string, timestamp timestamp, page int, access_count int, database_id string")
    assert R.sources_rollup(c, e).count() == 0 and R.top_sources(c).count() == 0
    rows = spark.createDataFrame([("a", "s", r"50% \ off", None, 0, 0, "d"), ("b", "s", "50 x OFF", None, 0, 0, "d")], c.schema)
    assert [r.chunk_id for r in R.chunk_listing(rows, "d", "50% \\ OFF").collect()] == ["a"]
    assert R.chunk_listing(rows, "d", "5_ x o%", limit=0).count() == 1


def test_names_are_unique():
    with pytest.raises(ValueError, match="two queries"):
        query("top_sources")(lambda s, d: None)
        query("top_sources")(lambda s, d: None)


def test_stored_rows_are_found_by_cells(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 16))
    v[-50:] = v[0]  # one cell with many rows
    stored = spark.createDataFrame([(i, x.tolist(), "d" if i % 7 else "e") for i, x in enumerate(v)], "id int, v array<double>, database_id string")
    q = v[:200] + 0.01 * rng.normal(size=(200, 16))
    new = spark.createDataFrame([(i, x.tolist(), "d") for i, x in enumerate(q)] + [(900, None, "d"), (901, [0.0] * 16, "d")], "q int, v array<double>, database_id string")
    exact = {(r.q, r.id) for r in K.knn(new, stored, 6, "database_id").collect()}
    index = K.CellIndex.fit(stored, 64)
    got = index.join(new, index.assign(stored, "database_id"), 6, 8, "database_id", rows_in=50, queries_in=20).collect()
    assert len({(r.q, r.id) for r in got} & exact) >= 0.9 * len(exact) and max(r["rank"] for r in got) == 6 and len(got) == len({(r.q, r.id) for r in got})
    few = stored.where("id < 3000")
    assert {(r.q, r.id) for r in K.nearest_stored(new, few, 6, "database_id").collect()} == {(r.q, r.id) for r in K.knn(new, few, 6, "database_id").collect()}
    assert K.nearest_stored(new, stored.where("false"), 6, "database_id").count() == 0 and K.nearest_stored(new.where("false"), few, 6, "database_id").count() == 0


def test_recall_of_the_query_by_cells(spark):
    import os

    from tessera.plans import queries_retrieval as Q

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    got = {(r.q, r.id) for r in Q.ann_topk(spark, folder).collect()}
    want = {(r.q, r.id) for r in K.knn(Q.G.queries(spark, folder), Q._rows(spark, folder), 10).collect()}
    assert len(got & want) >= 0.9 * len(want)
