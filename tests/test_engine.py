"""The whole surface on a small store, with the deterministic providers."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.config import NO_CONTEXT
from tessera.engine import Engine
from tessera.functions.providers import Providers, overlap_score

TEXTS = {
    "a.md": "The kelp bed grows along the shelf. The kelp bed feeds the seals of the shelf.",
    "b.md": "The kelp bed grows along the shelf. The kelp bed feeds the otters of the shelf.",
    "c.md": "Parsers read tokens and build trees. Trees are then checked by the type system.",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    now = [datetime(2026, 1, 1, 12)]

    def clock():
        now[0] += timedelta(seconds=1)
        return now[0]

    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}", Providers(rerank=overlap_score), clock=clock)
    for s, t in TEXTS.items():
        e.ingest_text(s, t)
    return e


def test_databases(engine):
    assert [r.id for r in engine.list_databases().collect()] == ["default"]
    assert engine.create_database(" thesis ") == "db_thesis"
    with pytest.raises(ValueError, match="there is a database"):
        engine.create_database("thesis")
    engine.ingest_text("t.md", "A text of another database, about nothing much.", "db_thesis")
    with pytest.raises(ValueError, match="default"):
        engine.delete_database("default")
    engine.delete_database("db_thesis")
    assert engine.table("chunks").where("database_id = 'db_thesis'").isEmpty()
    assert [r.id for r in engine.list_databases().collect()] == ["default"]


def test_ingest_again_adds_nothing(engine):
    before = engine.table("chunks").count()
    got = engine.ingest_text("a.md", TEXTS["a.md"])
    assert got["stored"] == 0 and got["skipped"] == 1
    assert engine.table("chunks").count() == before
    assert engine.table("ingest_events").where("chunks_stored = 0").count() >= 1


def test_seeding_has_no_self_edges(engine):
    e = engine.table("connections")
    assert e.count() > 0
    assert e.where("source_chunk = target_chunk").isEmpty()
    assert {r.weight for r in e.collect()} == {0.3}


def test_retrieve_ranks_and_logs(engine):
    got = engine.retrieve(["kelp bed of the seals"], top=3, least=0.0).collect()
    assert got[0].source == "a.md"
    assert engine.table("co_access_events").count() == 1
    assert engine.table("chunks").agg(F.sum("access_count")).first()[0] == len(got)


def test_answer(engine):
    got = engine.query_answer("Which animals does the kelp bed feed?")
    assert "kelp" in got["answer"] and "a.md" in got["sources"]
    assert got["evidence"][0]["score"] >= got["evidence"][-1]["score"]
    assert engine.query_answer("x", database="db_none")["answer"] == NO_CONTEXT


def test_consolidate_and_concepts(engine):
    out = engine.consolidate()
    assert out["clustered"] >= 1
    c = engine.table("concepts")
    assert c.where("label is null or members is null").isEmpty()
    ids = {r.concept_id for r in c.collect()}
    engine.abstract()
    assert ids <= {r.concept_id for r in engine.table("concepts").collect()}
    assert engine.table("connections").where("relationship = 'related_to' and weight_version = 1").isEmpty()


def test_concept_is_renewed_under_its_id(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    for i in range(4):
        e.ingest_text(f"s{i}", f"Word{i} text number {i} about several other things entirely {i * 7}.")
    ids = [r.chunk_id for r in e.table("chunks").orderBy("source").collect()]
    base = e.table("connections").limit(0)

    def edges(pairs):
        rows = spark.createDataFrame([(f"e{i}", ids[a], ids[b], "supports", w) for i, (a, b, w) in enumerate(pairs)], "edge_id string, source_chunk string, target_chunk string, relationship string, weight double").withColumn("database_id", F.lit("default"))
        return base.unionByName(rows, allowMissingColumns=True)

    e.store.write("connections", edges([(0, 1, 0.8), (1, 2, 0.78)]))
    assert e.abstract() == 1
    first = e.table("concepts").first()
    assert sorted(first.members) == sorted(ids[:3])
    assert e.abstract() == 0
    e.store.write("connections", edges([(0, 1, 0.8), (1, 2, 0.78), (2, 3, 0.81)]))
    assert e.abstract() == 1
    again = e.table("concepts").collect()
    assert [c.concept_id for c in again] == [first.concept_id]
    assert again[0].version == first.version + 1 and sorted(again[0].members) == sorted(ids)
    assert e.sync_concepts() == 1


def test_prior_needs_ten_samples(spark, tmp_path):
    import numpy as np

    from tessera.operators.prior import Prior

    p = Prior(8, ["c"])
    x, y = np.eye(8)[np.arange(9) % 8], np.ones((9, 1))
    assert not p.fit(x, y) and p.influence() == 0
    x, y = np.eye(8)[np.arange(20) % 8], np.ones((20, 1))
    before = p.predict(x).mean()
    assert p.fit(x, y) and p.predict(x).mean() > before
    assert p.influence() == pytest.approx(0.03)
    q = Prior.from_row(p.to_row("default", 0), 8, ["c"])
    assert np.allclose(q.predict(x), p.predict(x)) and q.trained_on == 20
    assert Prior.from_row(p.to_row("default", 0), 8, ["c", "d"]).trained_on == 0
    assert Prior(8, []).influence() == 0


def test_prior_in_blocks_of_outputs():
    import numpy as np

    from tessera.operators.prior import Prior

    p = Prior(8, ["a", "b", "c"], trained_on=7)
    rows = list(p.to_rows("x", 0, block=2))
    q = Prior.from_rows(rows[::-1], 8, ["a", "b", "c"])
    assert len(rows) == 2 and q.trained_on == 7 and all(np.array_equal(a, b) for a, b in zip(p.layers, q.layers, strict=True))
    assert Prior.from_rows(rows, 8, ["a", "b", "c", "d"]).trained_on == 0


def test_a_prior_of_many_concepts_has_them_all(spark, tmp_path):
    n, dims = 50_001, 8
    e = Engine(spark, f"file://{tmp_path}", dims=dims)
    c = spark.range(n).select(F.format_string("c%06d", "id").alias("concept_id"), F.array(F.concat(F.lit("m"), F.col("id").cast("string"))).alias("members"), F.lit("default").alias("database_id"))
    e.store.write("concepts", e.table("concepts").unionByName(c, allowMissingColumns=True))
    events = spark.createDataFrame([(f"e{i}", [f"m{n - 1}"], str([float(i == j) for j in range(dims)]), 1, "default") for i in range(12)], "event_id string, ids array<string>, query_embedding string, timestamp long, database_id string")
    e.store.write("co_access_events", e.table("co_access_events").unionByName(events, allowMissingColumns=True))
    assert e.train() == 12
    model = e._prior("default")
    assert model.trained_on == 12 and len(model.concepts) == n and model.layers[-1].shape == (n,)
    assert model.layers[-1][-1] > 0 > model.layers[-1][:-1].max()
    scores = e._concept_predictions(spark.createDataFrame([(0, [1.0] + [0.0] * (dims - 1))], "q int, v array<double>"), model)
    assert scores.where(f"concept_id = 'c{n - 1:06d}'").count() == 1
