"""Progress, samples and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import concepts as P
from tessera.streaming.progress import Jobs, StreamProgress


def test_replay_and_retention():
    j = Jobs(keep=2)
    for n in range(4):
        j.emit(f"j{n}", "start", 0, total=12)
        for t in range(12):
            j.emit(f"j{n}", "chunk", t)
        j.emit(f"j{n}", "done", 12)
    assert list(j.jobs) == ["j2", "j3"] and len(j.replay("j3")) == 14 and j.replay("j0") == []
    assert j.jobs["j3"].rate() == 1.0 and j.jobs["j3"].left() == 0
    j.emit("x", "start", 0)
    assert j.jobs["x"].rate() is None and j.jobs["x"].left() is None
    j.emit("x", "error", 1, message="bad")
    assert j.jobs["x"].state == "error" and "j2" not in j.jobs


def test_streams_report(spark, tmp_path):
    jobs = Jobs()
    listener = StreamProgress(jobs)
    spark.streams.addListener(listener)
    try:
        spark.range(3).write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("memory").queryName("progress_t").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        assert any(x.state == "done" for x in jobs.jobs.values())
    finally:
        spark.streams.removeListener(listener)


def test_samples_and_validation(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i < 5 else [0.0, 1.0]) for i in range(10)], "id int, v array<double>")
    c = spark.createDataFrame([("a", [0, 1, 2, 3, 4], [1.0, 0.0]), ("all", list(range(10)), [1.0, 1.0])], "cluster string, members array<int>, v array<double>")
    assert P.sample_rows(rows, "id", 4).collect() == P.sample_rows(rows.repartition(3), "id", 4).collect()
    got = {r.cluster: r.others for r in P.non_members(c, rows, "id").collect()}
    assert len(got["a"]) == 3 and min(got["a"]) >= 5 and got["all"] == []
    assert {r.cluster: r.score for r in P.validation(c, rows, "id").collect()} == {"a": 1.0, "all": 0.5}
    two = c.select(F.col("cluster").alias("concept_id"), F.lit("d").alias("database_id"), "members", "v")
    assert P.alike(two, 0.5, 0.7).count() == 1 and P.alike(two).count() == 0
    assert spark.range(1).select(P.cluster_prompt(F.array(F.lit("abc"), F.lit("def")), 2, 2).alias("x")).first().x == "1. ab\n2. de"
