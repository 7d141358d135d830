"""Command line, HTTP, overviews, images, benchmark, worker, on small stores."""

from __future__ import annotations

import json
import os
import threading
import time
import urllib.error
import urllib.request
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.engine import Engine
from tessera.functions.chunkers import chunks_of
from tessera.functions.providers import Providers
from tessera.server import serve
from tessera.sources.files import read_documents
from tessera.streaming.jobs import Cadence, scan_folder

TEXTS = {"a.md": "The kelp bed grows along the shelf. The kelp bed feeds the seals.", "b.md": "The kelp bed feeds the otters along the shelf.", "c.md": "Parsers read tokens and build trees of them."}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    now = [datetime(2026, 1, 1, 12)]

    def clock():
        now[0] += timedelta(seconds=1)
        return now[0]

    def vector(path):
        if "bad" in path:
            raise OSError(path)
        return [1.0, float("b" in os.path.basename(path))]

    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}", Providers(embed_image=vector, speak=lambda who, what: f"{who}: {what}|".encode()), clock=clock)
    for s, t in TEXTS.items():
        e.ingest_text(s, t, tags="x, y,")
    return e


def test_reads_rewrite_no_table(engine):
    before = engine.store.version("chunks")
    first = {r.chunk_id: r.access_count for r in engine.table("chunks").collect()}
    got = {r.id for r in engine.retrieve(["kelp bed"], least=0.0).collect()}
    after = {r.chunk_id: (r.access_count, r.last_accessed) for r in engine.table("chunks").collect()}
    assert engine.store.version("chunks") == before and got
    assert all(after[c][0] == n + (c in got) for c, n in first.items()) and all(after[c][1] for c in got)
    engine.compact()
    assert {r.chunk_id: (r.access_count, r.last_accessed) for r in engine.table("chunks").collect()} == after
    assert engine.store.additions("chunks") == 0 and list(engine.table("chunks").first().tags) == ["x", "y"]


def test_overview_and_benchmark(engine):
    got = engine.audio_overview(TEXTS["a.md"])
    assert got["segments"][0][0] == "ALEX" and got["seconds"] > 0 and got["sound"].startswith(b"ALEX: ") and "a.md" in got["sources"]
    engine.create_database("void")
    with pytest.raises(LookupError):
        engine.audio_overview("kelp bed", "db_void")
    one = engine.benchmark().collect()
    two = engine.benchmark().collect()
    assert len(one) == 5 and all(r.overlap is None for r in one) and all(r.overlap == (1.0 if r.n else 0.0) for r in two)
    for _ in range(2):
        engine.benchmark(keep=3)
    assert engine.table("benchmark_runs").select("run_at").distinct().count() == 3


def test_images(engine, tmp_path):
    for n in ("a.png", "b.jpg", "bad.png", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert engine.ingest_images(str(tmp_path)) == 2 and engine.ingest_images(str(tmp_path)) == 0
    q = engine.spark.createDataFrame([(0, [1.0, 1.0], "default")], "q int, v array<double>, database_id string")
    assert engine.nearest_images(q, 1).first().id.endswith("b.jpg")


def test_video_has_speech_and_frames(spark, tmp_path):
    (tmp_path / "v.mp4").write_bytes(b"x")
    p = Providers(transcribe=lambda _: [{"start": 0, "end": 9, "text": " one "}, {"start": 65, "end": 70, "text": "two"}], frames=lambda path, every: [(30.0, "f1"), (90.0, "f2")], describe=lambda f: f"seen {f}")
    r = read_documents(spark, str(tmp_path), providers=p).first()
    assert r.text == "[0:00] one\n\n[VISUAL at 0:30] seen f1\n\n[1:05] two" and r.metadata["frames"] == "2" and r.error is None
    assert read_documents(spark, str(tmp_path)).first().error == "no reader for video"


def test_metadata_of_chunks():
    own = {"type": "text", "source": "s"}
    assert chunks_of("Some text here.", "fast", metadata=own) == [("Some text here.", own)]
    assert chunks_of("Some text here.", "token", metadata=own)[0][1] == {} and chunks_of("Some text here.", "llm", metadata=own)[0][1] == {}
    assert chunks_of("[0:05] a", kind="audio", metadata=own)[0][1] == own | {"timestamp_start": "5", "timestamp_end": "5"}


def test_changed_files_are_read_again(engine, tmp_path):
    seen = []
    take = lambda df, _: seen.append(sorted((r.path.rsplit("/", 1)[1], r.text) for r in df.collect()))
    (tmp_path / "in").mkdir()
    a = tmp_path / "in" / "a.html"
    a.write_text("<p>one</p>")
    (tmp_path / "in" / "b.txt").write_text("two")
    from tessera.operators.catalog import Snapshots

    ledger = Snapshots(engine.spark, f"file://{tmp_path}/ledger")
    assert [scan_folder(engine.spark, str(tmp_path / "in"), ledger, take) for _ in range(2)] == [2, 0]
    a.write_text("<p>three</p>")
    os.utime(a, (time.time() + 10, time.time() + 10))
    assert scan_folder(engine.spark, str(tmp_path / "in"), ledger, take) == 1
    assert seen == [[("a.html", "one"), ("b.txt", "two")], [("a.html", "three")]]


def test_worker_keeps_its_times(engine):
    c = Cadence(engine.store)
    assert c.due("train", datetime(2026, 1, 1))
    ran = engine.run_due()
    assert ran == ["classify", "tick", "hebbian", "cluster", "train", "abstract", "sync"]
    assert engine.run_due() == ["classify", "tick", "abstract", "sync"]


def test_hebbian_makes_edges_of_similar_chunks(spark):
    from tessera.streaming.jobs import consolidation_tick
    from tessera.engine import _SCHEMAS

    edges = spark.createDataFrame([], _SCHEMAS["connections"])
    events = spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],)], "ids array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0], "d"), ("b", [1.0, 0.5], "d"), ("c", [0.0, 1.0], "d")], "id string, v array<double>, database_id string")
    out = consolidation_tick(edges, spark.createDataFrame([], "node string, access_count int"), events, datetime(2026, 1, 1), vectors=vectors).collect()
    assert {(r.source_chunk, r.target_chunk) for r in out} == {("a", "b"), ("b", "c")} and {r.relationship for r in out} == {"co_accessed"}
    assert {r.source_chunk: round(r.weight, 6) for r in out} == {"a": 0.0975, "b": 0.05} and {r.database_id for r in out} == {"d"}


def test_abstracted_concepts_are_validated_and_merged(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store", Providers(validate=lambda s, a, b: 0.9))
    for i in range(5):
        e.ingest_text(f"{i}.md", f"The kelp bed number {'abcde'[i]} grows along the northern shelf of the bay.")
    edges = e.table("connections")
    e.store.write("connections", edges.withColumn("weight", F.lit(0.9)))
    assert e.abstract() == 1
    c = e.table("concepts").first()
    assert c.confidence == pytest.approx(0.9) and len(c.members) == 5
    twin = e.table("concepts").withColumns({"concept_id": F.lit("zz"), "version": F.lit(4), "members": F.slice("members", 1, 4)})
    e.store.append("concepts", twin)
    assert e.merge_concepts() == 1
    c = e.table("concepts").collect()
    assert [(r.version, len(r.members)) for r in c] == [(5, 5)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(TEXTS["a.md"])
    store = ["--store", f"file://{tmp_path}/store"]
    assert main([*store, "ingest", str(tmp_path / "in")], spark) == 0
    assert json.loads(capsys.readouterr().out)["stored"] == 1
    assert main([*store, "stats"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["chunks"] == 1
    assert main([*store, "delete-database", "default"], spark) == 1


def test_http(engine):
    server = serve(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def ask(path, body=None, method=None):
        r = urllib.request.Request(base + path, json.dumps(body).encode() if body is not None else None, method=method)
        try:
            with urllib.request.urlopen(r, timeout=120) as x:
                return x.status, json.loads(x.read())
        except urllib.error.HTTPError as x:
            return x.code, json.loads(x.read())

    try:
        assert ask("/health") == (200, {"ok": True})
        assert ask("/retrieve", {"text": "kelp bed"})[0] == 200 and ask("/retrieve", {})[0] == 400 and ask("/nothing")[0] == 404
        status, got = ask("/ingest", {"source": "d.md", "text": "Otters hold hands while they sleep."})
        assert status == 202
        for _ in range(200):
            events = ask(f"/jobs/{got['job']}")[1]
            if events[-1]["type"] != "start":
                break
            time.sleep(0.3)
        assert events[-1]["type"] == "done" and events[-1]["result"]["stored"] == 1
        assert ask("/chunks?search=Otters")[1][0]["source"] == "d.md"
        assert ask("/databases", {"name": "n1"})[1] == {"id": "db_n1"} and ask("/databases/db_n1", method="DELETE")[0] == 200 and ask("/databases/default", method="DELETE")[0] == 400
    finally:
        server.shutdown()
