"""Streams run to their end over small folders."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators.catalog import Snapshots
from tessera.sources.files import kind_of, list_files, read_documents, read_pages
from tessera.streaming.jobs import co_access_counts, consolidation_tick, hebbian_stream, read_events, watch_folder


def test_folder_is_watched(spark, tmp_path):
    src, seen = tmp_path / "in", []
    (src / "sub").mkdir(parents=True)
    (src / "a.md").write_text("one")
    (src / "sub" / "b.txt").write_text("two")
    (src / "skip.bin").write_text("x")
    (src / ".hidden.md").write_text("x")

    def run():
        q = watch_folder(spark, str(src), lambda df, n: seen.extend(r.text for r in df.collect()), str(tmp_path / "cp"), available_now=True)
        q.awaitTermination(120)

    run()
    assert sorted(seen) == ["one", "two"]
    (src / "c.md").write_text("three")
    run()
    assert sorted(seen) == ["one", "three", "two"]


def test_events_strengthen_edges_once(spark, tmp_path):
    ev = spark.createDataFrame([(["a", "b"],)] * 5, "ids array<string>")
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    state = Snapshots(spark, f"file://{tmp_path}/state")
    state.write("edges", spark.createDataFrame([("e", "a", "b", 0.4)], "edge_id string, source_chunk string, target_chunk string, weight double"))
    for _ in range(2):  # the second run finds nothing new
        hebbian_stream(read_events(spark, str(tmp_path / "ev"), ev.schema), state, str(tmp_path / "cp"), available_now=True).awaitTermination(120)
    assert abs(state.read("edges").first().weight - (1 - 0.6 * 0.95**5)) < 1e-12


def test_windows_of_co_access(spark, tmp_path):
    rows = [(datetime(2026, 1, 1, h), ["a", "b"]) for h in (0, 0, 5)]
    df = spark.createDataFrame(rows, "ts timestamp, ids array<string>")
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    counts = co_access_counts(read_events(spark, str(tmp_path / "ev"), df.schema))
    q = counts.writeStream.format("memory").queryName("co_windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(r.times for r in spark.table("co_windows").collect()) == [1, 2]


def test_tick(spark):
    e = spark.createDataFrame([("e1", "a", "b", 0.96, 0.5, 1.0, 0), ("e2", "c", "d", 0.1, 0.5, 0.5, 0)], "edge_id string, source_chunk string, target_chunk string, weight double, confidence double, avg_sim double, access_count int").withColumns({"created_at": F.lit("2025-12-20").cast("timestamp"), "last_reinforced": F.lit(None).cast("timestamp")})
    c = spark.createDataFrame([("a", 5)], "node string, access_count int")
    none = spark.createDataFrame([], "ids array<string>")
    got = {r.edge_id: r.weight for r in consolidation_tick(e, c, none, datetime(2026, 1, 1)).collect()}
    assert 0.96 < got["e1"] <= 1 and 0.05 <= got["e2"] < 0.1


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "a.html").write_text("<body><p>hello</p></body>")
    (tmp_path / "b.md").write_text("# x")
    (tmp_path / "e.xyz").write_text("?")
    (tmp_path / "d.pdf").write_bytes(b"BT (A line) Tj (12) Tj ET")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>para</w:t></w:r></w:p></w:body></w:document>')
    got = {r.path.rsplit("/", 1)[1]: r for r in read_documents(spark, str(tmp_path)).collect()}
    assert got["a.html"].text == "hello" and got["b.md"].text == "# x" and got["c.docx"].text == "para" and got["d.pdf"].text == "A line"
    assert got["e.xyz"].error and got["e.xyz"].text is None
    assert list_files(spark, str(tmp_path)).count() == 4
    k = spark.createDataFrame([("x.WEBM",), ("a/b.mp4",), ("none",)], "p string").select(kind_of(F.col("p")).alias("k")).collect()
    assert [r.k for r in k] == ["audio", "video", None]
    pages = read_pages(spark.createDataFrame([("u", "<title>T</title><main><p>x</p></main>"), ("v", None)], "url string, html string")).collect()
    assert {r.url: r.text for r in pages} == {"u": "# T\n\nx", "v": ""}
