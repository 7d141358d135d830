"""Operators over documents: repeated page lines, transcripts, frames, scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import clock, normalize_text, strip_pattern_noise


def pages_of(text: Column) -> Column:
    """A document's pages: parted by form feeds or at least four line ends."""
    return F.split(text, r"\f|\n{4,}")


def repeated_lines(df: DataFrame, key: str, text: str, longest: int = 120) -> DataFrame:
    """(key, line, pages): short lines (white space collapsed) on at least three and 30 % of a document's pages; documents of one page have none."""
    paged = df.select(key, pages_of(F.col(text)).alias("p")).where("size(p) > 1")
    lines = paged.select(key, F.size("p").alias("n"), F.posexplode("p").alias("page", "t")).select(key, "n", "page", F.explode(F.split("t", "\n")).alias("raw"))
    lines = lines.select(key, "n", "page", normalize_text(F.col("raw")).alias("line")).where(f"line <> '' and length(line) <= {longest}").distinct()
    return lines.groupBy(key, "line").agg(F.count("*").alias("pages"), F.first("n").alias("n")).where("pages >= greatest(3, floor(0.3 * n))").select(key, "line", "pages")


def strip_pdf_noise(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): documents without repeated and noise lines. Null texts stay null."""
    found = repeated_lines(df, key, text).groupBy(key).agg(F.collect_set("line").alias("gone"))
    joined = df.select(key, F.col(text).alias("t")).join(found, key, "left")
    several = F.size(pages_of(F.col("t"))) > 1
    kept = F.array_join(F.transform(pages_of(F.col("t")), lambda p: F.array_join(F.filter(F.split(p, "\n"), lambda x: ~F.array_contains(F.col("gone"), normalize_text(x))), "\n")), "\n\n")
    return joined.select(key, strip_pattern_noise(F.when(several & F.col("gone").isNotNull(), kept).otherwise(F.when(several, F.array_join(pages_of(F.col("t")), "\n\n")).otherwise(F.col("t")))).alias("text"))


def transcript_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, start, line): the `[m:ss] words` lines of a transcript with their seconds; other lines go."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("n", "raw")).select(key, "n", F.regexp_extract_all(F.trim("raw"), F.lit(r"^\[(\d+):(\d{2})\]\s*(.+)$"), 0).alias("m"), F.trim("raw").alias("x"))
    x = F.col("x")
    rx = r"^\[(\d+):(\d{2})\]\s*(.+)$"
    return lines.where("size(m) = 1").select(key, "n", (F.regexp_extract(x, rx, 1).cast("long") * 60 + F.regexp_extract(x, rx, 2).cast("long")).alias("start"), F.regexp_extract(x, rx, 3).alias("line"))


def transcript_text(segments: DataFrame, key: str) -> DataFrame:
    """(key, text): `[m:ss] words` lines of segments (key, start, text) in the order of time."""
    line = F.concat(F.lit("["), clock(F.col("start")), F.lit("] "), F.trim("text"))
    return segments.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", line.alias("x")))), lambda r: r["x"]), "\n").alias("text"))


def frames_into_lines(lines: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """(key, frame, line_start): each frame with the first line at its time or after; frames after the last line go.

    lines: key, start. frames: key, frame (seconds). One sort by time takes the place of a join by inequality.
    """
    a = lines.select(key, F.col("start").cast("double").alias("t"), F.lit(1).alias("is_line"), F.lit(None).cast("double").alias("frame"))
    b = frames.select(key, F.col("frame").cast("double").alias("t"), F.lit(0).alias("is_line"), F.col("frame").cast("double").alias("frame"))
    w = Window.partitionBy(key).orderBy("t", "is_line").rowsBetween(0, Window.unboundedFollowing)
    at = F.first(F.when(F.col("is_line") == 1, F.col("t")), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("line_start", at).where("is_line = 0 and line_start is not null").select(key, "frame", "line_start")


def visual_marker(seconds: Column, description: Column) -> Column:
    return F.concat(F.lit("\n[VISUAL at "), clock(seconds), F.lit("] "), description, F.lit("\n"))


def merged_transcript(lines: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """(key, text): a transcript with each frame's description before the first line at its time or after.

    lines: key, start, line. frames: key, frame (seconds), description. Frames after the last line go.
    """
    placed = frames_into_lines(lines, frames, key).join(frames.select(key, F.col("frame").cast("double").alias("frame"), "description"), [key, "frame"])
    shown = placed.select(key, F.struct(F.col("line_start").alias("t"), F.lit(0).alias("k"), F.col("frame").alias("s"), visual_marker(F.col("frame"), F.col("description")).alias("x")).alias("r"))
    spoken = lines.select(key, F.struct(F.col("start").cast("double").alias("t"), F.lit(1).alias("k"), F.col("start").cast("double").alias("s"), F.concat(F.lit("["), clock(F.col("start")), F.lit("] "), "line").alias("x")).alias("r"))
    both = shown.unionByName(spoken).groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("r"))
    return both.select(key, F.array_join(F.transform("r", lambda r: r["x"]), "\n").alias("text"))


def longest_by_prefix(df: DataFrame, group: str, position: str, text: str, prefix: int = 50) -> DataFrame:
    """(group, position, text): of texts of a group that begin alike (without case) the longest, at the place of the first."""
    t = F.trim(text)
    one = df.where(t != "").groupBy(group, F.lower(F.substring(t, 1, prefix)).alias("head")).agg(F.min(position).alias(position), F.min(F.struct((-F.length(t)).alias("n"), F.col(position), t.alias("t"))).alias("m"))
    return one.select(group, position, F.col("m.t").alias("text"))


def script_segments(text: Column, form: str) -> Column:
    """(speaker, text) of a script: dialogue and interview by their speakers' marks, else pairs of sentences by one narrator. An interview without marks is a monologue."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]+"), 0)
    pairs = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0))), lambda i: F.trim(F.concat_ws(" ", F.transform(F.slice(found, i * 2 + 1, 2), lambda x: F.trim(x))))), lambda x: x != "")
    single = F.transform(pairs, lambda x: F.struct(F.lit("NARRATOR").alias("speaker"), x.alias("text")))
    if form == "monologue":
        return single
    names = "ALEX|SAM" if form == "dialogue" else "HOST|EXPERT"
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(rf"^({names}):"))
    spoken = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, rf"^({names}):", 1).alias("speaker"), F.trim(F.regexp_replace(x, rf"^({names}):", "")).alias("text")))
    return F.when(F.size(spoken) > 0, spoken).otherwise(single) if form == "interview" else spoken


def script_seconds(segments: Column, per_minute: int = 150) -> Column:
    """Spoken length of a script in seconds."""
    words = F.aggregate(segments, F.lit(0), lambda n, x: n + F.size(F.filter(F.split(x["text"], r"\s+"), lambda w: w != "")))
    return F.floor(words / per_minute * 60 + 0.5).cast("long")


def safe_filename(c: Column) -> Column:
    return F.lower(F.substring(F.regexp_replace(c, "(?i)[^a-z0-9]+", "_"), 1, 40))
