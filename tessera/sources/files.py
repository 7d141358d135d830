"""Files and folders as documents: one row per file with its text and metadata."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.html import html_text, page_text
from tessera.functions.providers import Providers
from tessera.functions.text import clean_pdf_text
from tessera.operators.documents import strip_pdf_noise

# Extensions by kind; a kind listed earlier wins.
KINDS = {
    "audio": (".mp3", ".wav", ".m4a", ".ogg", ".flac", ".webm"),
    "image": (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".tiff"),
    "video": (".mp4", ".mov", ".avi", ".mkv", ".webm"),
    "text": (".txt", ".md"),
    "html": (".html",),
    "pdf": (".pdf",),
    "docx": (".docx",),
}
#: Extensions that a scan of a folder takes.
SUPPORTED = (".txt", ".md", ".pdf", ".docx", ".html")
_SKIPPED = r"(^|/)(\.[^/]+|node_modules)(/|$)"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def kind_of(path: Column) -> Column:
    """The kind of a file by its extension; null for unknown ones."""
    ext, out = extension(path), F.lit(None).cast("string")
    for kind, names in reversed(KINDS.items()):
        out = F.when(ext.isin(*names), kind).otherwise(out)
    return out


def is_url(path: Column) -> Column:
    return path.rlike("(?i)^https?://")


def is_supported(path: Column) -> Column:
    """Of a kind that folders are scanned for, and in no hidden place."""
    return extension(path).isin(*SUPPORTED) & ~path.rlike(_SKIPPED)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, length) of the supported files under a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("modified"), "length").where(is_supported(F.regexp_replace("path", r"^[a-z]+:/*", "/")))


def docx_text(data: bytes) -> str:
    """Paragraphs of a docx file, parted by blank lines."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paras = ["".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p")]
    return "\n\n".join(p for p in paras if p.strip())


def plain_pdf_text(data: bytes) -> str:
    """Text shown in uncompressed content streams: a default without a library; give a real extractor for other files."""
    shown = re.findall(rb"\((?:\\.|[^\\()])*\)\s*Tj", data)
    return "\n".join(re.sub(r"\\([()\\])", r"\1", s[1 : s.rindex(b")")].decode("latin-1")) for s in shown)


def merged_lines(lines: list[tuple[float, str]], frames: list[tuple[float, str]]) -> list[str]:
    """Lines of speech (second, text) with each frame's description before the first line at its time or after; frames after the last line go."""
    out, rest = [], sorted(frames)
    for at, line in lines:
        while rest and rest[0][0] <= at:
            s, said = rest.pop(0)
            out.append(f"\n[VISUAL at {int(s) // 60}:{int(s) % 60:02d}] {said}\n")
        out.append(line)
    return out


def _spoken(segments: list[dict]) -> list[tuple[float, str]]:
    return [(float(s["start"]), f"[{int(s['start']) // 60}:{int(s['start']) % 60:02d}] {s['text'].strip()}") for s in segments]


def documents_of(files: DataFrame, pdf: Callable[[bytes], str] = plain_pdf_text, providers: Providers | None = None, frame_seconds: int = 30) -> DataFrame:
    """(path, kind, text, metadata, error) of `files` (path, content). A file of unknown kind, or one that can't be read, has an error and no text."""
    p = providers or Providers()
    files = files.select("path", kind_of(F.col("path")).alias("kind"), "content")

    def read(kind: str | None, path: str, data: bytes) -> tuple[str | None, dict, str | None]:
        meta = {"type": kind or "", "source": path}
        try:
            if kind == "text":
                return data.decode("utf-8", "replace"), meta, None
            if kind == "html":
                return html_text(data.decode("utf-8", "replace")), meta, None
            if kind == "docx":
                return docx_text(data), meta, None
            if kind == "pdf":
                return pdf(data), meta, None
            if kind == "audio" and p.transcribe:
                seg = p.transcribe(path)
                return "\n".join(x for _, x in _spoken(seg)), meta | {"duration": str(seg[-1]["end"] if seg else 0)}, None
            if kind == "video" and p.transcribe:
                seg = p.transcribe(path)
                seen = [(s, p.describe(f)) for s, f in p.frames(path, frame_seconds)] if p.frames and p.describe else []
                return "\n".join(merged_lines(_spoken(seg), seen)), meta | {"duration": str(seg[-1]["end"] if seg else 0), "frames": str(len(seen))}, None
            if kind == "image" and (p.describe or p.ocr):
                said, seen = p.describe(path) if p.describe else "", "\n".join(x.strip() for x in (p.ocr(path) if p.ocr else "").split("\n") if x.strip())
                return (f"{said}\n\nExtracted text:\n{seen}" if said and seen else said or seen), meta, None
            return None, meta, f"no reader for {kind or 'this kind of file'}"
        except Exception as e:
            return None, meta, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, kind, *read(kind, path, bytes(data))) for path, kind, data in zip(b["path"], b["kind"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "metadata", "error"])

    raw = files.mapInPandas(run, "path string, kind string, text string, metadata map<string,string>, error string")
    cleaned = strip_pdf_noise(raw.where("kind = 'pdf'").select("path", clean_pdf_text(F.col("text")).alias("t")), "path", "t").withColumnRenamed("text", "clean")
    out = raw.join(cleaned, "path", "left")
    return out.select("path", "kind", F.coalesce("clean", "text").alias("text"), "metadata", "error")


def read_documents(spark: SparkSession, folder: str, pdf: Callable[[bytes], str] = plain_pdf_text, providers: Providers | None = None) -> DataFrame:
    """(path, kind, text, metadata, error): all files under a folder, but those in hidden places."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(~F.col("path").rlike(_SKIPPED))
    return documents_of(files, pdf, providers)


def read_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, text) of fetched pages; fetching itself is left to whatever lands them."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(page_text)

    return pages.select(url, run(html).alias("text"))


def new_files(files: DataFrame, ingested: DataFrame) -> DataFrame:
    """Files whose name isn't a source yet. files: path; ingested: source."""
    return files.join(ingested.select(F.substring_index("source", "/", -1).alias("name")).distinct(), F.substring_index("path", "/", -1) == F.col("name"), "left_anti")
