"""Cutting texts into chunks: sections, paragraphs, sentences, time windows, token windows.

Pure functions from a text to its pieces; `chunk_table` runs them over a DataFrame.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import CONFIG

_PARAGRAPH = re.compile(r"\n\n+")
_SENTENCE = re.compile(r"""(?<=[.!?])["')\]]*\s+""")
_MARK = re.compile(r"^\[(\d+:\d{2})\]\s*(.+)$")

Count = Callable[[str], int]


def approx_tokens(text: str) -> int:
    return -(-len(text) // 4)


def paragraphs(text: str) -> list[str]:
    return [p for x in _PARAGRAPH.split(text) if (p := x.strip())]


def sentences(text: str) -> list[str]:
    """Sentences by their end signs. A rule, not a model: an abbreviation's point ends one as well."""
    at, out = 0, []
    for m in _SENTENCE.finditer(text):
        out.append(text[at : m.end()].strip())
        at = m.end()
    out.append(text[at:].strip())
    return [s for s in out if s]


def is_header(line: str) -> bool:
    t = line.strip()
    return bool(t) and len(t) <= 80 and t[-1] not in ".!?,;" and "A" <= t[0] <= "Z" and len(t.split(" ")) <= 10


def sections(text: str) -> list[tuple[str, str]]:
    """(header, body) of each part under a header. Of headers in a row the last counts, and a header without a body goes; text before the first has the header ''."""
    found: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        if not is_header(line):
            found[-1][1].append(line)
        elif "\n".join(found[-1][1]).strip():
            found.append((line.strip(), []))
        else:
            found[-1] = (line.strip(), [])
    return [(h, body) for h, lines in found if (body := "\n".join(lines).strip())]


def packed(units: Iterable[tuple[str, bool]], limit: int, count: Count = approx_tokens, glue: str = "\n\n") -> Iterator[str]:
    """Units joined in order as long as their counts stay within the limit; a unit marked as alone is a piece of its own."""
    held: list[str] = []
    size = 0
    for unit, alone in units:
        n = count(unit)
        if held and (alone or size + n > limit):
            yield glue.join(held).strip()
            held, size = [], 0
        if alone:
            yield unit.strip()
        else:
            held.append(unit)
            size += n
    if held:
        yield glue.join(held).strip()


def joined_small(pieces: Iterable[str], least: int, count: Count = approx_tokens, most: int | None = None, glue: str = "\n\n") -> list[str]:
    """Pieces under `least` go to the piece before them (if the two stay within `most`); the first piece stays."""
    out: list[str] = []
    for p in pieces:
        if out and count(p) < least and (most is None or count(f"{out[-1]}{glue}{p}".strip()) <= most):
            out[-1] = f"{out[-1]}{glue}{p}".strip()
        else:
            out.append(p)
    return out


def paragraph_chunks(text: str, most: int = CONFIG.semantic_max_tokens, least: int = CONFIG.semantic_min_tokens) -> list[str]:
    """Paragraphs packed up to a size; one that is over it goes in by sentences, and a single sentence over it stands alone."""

    def units() -> Iterator[tuple[str, bool]]:
        for p in paragraphs(text):
            parts = sentences(p) if approx_tokens(p) > most else [p]
            if parts == [p] or len(parts) <= 1:
                yield p, approx_tokens(p) > most
            else:
                yield from ((s, False) for s in parts)

    return joined_small(packed(units(), most), least)


def semantic_chunks(text: str, most: int = CONFIG.semantic_max_tokens, least: int = CONFIG.semantic_min_tokens) -> list[str]:
    """Sections whole where they fit, else by paragraphs; without sections the whole text by paragraphs."""
    parts = sections(text)
    if len(parts) <= 1:
        return paragraph_chunks(text, most, least)
    pieces: list[str] = []
    for header, body in parts:
        whole = f"{header}\n{body}" if header else body
        pieces += [whole] if approx_tokens(whole) <= most else paragraph_chunks(whole, most, least)
    return joined_small(pieces, least, glue="\n")


def audio_chunks(text: str, minutes: int = 2) -> list[tuple[str, int, int]]:
    """(text, start, end) of windows over `[m:ss]` lines: a window closes when a line begins `minutes` or more after the window's first. Other lines go; without any line the text is one window from 0 to 0."""
    marked = [(int(m[1].split(":")[0]) * 60 + int(m[1].split(":")[1]), f"[{m[1]}] {m[2]}") for x in text.split("\n") if (m := _MARK.match(x.strip()))]
    if not marked:
        return [(text, 0, 0)]
    span = max(1, minutes) * 60
    out: list[list[tuple[int, str]]] = []
    for at, line in marked:
        if out and at - out[-1][0][0] < span:
            out[-1].append((at, line))
        else:
            out.append([(at, line)])
    return [("\n".join(x for _, x in w), w[0][0], w[-1][0]) for w in out]


class Words:
    """The default tokenizer: runs of word characters, single signs, and the blanks before them kept."""

    _TOKEN = re.compile(r"\s*(?:\w+|[^\w\s])")

    def encode(self, text: str) -> list[str]:
        return self._TOKEN.findall(text)

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens)

    def count(self, text: str) -> int:
        return len(self.encode(text))


def token_windows(text: str, most: int, overlap: int, tokenizer: Words) -> list[str]:
    """Windows of at most `most` tokens, each beginning `overlap` before the end of the one before; the last ends with the text."""
    ids = tokenizer.encode(text)
    if len(ids) <= most:
        return [text]
    step = max(1, most - overlap)
    starts = range(0, max(1, len(ids) - most + step), step)
    return [w for a in starts if (w := tokenizer.decode(ids[a : a + most]).strip())]


def token_chunks(text: str, least: int = CONFIG.chunk_min_tokens, most: int = CONFIG.chunk_max_tokens, overlap: int = CONFIG.chunk_overlap_tokens, hard: int = CONFIG.embed_max_tokens, tokenizer: Words | None = None) -> list[str]:
    """Chunks by a tokenizer's count: paragraphs, else sentences, else windows, packed to `most`; none is over `hard`."""
    tk = tokenizer or Words()

    def atoms(t: str) -> Iterator[tuple[str, bool]]:
        for p in paragraphs(t):
            parts = [p] if tk.count(p) <= most else sentences(p)
            for s in parts:
                yield from ((w, False) for w in ([s] if tk.count(s) <= most else token_windows(s, most, overlap, tk)))

    parts = sections(text)
    wholes = [text] if len(parts) <= 1 else [f"{h}\n{b}" if h else b for h, b in parts]
    out: list[str] = []
    for t in wholes:
        for c in joined_small(packed(atoms(t), most, tk.count), least, tk.count, hard):
            out += [c] if tk.count(c) <= hard else token_windows(c, hard, overlap, tk)
    return out


def sentence_windows(text: str, size: int = CONFIG.llm_window_tokens, overlap: int = CONFIG.llm_overlap_tokens) -> list[str]:
    """Windows of whole sentences for a segmenting model; each begins with the last sentences of the one before it that make up the overlap."""
    s = sentences(text)
    n = [approx_tokens(x) for x in s]
    out, start = [], 0
    while start < len(s):
        end, total = start, 0
        while end < len(s) and (end == start or total + n[end] <= size):
            total += n[end]
            end += 1
        out.append(" ".join(s[start:end]))
        if end == len(s):
            break
        back, held = end, 0
        while back > start and held < overlap:
            back -= 1
            held += n[back]
        start = end if back <= start else back
    return out


def dedupe_by_prefix(pieces: Iterable[str], prefix: int = 50) -> list[str]:
    """Of pieces that begin alike (without case) the longest, at the place of the first."""
    kept: dict[str, str] = {}
    for p in pieces:
        t = p.strip()
        k = t[:prefix].lower()
        if t and len(t) > len(kept.get(k, "")):
            kept[k] = t
    return list(kept.values())


def segmented_chunks(text: str, segmenter: Callable[[str], object] | None = None, size: int = CONFIG.llm_window_tokens, overlap: int = CONFIG.llm_overlap_tokens) -> list[str]:
    """Chunks that a segmenting model makes of each window.

    The model gives a list of texts. A list that isn't one of texts, None or an error falls back
    to the window's paragraphs; another value (parsed, but no list) to the whole window. The default model is `semantic_chunks`.
    """
    out: list[str] = []
    for w in sentence_windows(text, size, overlap):
        try:
            got = (segmenter or semantic_chunks)(w)
        except Exception:
            got = None
        if got is None:
            out += paragraphs(w)
        elif isinstance(got, list):
            out += [x for x in got if isinstance(x, str)]
        else:
            out.append(w)
    return dedupe_by_prefix(out)


def chunks_of(text: str | None, strategy: str = "token", kind: str = "text", metadata: dict[str, str] | None = None, **options: object) -> list[tuple[str, dict[str, str]]]:
    """(text, metadata) of a document's chunks. Null and blank texts have none.

    Audio is cut by time, and its chunks carry the document's metadata and their times. Of the strategies `llm`, `fast` and token (all
    other names) only `fast` carries the document's metadata.
    """
    if not text or not text.strip():
        return []
    own = dict(metadata or {})
    if kind == "audio":
        return [(t, own | {"timestamp_start": str(a), "timestamp_end": str(b)}) for t, a, b in audio_chunks(text)]
    make = {"llm": segmented_chunks, "fast": semantic_chunks}.get(strategy, token_chunks)
    return [(t, dict(own) if strategy == "fast" else {}) for t in make(text, **options)]


def chunk_table(df: DataFrame, key: str, text: str, strategy: str = "token", kind: str | None = None, metadata: str | None = None) -> DataFrame:
    """(key, index, text, metadata): the chunks of each row, numbered from 0. `kind` names a column with the kind of document, `metadata` one with its map of metadata."""
    type_ = df.schema[key].dataType.simpleString()
    carried = F.to_json(F.col(metadata)) if metadata else F.lit(None).cast("string")
    source = df.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(kind) if kind else F.lit("text")).alias("kind"), carried.alias("m")).where("t is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(k, i, c, m) for k, t, x, own in zip(part["k"], part["t"], part["kind"], part["m"], strict=True) for i, (c, m) in enumerate(chunks_of(t, strategy, x or "text", json.loads(own) if own else None))]
            yield pd.DataFrame(rows, columns=["k", "index", "text", "metadata"])

    return source.mapInPandas(run, f"k {type_}, index int, text string, metadata map<string,string>").withColumnRenamed("k", key)
