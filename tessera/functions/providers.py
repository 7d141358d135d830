"""Models behind interfaces, each with a deterministic default that needs none.

The defaults let every plan run and be tested; they make no claim to a model's quality.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import CONFIG, RELATIONSHIPS
from tessera.functions.chunkers import Words, semantic_chunks, sentences

_WORD = re.compile(r"[^\W_]+")


def hashed_embedding(text: str | None, dims: int = CONFIG.embed_dims) -> list[float]:
    """Signed feature hashing of words, of unit length; null and wordless texts give zeros. Only the first 6,144 characters count, as in the embedding model's own cut."""
    v = np.zeros(dims)
    for w in _WORD.findall((text or "")[: CONFIG.embed_max_tokens * CONFIG.embed_chars_per_token].lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dims] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def overlap_score(query: str | None, passage: str | None) -> float:
    """Share of the query's words in the passage, from 0 to 1."""
    q = set(_WORD.findall((query or "").lower()))
    return len(q & set(_WORD.findall((passage or "").lower()))) / len(q) if q else 0.0


def word_classifier(a: str | None, b: str | None) -> str:
    """A relationship by cue words in the second text; related_to without one."""
    cues = {"contradicts": ("not", "but", "however", "never"), "caused_by": ("because", "since", "therefore"), "example_of": ("example", "e.g", "instance"), "supports": ("also", "as well", "confirms")}
    words = set(_WORD.findall((b or "").lower()))
    return next((r for r in RELATIONSHIPS if r in cues and words & set(cues[r])), "related_to") if a and b else "related_to"


def first_sentences(texts: list[str], n: int = 3) -> str:
    return " ".join(s[0] for t in texts[:n] if (s := sentences(t)))


def common_label(texts: list[str]) -> str:
    """The two commonest longer words, for a label."""
    count: dict[str, int] = {}
    for t in texts:
        for w in set(_WORD.findall(t.lower())):
            if len(w) > 4:
                count[w] = count.get(w, 0) + 1
    best = sorted(count, key=lambda w: (-count[w], w))[:2]
    return " ".join(best).capitalize()


def extractive_answer(question: str | None, context: str | None) -> str:
    """The sentence of the context that shares most words with the question."""
    found = [s for s in sentences(context or "") if not s.startswith(("----", "==="))]
    return max(found, key=lambda s: overlap_score(question, s), default="")


def spoken_evidence(question: str, evidence: str, form: str) -> str:
    """A script without a model: the evidence's sentences, spoken in turn by the voices of the form."""
    said = [s for s in sentences(evidence) if not s.startswith(("----", "==="))]
    voices = {"dialogue": ("ALEX", "SAM"), "interview": ("HOST", "EXPERT")}.get(form)
    return " ".join(said) if voices is None else "\n".join(f"{voices[i % 2]}: {s}" for i, s in enumerate([question, *said]))


@dataclass(frozen=True)
class Providers:
    """All model calls; replace any with a real model."""

    embed: Callable[[str | None], list[float]] = hashed_embedding
    rerank: Callable[[str | None, str | None], float] | None = None
    classify: Callable[[str | None, str | None], str] = word_classifier
    summarise: Callable[[list[str]], str] = first_sentences
    label: Callable[[list[str]], str] = common_label
    answer: Callable[[str | None, str | None], str] = extractive_answer
    segment: Callable[[str], object] = semantic_chunks
    tokenizer: Words = Words()
    transcribe: Callable[[str], list[dict]] | None = None
    describe: Callable[[str], str] | None = None
    ocr: Callable[[str], str] | None = None
    #: (path of a video, seconds between frames) to (second, path of the frame).
    frames: Callable[[str, int], list[tuple[float, str]]] | None = None
    #: Path of an image to its vector; an error or no vector leaves the image out.
    embed_image: Callable[[str], list[float]] | None = None
    #: (summary, texts inside, texts outside) to how well the summary fits, from 0 to 1.
    validate: Callable[[str, list[str], list[str]], float] | None = None
    #: (question, evidence, form) to a script; the default reads the evidence out.
    script: Callable[[str, str, str], str] = spoken_evidence
    #: (speaker, text) to sound.
    speak: Callable[[str, str], bytes] | None = None


def embed_column(df: DataFrame, text: str, out: str = "v", provider: Callable[[str | None], list[float]] = hashed_embedding) -> DataFrame:
    """Embed a column batch by batch; equal texts of a batch are embedded once."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = {t: provider(t) for t in s.unique()}
            yield s.map(known)

    return df.withColumn(out, run(text))


def rerank_column(query: Column, passage: Column, provider: Callable[[str | None, str | None], float]) -> Column:
    """A re-ranker's score, 0 where it fails."""

    def one(q: str | None, p: str | None) -> float:
        try:
            return float(provider(q, p))
        except Exception:
            return 0.0

    @F.pandas_udf(T.DoubleType())
    def run(q: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(q, p, strict=True)])

    return run(query, passage)
