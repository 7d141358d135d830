"""Problem 6: encoding the corpus with a public byte-level BPE vocabulary.

A text is split by the vocabulary's public pattern; each part is merged with a
priority queue of merge ranks over a doubly linked list of symbols. Queue
entries whose symbols have changed since are skipped, so a part of n bytes costs
O(n log n) even where it is one very long run.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import table

#: Where the public vocabulary files lie.
VOCABULARIES = "/opt/tokenizers"
# Fixed value: the public splitting pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts whose ids a worker remembers; beyond it the memory is emptied, which changes no result.
REMEMBERED = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(part: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one part: the pair with the least rank, the leftmost of equals, is merged until none is left."""
    n = len(part)
    sym: list[bytes | None] = [part[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(part[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, size = heapq.heappop(queue)
        a = sym[i]
        if a is None or (j := right[i]) >= n:
            continue
        b = sym[j]
        # stale: one of the two symbols has grown or gone since this entry was made
        if len(a) + len(b) != size:
            continue
        both = a + b
        sym[i], sym[j] = both, None
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get(both + sym[k])) is not None:
                heapq.heappush(queue, (r, i, size + len(sym[k])))
        if (h := left[i]) >= 0 and (r := ranks.get(sym[h] + both)) is not None:
            heapq.heappush(queue, (r, h, len(sym[h]) + size))
    return [ranks[s] for s in sym if s is not None]


class Encoder:
    """Text to ids and back. Text that looks like a special token is ordinary text."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.known = ranks, {}
        self.split = regex.compile(PATTERN).findall

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; of a null and an empty one, none. Lone surrogates become U+FFFD."""
        if not text:
            return []
        known, out = self.known, []
        for part in self.split(text):
            ids = known.get(part)
            if ids is None:
                data = part.encode("utf-8", "replace")
                ids = [r] if (r := self.ranks.get(data)) is not None else merge(data, self.ranks)
                if len(part) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "words"):
            self.words = {r: w for w, r in self.ranks.items()}
        return b"".join(self.words[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _encoder(packed: bytes) -> Encoder:
    return Encoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in packed.splitlines() if line.strip())})


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, ids) of each row of `df`; the vocabulary file is read by the driver.

    A vocabulary has a fixed size (under 2 MB), so it is broadcast; executors
    need no file of their own. Null and empty texts have an empty list.
    """
    spark = df.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = [encode(t) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=ends[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str, vocabularies: str = VOCABULARIES) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return encode_column(docs, "doc_id", "text", os.path.join(vocabularies, "byte_bpe_50k.tiktoken"))
