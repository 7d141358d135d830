"""Problem 1: near-duplicate records with small edits.

Two texts are linked when their sets of word shingles have a Jaccard similarity
of at least t. The join loses no link:

* texts with equal shingle sets become one class, so copies cost nothing;
* two sets of at least that similarity share a shingle among the rarest
  (1 - t) * size + 1 of each, so only those shingles lead to a bucket. A set's place for a
  shingle in the order by rarity bounds what can follow it, and so the sizes a partner may have: rows
  that no other row of their bucket can be linked with go before anything is compared;
* inside a bucket each text is a bit sketch (for each bit, the parity of the
  shingles hashed to it). Sets that differ in d shingles differ in at most d bits, and
  d <= (a + b) * (1 - t) / (1 + t) for linked sets of sizes a and b: an error budget.
  The sketches form a binary trie. Pairs of its nodes are walked together from
  the root, differing bits add up, and a pair over its budget is dropped
  with all that is below it;
* what is left is checked on the exact sets.

All tries of a task are one sorted array and the walk goes level by level over
arrays of node pairs, so nothing is done per pair in Python. Shingles travel in packed rows, one for
each batch of texts and partition, in which a text's sketch stands once. With many partitions a sketch goes
with nearly every shingle; so postings are shuffled and joined in rounds, some partitions at a time, and
between them only the rarest shingles of each text are kept. Sets are never kept: texts are shingled again when they are needed.

Copies of a set come out once for each task that reads one, and are seen to be one where they meet.

Buckets of over MIDDLE blocks, and those of over SMALL texts in which many pairs are candidates, are never paired in full. They are cut into blocks, and in a block
union-find keeps only a spanning forest of its verified links. First each text is joined in two
buckets, whose blocks share two texts; this makes one component of a group of near-copies. Buckets of one
component are then done. In others a text stays only if enough of its shingles
occur in the bucket again to be linked at all, which ends buckets of a common phrase, and texts outside the largest component of what is left
meet the other blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.filters import SLICES, filter_of, gathered, may_hold
from tessera.operators.components import components
from tessera.operators.skew import lookup
from tessera.plans.durable import durable, release
from tessera.sources.tables import table

_WORD = re.compile(r"[^\W_]+")
#: Bytes of the sketch that the trie is made of, and of the wide one that sets of over WIDE_FROM shingles have as well; the narrow is the wide one folded.
NARROW, WIDE, WIDE_FROM = 24, 72, 128
#: Most counters of the frequency sketch that orders shingles; smaller inputs have fewer. One byte each when broadcast: 16 MB.
MOST_COUNTERS = 1 << 24
#: Texts of a bucket whose candidates are listed as pairs, and texts that are joined in one block beyond.
SMALL, BLOCK = 128, 2048
#: Blocks of a bucket that is still joined in one task, where few of its pairs are candidates.
MIDDLE = 64
#: Postings in one task, about 15 MB.
POSTINGS_PER_TASK = 750_000
#: Bytes of a shingle that are its key; what shares one by chance is seen not to be linked.
KEY = 6
#: Bytes of postings that are shuffled at once, at least; else one and a half times what the texts' rarest shingles take.
LEAST_ROUND = 1 << 27
#: Node pairs and rows that are walked at once.
PAIRS, ROWS = 1 << 18, 1 << 15
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: The byte of a word that each byte stands for: ASCII letters in lower case, digits, all of other scripts; 0 between words.
_BYTE = np.array([ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else i if i > 127 else 0 for i in range(256)], dtype=np.uint8)
#: A number for each place in a word and each byte there, and 0 between words; longer words are hashed one by one.
_LONG = 64
_VALUE = _mix(np.arange(1, _LONG * 256 + 1, dtype=np.uint64) * _M1)
_VALUE[::256] = 0
#: Bytes of text that are looked at at once.
_BYTES = 1 << 20


def _plain(text: str) -> bytes:
    """The text's words in bytes, parted by bytes that are 0 in _BYTE."""
    return text.encode() if text.isascii() else " ".join(_WORD.findall(text.lower())).encode("utf-8", "surrogatepass")


class Shingler:
    """Texts to the sorted 64-bit hashes of their distinct runs of `width` words; none for a text under `least` words."""

    def __init__(self, width: int, least: int) -> None:
        self.width, self.least = width, max(least, width)

    def __call__(self, texts: list[str | None]) -> tuple[list[int], list[np.ndarray]]:
        """Places of the texts that take part, and the set of each."""
        at: list[int] = []
        sets: list[np.ndarray] = []
        group: list[tuple[int, bytes]] = []
        held = 0
        for i, text in enumerate(texts):
            if text:
                group.append((i, _plain(text)))
                held += len(group[-1][1]) + 1
                if held > _BYTES:
                    self._add(group, at, sets)
                    group, held = [], 0
        if group:
            self._add(group, at, sets)
        return at, sets

    def _add(self, group: list[tuple[int, bytes]], at: list[int], sets: list[np.ndarray]) -> None:
        joined = b" ".join(x for _, x in group) + b" "
        c = _BYTE[np.frombuffer(joined, dtype=np.uint8)]
        inside = np.concatenate([[False], c > 0])
        first = np.flatnonzero(inside[1:] & ~inside[:-1])
        last = np.flatnonzero(inside[:-1] & ~inside[1:])
        if not len(first):
            return
        # blanks after a word count as 0, so each byte may belong to the word before it
        place = np.arange(len(c)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(c)]])))
        h = np.add.reduceat(_VALUE[np.minimum(place, _LONG - 1) * 256 + c], first)
        for k in np.flatnonzero(last - first > _LONG).tolist():
            h[k] = _long_word(c[first[k] : last[k]].tobytes())
        words = np.diff(np.searchsorted(first, np.concatenate([[0], np.cumsum([len(x) + 1 for _, x in group])])))
        keep = words >= self.least
        h, words = h[np.repeat(keep, words)], words[keep]
        n = max(0, len(h) - self.width + 1)
        if not len(words):
            return
        out = np.zeros(n, dtype=np.uint64)
        for i in range(self.width):
            out = _mix(out * _M1 + h[i : i + n] + np.uint64(i))
        at += [i for (i, _), ok in zip(group, keep.tolist(), strict=True) if ok]
        # runs that cross from one text into the next are not looked at
        ends = np.cumsum(words)
        for b, w in zip(ends.tolist(), words.tolist(), strict=True):
            s = out[b - w : b - self.width + 1]
            s.sort()
            sets.append(s[np.concatenate([_TRUE, s[1:] != s[:-1]])])


_TRUE = np.ones(1, bool)


def _long_word(word: bytes) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(word))


def parity_sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set and bit, whether an odd number of shingles is hashed to it: narrow sketches of all sets, and wide ones."""
    bits = WIDE * 8
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = (_mix(flat * _M2) % np.uint64(bits)).astype(np.int64) + row * bits
    wide = np.packbits((np.bincount(at, minlength=len(sets) * bits) & 1).astype(np.uint8)).reshape(len(sets), WIDE)
    return np.bitwise_xor.reduce(wide.reshape(len(sets), WIDE // NARROW, NARROW), axis=1), wide


def prefix_size(size: int, t: float) -> int:
    """How many of the rarest shingles of a set must be looked up so that no linked set is missed."""
    return size - int(np.ceil(t * size - 1e-9)) + 1


def _budget(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    return np.floor((a + b) * (1 - t) / (1 + t) + 1e-9).astype(np.int64)


class Rows:
    """Rows of buckets that are joined: a bucket number, a sketch, the set's size, and what else decides about pairs.

    place: how many rarer shingles the set has than the bucket's; a linked pair is kept in the bucket
    of its first common shingle at least, so a place too far back drops it elsewhere. part: a component per row, and rows known
    to be connected are not paired. side: only rows of different sides are. wide: sketches of larger sets, by row, in `wide_at`
    (-1 for none).
    """

    def __init__(self, bucket, sketch, size, place=None, part=None, side=None, wide=None, wide_at=None) -> None:  # noqa: ANN001
        words = np.ascontiguousarray(sketch).view(">u8").reshape(len(sketch), sketch.shape[1] // 8)
        self.order = np.lexsort((*words.T[::-1], bucket))
        self.words = np.ascontiguousarray(words[self.order])
        self.bucket, self.sketch, self.size = bucket[self.order], sketch[self.order], size[self.order].astype(np.int64)
        self.place, self.part, self.side, self.wide_at = (None if x is None else x[self.order] for x in (place, part, side, wide_at))
        self.wide = None if wide is None else np.ascontiguousarray(wide).view(np.uint64).reshape(len(wide), wide.shape[1] // 8)
        self.first = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1]])) if len(self.order) else np.zeros(0, np.int64)
        self.last = np.append(self.first[1:], len(self.order)) if len(self.order) else self.first


def trie_join(rows: Rows, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket whose sketches differ within their budget, as arrays of row numbers.

    The trie is the sorted order of (bucket, sketch): a node is a range of rows
    that agree on all bits so far, and the first level below the root is the bucket.
    """
    keep = rows.last - rows.first > 1
    first, last = rows.first[keep], rows.last[keep]
    if not len(first):
        return
    most = np.maximum.reduceat(rows.size, rows.first)[keep]
    top = _budget(most, most, t)
    # some buckets at a time, so that what is kept of a level is small
    at = 0
    while at < len(first):
        upto = max(at + 1, int(np.searchsorted(last, first[at] + ROWS, "right")))
        yield from _walk(rows, first[at:upto], last[at:upto], top[at:upto], t)
        at = upto


def _walk(rows: Rows, first: np.ndarray, last: np.ndarray, top: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    base, upto = int(first[0]), int(last[-1])
    sketch, bits = rows.sketch[base:upto], rows.sketch.shape[1] * 8
    zeros_of: dict[int, np.ndarray] = {}
    part = None if rows.part is None else rows.part[base:upto]
    run = None if part is None else np.concatenate([[0], np.cumsum(part[1:] != part[:-1])])
    first, last = first - base, last - base
    # frontier: ranges of the two nodes, bits that differ so far, the bucket's largest budget, the next bit
    stack = [(first, last, first, last, np.zeros(len(first), dtype=np.int64), top, 0)]
    while stack:
        a0, a1, b0, b1, diff, top, bit = stack.pop()
        if len(a0) > PAIRS:
            half = len(a0) // 2
            stack += [tuple(x[:half] for x in (a0, a1, b0, b1, diff, top)) + (bit,), tuple(x[half:] for x in (a0, a1, b0, b1, diff, top)) + (bit,)]
            continue
        if run is not None and bit % 16 == 0:
            # a pair of nodes all of whose rows are known to be connected has nothing to add
            one = (run[a0] == run[a1 - 1]) & (run[b0] == run[b1 - 1]) & (part[a0] == part[b0])
            a0, a1, b0, b1, diff, top = (x[~one] for x in (a0, a1, b0, b1, diff, top))
        small = (a1 - a0) * (b1 - b0) <= 16
        if bit >= bits:
            small[:] = True
        if small.any():
            yield from _leaves(rows, a0[small] + base, a1[small] + base, b0[small] + base, b1[small] + base, t)
        if small.all():
            continue
        a0, a1, b0, b1, diff, top = (x[~small] for x in (a0, a1, b0, b1, diff, top))
        if (zeros := zeros_of.get(bit)) is None:
            zeros = zeros_of[bit] = np.concatenate([[0], np.cumsum((sketch[:, bit >> 3] >> (7 - (bit & 7)) & 1) == 0)])
        # rows of a node are sorted, so those with a 0 in this bit come first
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        cross = ~((a0 == b0) & (a1 == b1))
        nxt = [
            (a0, am, b0, bm, diff, top),
            (am, a1, bm, b1, diff, top),
            (a0, am, bm, b1, diff + 1, top),
            tuple(x[cross] for x in (am, a1, b0, bm, diff + 1, top)),
        ]
        cols = [np.concatenate(c) for c in zip(*nxt, strict=True)]
        alive = (cols[0] < cols[1]) & (cols[2] < cols[3]) & (cols[4] <= cols[5])
        alive &= ~((cols[0] == cols[2]) & (cols[1] == cols[3]) & (cols[1] - cols[0] == 1))
        if alive.any():
            stack.append(tuple(c[alive] for c in cols) + (bit + 1,))


def _leaves(rows: Rows, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of small nodes, checked on whole sketches."""
    na, nb = a1 - a0, b1 - b0
    total = na * nb
    twins = (a0 == b0) & (a1 == b1)
    at = 0
    while at < len(total):
        upto = at + max(1, int(np.searchsorted(np.cumsum(total[at:]), PAIRS, "right")))
        n = total[at:upto]
        which = np.repeat(np.arange(at, upto), n)
        off = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        row, col = np.divmod(off, nb[which])
        i, j = a0[which] + row, b0[which] + col
        at = upto
        # pairs of one node with itself have each pair twice; pairs of two nodes have it once, in either order
        ok = (i < j) | ~twins[which] & (i != j)
        if rows.part is not None:
            ok &= rows.part[i] != rows.part[j]
        if rows.side is not None:
            ok &= rows.side[i] != rows.side[j]
        i, j = i[ok], j[ok]
        si, sj = rows.size[i], rows.size[j]
        ok = np.minimum(si, sj) >= t * np.maximum(si, sj) - 1e-9
        if rows.place is not None:
            ok &= np.minimum(si - rows.place[i], sj - rows.place[j]) >= (si + sj) * (t / (1 + t)) - 1e-9
        i, j, si, sj = i[ok], j[ok], si[ok], sj[ok]
        if not len(i):
            continue
        most = _budget(si, sj, t)
        ok = np.bitwise_count(rows.words[i] ^ rows.words[j]).sum(1, dtype=np.int64) <= most
        i, j, most = i[ok], j[ok], most[ok]
        if rows.wide is not None and len(i):
            wi, wj = rows.wide_at[i], rows.wide_at[j]
            both = np.flatnonzero((wi >= 0) & (wj >= 0))
            far = np.bitwise_count(rows.wide[wi[both]] ^ rows.wide[wj[both]]).sum(1, dtype=np.int64) > most[both]
            ok = np.ones(len(i), bool)
            ok[both[far]] = False
            i, j = i[ok], j[ok]
        if len(i):
            yield rows.order[i], rows.order[j]


# ---- stages


def _arrow(names: str, *cols: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols), names=names.split())


def _digests(sets: list[np.ndarray]) -> list[bytes]:
    """Two independent sums of each set: 128 bits that are equal for equal sets."""
    if not sets:
        return []
    flat = np.concatenate(sets)
    first = np.cumsum([0] + [len(x) for x in sets[:-1]])
    sums = np.stack([np.add.reduceat(_mix(flat * m), first) for m in (_M1, _M3)], axis=1).tobytes()
    return [sums[i : i + 16] for i in range(0, len(sums), 16)]


def _fresh(shingle: Shingler, seen: set[bytes], texts: list[str | None]) -> tuple[list[int], list[bytes], list[np.ndarray], list[bool]]:
    """Places, digests and sets of the texts that take part, and whether this task hasn't seen the set."""
    at, sets = shingle(texts)
    digest = _digests(sets)
    if len(seen) > 1_000_000:
        seen.clear()
    new = []
    for d in digest:
        new.append(d not in seen)
        seen.add(d)
    return at, digest, sets, new


_DIGESTED = "digest binary, n int, slice int, counts binary"


def _digested(width: int, least: int, counters: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest) of each text, with the size of sets that the task hasn't seen before; at last what it counted of their shingles."""
    shingle = Shingler(width, least)
    seen: set[bytes] = set()
    count = np.zeros(counters, dtype=np.uint32)
    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            places, digest, sets, new = _fresh(shingle, seen, part.column(1).to_pylist())
            if not sets:
                continue
            if any(new):
                slot, n = np.unique(np.concatenate([s for s, ok in zip(sets, new, strict=True) if ok]) & np.uint64(counters - 1), return_counts=True)
                count[slot.astype(np.int64)] += n.astype(np.uint32)
            size = [len(s) if ok else None for s, ok in zip(sets, new, strict=True)]
            k = len(sets)
            yield _arrow("id digest n slice counts", part.column(0).take(pa.array(places, pa.int64())), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()))
    if kind is None:
        return
    for i, x in enumerate(np.minimum(count, 65535).astype(np.uint16).reshape(SLICES, -1)):
        if len(at := np.flatnonzero(x)):
            # only the counters that aren't 0, with their places
            raw = at.astype(np.uint16).tobytes() + x[at].tobytes()
            yield _arrow("id digest n slice counts", pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([i], pa.int32()), pa.array([raw], pa.binary()))


def _chosen(width: int, least: int, marks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """(digest, shingles) of the texts (mark, text) whose mark may be among the marked ones."""
    shingle, marks = Shingler(width, least), marks.value
    seen: set[bytes] = set()
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.filter(pa.array(may_hold(marks, batch.column(0).to_pylist())))
        for at in range(0, batch.num_rows, 2048):
            _, digest, sets, new = _fresh(shingle, seen, batch.column(1).slice(at, 2048).to_pylist())
            rows = [(d, s.tobytes()) for d, s, ok in zip(digest, sets, new, strict=True) if ok]
            if rows:
                yield _arrow("digest shingles", *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True)))


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint64)


def _passing(marks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Rows whose digest, the first column, may be among the marked ones."""
    marks = marks.value
    for batch in batches:
        if batch.num_rows:
            yield batch.filter(pa.array(may_hold(marks, batch.column(0).to_pylist())))


def _mark(c: str) -> F.Column:
    return F.unhex(F.md5(F.col(c).cast("string").cast("binary")))


def sets_of(raw: DataFrame, named: DataFrame, digests: DataFrame, width: int, least: int) -> DataFrame:
    """(digest, shingles) of the sets that `digests` names, and few others, made anew from their texts.

    raw: id, text. named: digest, id. Filters of bounded size choose an id for each digest and then its text, so that
    neither sets nor texts need be kept or shuffled.
    """
    sc = raw.sparkSession.sparkContext
    kind = named.schema["id"].dataType.simpleString()
    likely = named.mapInArrow(partial(_passing, sc.broadcast(filter_of(digests))), f"digest binary, id {kind}")
    ids = durable(likely.groupBy("digest").agg(F.min("id").alias("id")).select(_mark("id").alias("mark")))
    texts = raw.select(_mark("id").alias("mark"), "text")
    return texts.mapInArrow(partial(_chosen, width, least, sc.broadcast(filter_of(ids))), "digest binary, shingles binary")


def _summed(width: int, part: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(width, dtype=np.int64)
    for x in part["counts"]:
        at, n = np.frombuffer(x, dtype=np.uint16).reshape(2, -1)
        total[at] += n
    return pd.DataFrame({"slice": part["slice"][:1], "ranks": [rank_of(total).tobytes()]})


def rank_of(count: np.ndarray) -> np.ndarray:
    """Counts on a scale of one byte that keeps their order: 0 for at most one, then eight steps for each doubling."""
    return np.where(count <= 1, 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(count, 1))))).astype(np.uint8)


def shingle_ranks(counts: DataFrame, counters: int) -> np.ndarray:
    """How frequent the shingles of each counter are together, by `rank_of`: a table of fixed size, from what the tasks counted (slice, counts).

    Only the order by rarity and what is certainly a shingle of one text are taken from it, so its noise costs time but no link.
    """
    return gathered(counts, partial(_summed, counters // SLICES), counters)


_RARE = "digest binary, size int, keys binary, narrow binary, wide binary, hot_key long, hot_code binary, hot_size int, hot_place int"


def _rare(width: int, least: int, ranks, t: float, hot_rank: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """The rarest shingles of each text's set in the order by rarity, KEY bytes each, with its sketches; those that may be in a large share of all texts come out one by one.

    A shingle that comes out so, or that was counted once and so stands in no other set, leaves a 0 in its place.
    """
    shingle, rank = Shingler(width, least), ranks.value
    seen: set[bytes] = set()
    names = _RARE.replace(" binary", "").replace(" int", "").replace(" long", "").replace(",", "")
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            _, digest, sets, new = _fresh(shingle, seen, batch.column(0).slice(at, 2048).to_pylist())
            digest, sets = ([x for x, ok in zip(c, new, strict=True) if ok] for c in (digest, sets))
            if not sets:
                continue
            size = np.array([len(s) for s in sets], dtype=np.int64)
            flat = np.concatenate(sets)
            f = rank[(flat & np.uint64(len(rank) - 1)).astype(np.int64)]
            # sets are sorted and the sort is stable, so shingles of one rank are everywhere in the order of their hashes
            ends = np.cumsum(size)
            want = size - np.ceil(t * size - 1e-9).astype(np.int64) + 1
            where = np.concatenate([b - n_ + f[b - n_ : b].argsort(kind="stable")[:w] for b, n_, w in zip(ends.tolist(), size.tolist(), want.tolist(), strict=True)])
            key = (flat[where] >> np.uint64(64 - 8 * KEY)) | np.uint64(1)
            hot = np.flatnonzero(f[where] >= hot_rank)
            if len(hot):
                k = len(hot)
                row = np.repeat(np.arange(len(sets)), want)[hot]
                place = (np.arange(len(where)) - np.repeat(np.cumsum(want) - want, want))[hot]
                empty = pa.nulls(k, pa.binary())
                yield _arrow(names, empty, pa.nulls(k, pa.int32()), empty, empty, empty, pa.array(key[hot].view(np.int64)), pa.array([digest[r] for r in row.tolist()], pa.binary()), pa.array(size[row].astype(np.int32)), pa.array(place.astype(np.int32)))
            key[(f[where] == 0) | (f[where] >= hot_rank)] = 0
            raw = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :KEY]).tobytes()
            cut = np.concatenate([[0], np.cumsum(want)]) * KEY
            narrow, wide = parity_sketches(sets)
            m = len(sets)
            yield _arrow(names, pa.array(digest, pa.binary()), pa.array(size.astype(np.int32)), pa.array([raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()), pa.array([x.tobytes() for x in narrow], pa.binary()), pa.array([x.tobytes() if n_ > WIDE_FROM else b"" for x, n_ in zip(wide, size.tolist(), strict=True)], pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()))


_PACKED = "p int, key binary, of binary, place binary, code binary, size binary, narrow binary, wide binary"


def _postings(first: int, upto: int, n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts (digest, size, keys, narrow, wide) the shingles that belong to the partitions from `first` to `upto` of n, packed by partition."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            code, size = np.array(part.column(0).to_pylist(), dtype="V16"), part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = part.column(2).to_pylist()
            narrow = np.array(part.column(3).to_pylist(), dtype=f"V{NARROW}")
            wide = np.array(part.column(4).to_pylist(), dtype=f"V{WIDE}")
            want = np.array([len(x) // KEY for x in keys], dtype=np.int64)
            key = np.zeros((int(want.sum()), 8), dtype=np.uint8)
            key[:, :KEY] = np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(-1, KEY)
            key = key.view(np.uint64).ravel()
            to = (_mix(key * _M3) % np.uint64(n)).astype(np.int64)
            mine = np.flatnonzero((key > 0) & (to >= first) & (to < upto))
            if not len(mine):
                continue
            row = np.repeat(np.arange(len(keys)), want)[mine]
            place = mine - (np.cumsum(want) - want)[row]
            key, to = key[mine], to[mine] - first
            order = np.argsort(to, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) > 0, [True]]))
            cols: list[list] = [[] for _ in range(8)]
            for a, b in zip(cut[:-1], cut[1:]):  # noqa: B905
                o = order[a:b]
                # rows go up in `order`
                r = row[o]
                new = np.concatenate([_TRUE, r[1:] != r[:-1]])
                rows, of = r[new], np.cumsum(new) - 1
                big = rows[size[rows] > WIDE_FROM]
                for c, x in zip(cols, (int(to[o[0]]), key[o], of.astype(np.uint16), np.minimum(place[o], 65535).astype(np.uint16), code[rows], size[rows].astype(np.uint32), narrow[rows], wide[big]), strict=True):
                    c.append(x if isinstance(x, int) else x.tobytes())
            yield _arrow(_PACKED.replace(" binary", "").replace(" int", "").replace(",", ""), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:]))


def prune(key: np.ndarray, size: np.ndarray, place: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows, by bucket, that some other row of their bucket may be linked with, and how many those are in each row's bucket.

    A linked set has at most size - place shingles in common from the bucket's on, which bounds
    its partner's size from above; from below the similarity bounds it.
    """
    order = np.argsort(key, kind="stable")
    while True:
        k, n, p = key[order], size[order], place[order]
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        if not len(first):
            return order, np.zeros(0, np.int64)
        group = np.cumsum(new) - 1
        held = np.diff(np.append(first, len(k)))
        upto = np.floor((n - p) * (1 + t) / t + 1e-9).astype(np.int64) - n
        ok = (held[group] > 1) & (np.minimum.reduceat(n, first)[group] <= upto) & (np.maximum.reduceat(upto, first)[group] >= n)
        if ok.all():
            return order, held[group]
        order = order[ok]


_FOUND = "a binary, b binary, key long, code binary"


def _joined(t: float, small: int, middle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) of the buckets in a partition, each pair once per partition, and the postings (key, code) of large ones.

    A bucket of over `small` texts is large if it has over `middle`, or over small / 4 candidates for each of its texts.
    """
    got: list[list[np.ndarray]] = [[] for _ in range(7)]
    kinds = (np.uint64, np.uint16, np.uint16, "V16", np.uint32, np.uint8, np.uint8)
    held = 0
    for batch in batches:
        for raws in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            for g, raw, kind in zip(got, raws, kinds, strict=True):
                g.append(np.frombuffer(raw, dtype=kind))
            got[1][-1] = got[1][-1].astype(np.int64) + held
            held += len(got[3][-1])
    if not held:
        return
    key, of, place, code, size, narrow, wide = (np.concatenate(g) for g in got)
    size, place = size.astype(np.int64), place.astype(np.int64)
    narrow, wide = narrow.reshape(-1, NARROW), wide.reshape(-1, WIDE)
    wide_at = np.where(size > WIDE_FROM, np.cumsum(size > WIDE_FROM) - 1, -1)
    # a set that several tasks had is one row of each bucket
    halves = code.view(np.uint64).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    new = np.concatenate([[True], (halves[order[1:]] != halves[order[:-1]]).any(1)])
    if not new.all():
        first = np.empty(len(code), dtype=np.int64)
        first[order] = order[new][np.cumsum(new) - 1]
        of = first[of]
        o = np.lexsort((of, key))
        o = o[np.concatenate([[True], (key[o[1:]] != key[o[:-1]]) | (of[o[1:]] != of[o[:-1]])])]
        key, of, place = key[o], of[o], place[o]
    rows, n = prune(key, size[of], place, t)
    key, of, place = key[rows], of[rows], place[rows]
    found, large = [np.zeros(0, np.int64)], [np.flatnonzero(n > middle)]

    def candidates(x: np.ndarray) -> Iterator[np.ndarray]:
        for i, j in trie_join(Rows(key[x], narrow[of[x]], size[of[x]], place[x], wide=wide, wide_at=wide_at[of[x]]), t):
            a, b = of[x[i]], of[x[j]]
            # sets with two shingles of one key meet themselves
            a, b = a[a != b], b[a != b]
            yield np.unique(np.minimum(a, b) * len(code) + np.maximum(a, b))

    found += candidates(np.flatnonzero(n <= small))
    some = np.flatnonzero((n > small) & (n <= middle))
    ends = np.append(np.flatnonzero(np.diff(key[some])) + 1, len(some))
    for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        own, most = [], (b - a) * (small // 4)
        for x in candidates(some[a:b]):
            own.append(x)
            most -= len(x)
            if most < 0:
                large.append(some[a:b])
                break
        else:
            found += own
    for r in large:
        for at in range(0, len(r), 100_000):
            x = r[at : at + 100_000]
            none = pa.nulls(len(x), pa.binary())
            yield _arrow("a b key code", none, none, pa.array(key[x].view(np.int64)), pa.array([c.tobytes() for c in code[of[x]]], pa.binary()))
    a, b = np.divmod(np.unique(np.concatenate(found)), len(code))
    for at in range(0, len(a), 100_000):
        ends = [[x.tobytes() for x in code[c[at : at + 100_000]]] for c in (a, b)]
        k = len(ends[0])
        yield _arrow("a b key code", pa.array(map(min, *ends), pa.binary()), pa.array(map(max, *ends), pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()))


def similar(a: np.ndarray, b: np.ndarray, t: float) -> bool:
    """Exact test of two sorted arrays of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= t * (len(a) + len(b) - both) - 1e-9


def _verified(t: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, sa, sb = (batch.column(i) for i in range(4))
        mask = pa.array([similar(_set(x), _set(y), t) for x, y in zip(sa.to_pylist(), sb.to_pylist(), strict=True)], pa.bool_())
        yield _arrow("a b", a.filter(mask), b.filter(mask))


def _block(t: float, part: pd.DataFrame) -> pd.DataFrame:
    """Verified links of one block (or of one side of it with the other) that join what isn't joined yet."""
    code = part["code"].to_numpy()
    sets = [_set(x) for x in part["shingles"]]
    narrow, wide = parity_sketches(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    known = part["root"].to_numpy() if "root" in part else None
    side = part["side"].to_numpy() if "side" in part else None
    parent = list(range(len(code)))
    if known is not None:
        seen: dict[int, int] = {}
        for i, r in enumerate(known.tolist()):
            parent[i] = seen.setdefault(r, i)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    label = np.array([root(x) for x in range(len(code))])
    rows = Rows(np.zeros(len(code), dtype=np.int64), narrow, size, part=known, side=side, wide=wide, wide_at=np.arange(len(size)))
    for i, j in trie_join(rows, t):
        for at in range(0, len(i), 4096):
            # pairs that links found before have connected are dropped as arrays, not one by one
            x_all, y_all = i[at : at + 4096], j[at : at + 4096]
            open_ = label[x_all] != label[y_all]
            before = len(out)
            for x, y in zip(x_all[open_].tolist(), y_all[open_].tolist(), strict=True):
                if (p := root(x)) != (q := root(y)) and similar(sets[x], sets[y], t):
                    parent[p] = q
                    out.append((code[x], code[y]))
            if len(out) > before:
                label = np.array([root(x) for x in range(len(code))])
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _able(posts: DataFrame, t: float) -> DataFrame:
    """(key, digest) of the postings that aren't packed, without those that no other of their bucket may be linked with (see `prune`)."""
    upto = F.floor((F.col("hot_size") - F.col("hot_place")) * ((1 + t) / t) + 1e-9) - F.col("hot_size")
    rows = durable(posts.where("hot_key is not null").select(F.col("hot_key").alias("key"), F.col("hot_code").alias("digest"), F.col("hot_size").alias("size"), upto.alias("upto")))
    bound = rows.groupBy(F.col("key").alias("k")).agg(F.min("size").alias("lo"), F.max("upto").alias("hi"))
    return lookup(rows, "key", bound, "k").where("lo <= upto and hi >= size").select("key", "digest")


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    return lookup(durable(rows), "code", sets.select(F.col("code").alias("k"), "shingles"), "k")


def _blocks(rows: DataFrame, t: float, *by: str) -> DataFrame:
    cols = [*by, *(c for c in ("code", "shingles", "root", "side") if c in rows.columns)]
    return rows.select(*cols).groupBy(*by).applyInPandas(lambda part: _block(t, part), "a long, b long")


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the component of their code, of buckets that still have several; n is the bucket's rows."""
    label = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = lookup(rows, "code", label.withColumnRenamed("id", "k").withColumnRenamed("root", "r"), "k", how="left").withColumn("root", F.coalesce("r", "code")).drop("r")
    return _several(named)


def _several(rows: DataFrame) -> DataFrame:
    rows = durable(rows.select("key", "code", "root"))
    per = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("key").alias("k"), "n")
    return durable(lookup(rows, "key", per, "k"))


def _verify(pairs: DataFrame, needed: DataFrame, t: float) -> DataFrame:
    """The pairs (a, b), by number, whose sets are similar."""
    a = needed.select(F.col("code").alias("a"), F.col("shingles").alias("sa"))
    b = needed.select(F.col("code").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(partial(_verified, t), "a long, b long")


def _small_links(pairs: DataFrame, needed: DataFrame, t: float) -> DataFrame:
    """Verified links of candidates (a, b), by digest: all that are needed to join what is linked.

    Where there are many candidates for each text, one of each text is looked at first, and of the others
    only those whose ends that hasn't joined.
    """
    for end in ("a", "b"):
        pairs = pairs.join(needed.select(F.col("digest").alias(end), F.col("code").alias(f"{end}_code")), end)
    pairs = durable(pairs.select(F.least("a_code", "b_code").alias("a"), F.greatest("a_code", "b_code").alias("b")))
    if pairs.count() <= 4 * needed.count():
        return _verify(pairs, needed, t)
    links = durable(_verify(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), needed, t))
    label = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("id", "k")
    named = lookup(lookup(pairs, "a", label.withColumnRenamed("root", "ra"), "k", how="left"), "b", label.withColumnRenamed("root", "rb"), "k", how="left")
    rest = durable(named.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
    return links.unionByName(_verify(rest, needed, t))


def _large_links(posts: DataFrame, sets: DataFrame, t: float, block: int) -> DataFrame:
    """Verified links found in large buckets: posts has key, code; the links join all that is linked there."""
    from pyspark.sql.window import Window

    per = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k")
    rows = durable(lookup(posts.select("key", "code"), "key", per, "k"))
    blocks = F.ceil(F.col("n") / block)
    # each text goes into two buckets at first, and two texts of a bucket into all its blocks
    h = F.struct(F.xxhash64("key").alias("h"), "key", "n")
    seed = rows.groupBy("code").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).select("code", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("s")).select("s.key", "code", "s.n")
    seed = durable(seed)
    x = F.struct(F.xxhash64("code").alias("h"), "code")
    pivot = seed.where(F.col("n") > block).groupBy("key").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.first("n").alias("n"))
    pivot = pivot.select("key", "n", F.explode(F.array("lo.code", "hi.code")).alias("code")).select("key", "code", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))).alias("block"))
    placed = seed.select("key", "code", F.pmod(F.xxhash64("code"), blocks).alias("block")).unionByName(pivot).distinct()
    links = durable(_blocks(_with_sets(placed, sets), t, "key", "block").distinct())
    left = _rooted(rows, links)
    if not left.limit(1).count():
        return links
    # buckets of one block are joined as they are
    links = durable(links.unionByName(_blocks(_with_sets(left.where(F.col("n") <= block), sets), t, "key")))
    over = left.where(F.col("n") > block)
    if not over.limit(1).count():
        return links
    # of the others those texts stay of whose shingles enough occur again in the bucket
    token = F.explode(F.expr("transform(sequence(0, cast(length(shingles) / 8 as int) - 1), i -> substring(shingles, i * 8 + 1, 8))"))
    spelled = _with_sets(over.select("key", "code"), sets).select("key", "code", F.length("shingles").alias("bytes"), token.alias("token"))
    again = spelled.groupBy("key", "token").agg(F.count("*").alias("c")).where("c > 1").select("key", "token")
    enough = spelled.join(again, ["key", "token"]).groupBy("key", "code").agg(F.count("*").alias("c"), F.first("bytes").alias("bytes")).where(F.col("c") >= F.ceil(F.col("bytes") / 8 * t - 1e-9)).select("key", "code")
    over = _several(over.select("key", "code", "root").join(enough, ["key", "code"], "left_semi"))
    links = durable(links.unionByName(_blocks(_with_sets(over.where(F.col("n") <= block), sets), t, "key")))
    rest = over.where(F.col("n") > block)
    if not rest.limit(1).count():
        return links
    # the largest component of a bucket stays in place; all other texts visit each block, in groups that are bounded too
    rest = rest.withColumn("block", F.pmod(F.xxhash64("code"), blocks))
    size = rest.groupBy("key", "root").agg(F.count("*").alias("m"))
    largest = size.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("m"), "root"))).where("r = 1").select(F.col("key").alias("k"), F.col("root").alias("main"), F.col("m").alias("most"))
    rest = lookup(rest, "key", largest, "k")
    groups = F.ceil((F.col("n") - F.col("most")) / block)
    visit = rest.where("root <> main").withColumn("party", F.pmod(F.xxhash64("code", F.lit(1)), groups)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))))
    stay = rest.withColumn("party", F.explode(F.sequence(F.lit(0).cast("long"), (groups - 1).cast("long"))))
    meet = stay.withColumn("side", F.lit(0)).unionByName(visit.withColumn("side", F.lit(1))).select("key", "code", "root", "block", "party", "side")
    outer = _blocks(_with_sets(meet, sets), t, "key", "block", "party")
    return links.unionByName(outer.where("a <> b"))


def classes(df: DataFrame, id: str, text: str, width: int = 5, t: float = 0.8, least: int = 0, block: int = BLOCK, small: int = SMALL, counters: int = MOST_COUNTERS, least_round: int = LEAST_ROUND) -> DataFrame:
    """(id, class_id, n_class) of every id whose text takes part: near-duplicates, directly or through others, share a class.

    Texts with fewer than `least` words (or than `width`) and null texts take no
    part. Repeated rows and ids delivered twice count once; an id delivered with
    different texts is one vertex with all of them. class_id is the least id of
    its class; a text without near-duplicates is a class of one. `block`, `small`, `counters` and `least_round` bound memory and disk and change no row.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    raw = df.select(F.col(id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    kind = raw.schema["id"].dataType.simpleString()
    # an upper bound of usual texts' words, so that they are counted while they are read for the first time
    chars = raw.agg(F.sum(F.length("text"))).first()[0] or 0
    counters = min(counters, 1 << max(16, int(chars // 5).bit_length()))
    # neither texts nor sets are written: what needs them reads the texts again
    read = durable(raw.mapInArrow(partial(_digested, width, least, counters), f"id {kind}, {_DIGESTED}").withColumn("row", F.monotonically_increasing_id()))
    shingled = read.where("digest is not null").select("id", "digest", "row")
    ranks = shingle_ranks(read.where("counts is not null").select("slice", "counts"), counters)
    runs = read.agg(F.sum("n")).first()[0] or 0
    # shingles far above what a counter holds by chance may be in a large share of all texts: these are not packed
    hot_rank = int(rank_of(np.array([max(MIDDLE * block, 8 * runs // counters)]))[0])
    posts = durable(raw.select("text").mapInArrow(partial(_rare, width, least, sc.broadcast(ranks), t, hot_rank), _RARE))
    texts = posts.where("keys is not null").select("digest", "size", "keys", "narrow", "wide")
    # a set's sketch stands in each partition that has one of its shingles, so not all postings are on disk at once
    sums = texts.agg(F.count("*"), F.sum(F.length("keys")), F.sum(F.length("wide"))).first()
    rows, keys, wide = sums[0], (sums[1] or 0) // KEY, sums[2] or 0
    n = max(sc.defaultParallelism, keys // POSTINGS_PER_TASK + 1)
    packed = keys * 12 + int(rows * (20 + NARROW) + wide) * min(n, keys // max(rows, 1) + 1)
    rounds = min(n, -(-packed // max(1, least_round, 3 * (rows * (20 + NARROW) + wide + keys * KEY) // 2)) or 1)
    n = max(n, sc.defaultParallelism * rounds)
    each = -(-n // rounds)
    parts = []
    for first in range(0, n, each):
        upto = min(n, first + each)
        out = texts.mapInArrow(partial(_postings, first, upto, n), _PACKED).repartitionById(upto - first, F.col("p"))
        parts.append(durable(out.select("key", "of", "place", "code", "size", "narrow", "wide").mapInArrow(partial(_joined, t, small, MIDDLE * block), _FOUND)))
    found = reduce(DataFrame.unionByName, parts)
    pairs = durable(found.where("a is not null").select("a", "b").distinct())
    hot = posts.where("hot_key is not null")
    hot = _able(posts, t) if hot.limit(1).count() else hot.select(F.col("hot_key").alias("key"), F.col("hot_code").alias("digest"))
    large = durable(hot.unionByName(found.where("a is null").select("key", F.col("code").alias("digest"))).distinct())
    release(posts, *parts)
    # one class per distinct shingle set; the set's number is that of the first row that has it
    codes = durable(shingled.groupBy(F.col("digest").alias("k")).agg(F.min("row").alias("code")))
    of = durable(lookup(shingled.select("id", "digest").distinct(), "digest", codes, "k").select("id", "code"))
    ends = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).unionByName(large.select(F.col("digest").alias("a"))).distinct()
    needed = sets_of(raw, shingled.select("digest", "id"), durable(ends), width, least).groupBy("digest").agg(F.first("shingles").alias("shingles"))
    needed = durable(needed.join(codes, F.col("digest") == F.col("k")).select("digest", "code", "shingles"))
    release(read, codes)
    links = _small_links(pairs, needed, t)
    if large.limit(1).count():
        known = needed.select(F.col("digest").alias("k"), "code")
        links = links.unionByName(_large_links(durable(lookup(large, "digest", known, "k")), needed.select("code", "shingles"), t, block))
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    # an id with several texts links their sets
    several = of.groupBy("id").agg(F.min("code").alias("u"), F.count("*").alias("m")).where("m > 1")
    if several.limit(1).count():
        edges = edges.unionByName(of.join(several.select("id", "u"), "id").select("u", F.col("code").alias("v")))
    label = components(durable(edges))
    rooted = durable(lookup(of, "code", label.withColumnRenamed("id", "k"), "k", how="left").select("id", F.coalesce("root", "code").alias("root")).distinct())
    group = rooted.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("n_class")).withColumnRenamed("root", "k")
    return lookup(rooted, "root", group, "k").select("id", "class_id", "n_class")


def pairs_of(members: DataFrame, block: int = 1000) -> DataFrame:
    """(a, b), a < b, for any two ids of one class of `members` (id, class_id, n_class).

    Classes meet block by block, so no task holds a whole large class.
    """
    blocks = F.ceil(F.col("n_class") / block).cast("int")
    m = members.where("n_class > 1").select("id", "class_id", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("x"), blocks.alias("k"))
    left = m.select(F.col("id").alias("a"), "class_id", "x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("y"))
    right = m.select(F.col("id").alias("b"), "class_id", F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("x"))
    return left.join(right, ["class_id", "x", "y"]).where("a < b").select("a", "b")


# The parameters that problem 1 names for this project's chunks.
WIDTH, SIMILARITY, LEAST_WORDS = 3, 0.6, 20


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, class_id, n_class) of every chunk with at least 20 words."""
    chunks = table(spark, sf_dir, "chunks", "chunk_id", "text")
    return classes(chunks, "chunk_id", "text", WIDTH, SIMILARITY, LEAST_WORDS).withColumnRenamed("id", "chunk_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_a, chunk_b) of any two chunks of one group."""
    members = durable(p1_classes(spark, sf_dir).withColumnRenamed("chunk_id", "id").where("n_class > 1"))
    return pairs_of(members).select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))
