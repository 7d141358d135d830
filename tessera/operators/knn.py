"""Exact and indexed nearest neighbours.

A stated set of queries meets all rows in blocks: a block of queries, bounded in
number, is broadcast as a matrix, each partition of the rows is multiplied with
it and keeps its k best for each query, and the partitions' lists are merged.
Nothing is shuffled but k rows for each query and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

#: Queries in one block: with 384 dimensions 12 MB.
QUERIES_PER_BLOCK = 4096


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _best(top_sim: np.ndarray, top_id: np.ndarray, sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of what is held and what is new, ties by id; ids are only looked at for what stays and for ties at the end."""
    width = top_sim.shape[1]
    both = np.concatenate([top_sim, sim], axis=1)
    if both.shape[1] <= k:
        return both, np.concatenate([top_id, np.broadcast_to(ids, sim.shape)], axis=1)
    at = np.argpartition(-both, k - 1, axis=1)[:, :k]
    cut = np.take_along_axis(both, at, 1).min(1)
    for r in np.flatnonzero(np.isfinite(cut) & ((both >= cut[:, None]).sum(1) > k)):
        able = np.flatnonzero(both[r] >= cut[r]).tolist()
        at[r] = sorted(able, key=lambda c: (-both[r, c], top_id[r, c] if c < width else ids[c - width]))[:k]
    if not width:
        return np.take_along_axis(both, at, 1), ids[at]
    held = np.take_along_axis(top_id, np.minimum(at, width - 1), 1)
    return np.take_along_axis(both, at, 1), np.where(at < width, held, ids[np.maximum(at - width, 0)])


def _blocks(queries: DataFrame, size: int) -> Iterator[list]:
    held: list = []
    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def knn(queries: DataFrame, rows: DataFrame, k: int, same: str | None = None, floor: float | None = None, drop_self: bool = False, block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """(q, id, sim, rank): the k rows of greatest cosine for each query, ties by id.

    queries: q, v. rows: id, v. Both with the column `same` if given: then only rows
    with an equal value take part. Rows under `floor` don't count; with `drop_self`
    neither does the row whose id is q. Null, empty and zero vectors, and vectors of
    another length than the query's block, match nothing; an empty side gives no rows.
    """
    cols = ["q", "v", *([same] if same else [])]
    picked = queries.select(*cols).where("q is not null and v is not null and size(v) > 0")
    q_kind, id_kind = queries.schema["q"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    schema = f"q {q_kind}, id {id_kind}, sim double"
    q_type, id_type = to_arrow_type(queries.schema["q"].dataType), to_arrow_type(rows.schema["id"].dataType)
    source = rows.select("id", "v", *([same] if same else [])).where("v is not null and size(v) > 0")
    sc = queries.sparkSession.sparkContext
    parts = []
    for held in _blocks(picked, block):
        for dims in sorted({len(r["v"]) for r in held}):
            own = [r for r in held if len(r["v"]) == dims]
            m = np.array([r["v"] for r in own], dtype=np.float64)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            shared = sc.broadcast(([r["q"] for r in own], m / np.where(n > 0, n, 1), (n > 0).ravel(), [r[same] for r in own] if same else None))

            def run(batches: Iterator[pa.RecordBatch], shared=shared, dims=dims) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                keys, m, able, tag = shared.value
                keys_a = np.array(keys, dtype=object)
                top_sim = np.full((len(keys), 0), -np.inf)
                top_id = np.empty((len(keys), 0), dtype=object)
                for batch in batches:
                    long = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False) == dims
                    if not long.any():
                        continue
                    part = batch.filter(pa.array(long))
                    c = _matrix(part.column(1))
                    ids = np.array(part.column(0).to_pylist(), dtype=object)
                    s = m @ c.T
                    dead = ~able[:, None] | (np.abs(c).sum(1) == 0)[None, :]
                    if tag is not None:
                        dead = dead | (np.array(tag, dtype=object)[:, None] != np.array(part.column(2).to_pylist(), dtype=object)[None, :])
                    if drop_self:
                        dead = dead | (keys_a[:, None] == ids[None, :])
                    if floor is not None:
                        dead = dead | (s < floor)
                    s = np.where(dead, -np.inf, s)
                    top_sim, top_id = _best(top_sim, top_id, s, ids, k)
                qi, ci = np.nonzero(np.isfinite(top_sim))
                if len(qi):
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in qi], q_type), pa.array(list(top_id[qi, ci]), id_type), pa.array(top_sim[qi, ci])], names=["q", "id", "sim"])

            parts.append(source.mapInArrow(run, schema))
    if not parts:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def duplicates(queries: DataFrame, rows: DataFrame, threshold: float, same: str | None = None) -> DataFrame:
    """(q, id, sim) of the queries whose nearest other row is at least `threshold` similar."""
    return knn(queries, rows, 1, same, threshold, drop_self=True).select("q", "id", "sim")


class CellIndex:
    """Vectors in cells around centres that are fitted on a bounded sample; all rows are assigned.

    A query looks into the `probes` cells whose centres are nearest. Rows stay where
    they are (the cell is a column), so a cell that holds a third of all rows is
    no hot key.
    """

    def __init__(self, centres: np.ndarray) -> None:
        self.centres = centres

    @classmethod
    def fit(cls, rows: DataFrame, cells: int = 64, sample: int = 20_000, rounds: int = 8, seed: int = 7) -> CellIndex:
        """k-means on at most `sample` rows, taken by hash of the id so that every run gets the same."""
        v = np.array([r[0] for r in rows.where("v is not null and size(v) > 0").orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).select("v").collect()], dtype=np.float64)
        if not len(v):
            return cls(np.zeros((1, 1)))
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(seed)
        centres = v[rng.choice(len(v), min(cells, len(v)), replace=False)]
        for _ in range(rounds):
            at = np.argmax(v @ centres.T, axis=1)
            for c in range(len(centres)):
                if (own := v[at == c]).size:
                    m = own.mean(0)
                    centres[c] = m / max(np.linalg.norm(m), 1e-12)
        return cls(centres)

    def assign(self, rows: DataFrame, same: str | None = None, probes: int = 1) -> DataFrame:
        """`rows` (id, v, and `same` if given) with each row's cell; with several probes a row comes out once for each of its nearest cells."""
        centres = rows.sparkSession.sparkContext.broadcast(self.centres)
        kind = rows.schema["id"].dataType.simpleString()
        n = min(probes, len(self.centres))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = _matrix(b.column(1)) @ centres.value.T
                    cell = np.argmax(near, axis=1)[:, None] if n == 1 else np.argpartition(-near, n - 1, axis=1)[:, :n]
                    at = pa.array(np.repeat(np.arange(b.num_rows), n))
                    cols = [b.column(0).take(at), b.column(1).cast(pa.list_(pa.float64())).take(at), *([b.column(2).take(at)] if same else []), pa.array(cell.ravel().astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "v", *([same] if same else []), "cell"])

        tag = f", {same} {rows.schema[same].dataType.simpleString()}" if same else ""
        return rows.select("id", "v", *([same] if same else [])).where("v is not null and size(v) > 0").mapInArrow(run, f"id {kind}, v array<double>{tag}, cell int")

    def join(self, queries: DataFrame, assigned: DataFrame, k: int, probes: int, same: str | None = None, floor: float | None = None, rows_in: int = 20_000, queries_in: int = QUERIES_PER_BLOCK) -> DataFrame:
        """(q, id, sim, rank): for any number of queries (q, v, and `same` if given) the k nearest rows of the cells they look into.

        Cells are join keys on both sides and nothing passes through the driver but the cells' sizes. A cell
        with many rows or queries is dealt to parts of bounded size, each of which meets each part of the other side.
        """
        asked = self.assign(queries.withColumnRenamed("q", "id"), same, probes).withColumnRenamed("id", "q")
        sizes = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m")).unionByName(asked.groupBy("cell").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("m")))
        parts = [(r["cell"], -(-r["n"] // rows_in), -(-r["m"] // queries_in)) for r in sizes.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("n > 0 and m > 0").collect()]
        deal = F.broadcast(queries.sparkSession.createDataFrame(parts, "cell int, rn int, qn int"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        r = assigned.join(deal, "cell").withColumn("rp", F.pmod(F.xxhash64("id"), F.col("rn")).cast("int")).withColumn("qp", each("qn")).drop("rn", "qn")
        q = asked.join(deal, "cell").withColumn("qp", F.pmod(F.xxhash64("q"), F.col("qn")).cast("int")).withColumn("rp", each("rn")).drop("rn", "qn")
        q_kind, id_kind = queries.schema["q"].dataType.simpleString(), assigned.schema["id"].dataType.simpleString()

        def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"q": [], "id": [], "sim": []})
            ma, mb = (np.stack(x["v"].to_list()).astype(np.float64) for x in (a, b))
            na, nb = (np.linalg.norm(m, axis=1) for m in (ma, mb))
            s = (ma / np.where(na > 0, na, 1)[:, None]) @ (mb / np.where(nb > 0, nb, 1)[:, None]).T
            dead = (na == 0)[:, None] | (nb == 0)[None, :]
            if same:
                dead |= a[same].to_numpy(dtype=object)[:, None] != b[same].to_numpy(dtype=object)[None, :]
            if floor is not None:
                dead |= s < floor
            s = np.where(dead, -np.inf, s)
            sim, ids = _best(np.zeros((len(a), 0)), np.empty((len(a), 0), dtype=object), s, b["id"].to_numpy(dtype=object), k)
            i, j = np.nonzero(np.isfinite(sim))
            return pd.DataFrame({"q": a["q"].to_numpy(dtype=object)[i], "id": ids[i, j], "sim": sim[i, j]})

        found = q.groupBy("cell", "rp", "qp").cogroup(r.groupBy("cell", "rp", "qp")).applyInPandas(block, f"q {q_kind}, id {id_kind}, sim double")
        w = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def search(self, queries: DataFrame, assigned: DataFrame, k: int, probes: int = 16, block: int = QUERIES_PER_BLOCK) -> DataFrame:
        """(q, id, sim, rank) among the rows in the cells that each query looks into."""
        sc = queries.sparkSession.sparkContext
        q_kind, id_kind = queries.schema["q"].dataType.simpleString(), assigned.schema["id"].dataType.simpleString()
        schema = f"q {q_kind}, id {id_kind}, sim double"
        q_type, id_type = to_arrow_type(queries.schema["q"].dataType), to_arrow_type(assigned.schema["id"].dataType)
        parts = []
        for held in _blocks(queries.select("q", "v").where("v is not null and size(v) > 0"), block):
            m = np.array([r["v"] for r in held], dtype=np.float64)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            look = np.argsort(-(m @ self.centres.T), axis=1)[:, :probes]
            into = {c: np.nonzero((look == c).any(1))[0] for c in range(len(self.centres))}
            shared = sc.broadcast(([r["q"] for r in held], m, into))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                keys, m, into = shared.value
                for b in batches:
                    if not b.num_rows:
                        continue
                    c, cell = _matrix(b.column(1)), b.column(2).to_numpy()
                    ids = b.column(0).to_pylist()
                    out_q, out_i, out_s = [], [], []
                    for x in np.unique(cell):
                        own, q = np.nonzero(cell == x)[0], into[int(x)]
                        if not len(q):
                            continue
                        s = m[q] @ c[own].T
                        n = min(k, s.shape[1])
                        best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                        for r, row in enumerate(best):
                            out_q += [keys[q[r]]] * n
                            out_i += [ids[own[j]] for j in row]
                            out_s += s[r, row].tolist()
                    if out_q:
                        yield pa.RecordBatch.from_arrays([pa.array(out_q, q_type), pa.array(out_i, id_type), pa.array(out_s, pa.float64())], names=["q", "id", "sim"])

            parts.append(assigned.select("id", "v", "cell").mapInArrow(run, schema))
        found = parts[0] if parts else queries.sparkSession.createDataFrame([], schema)
        for p in parts[1:]:
            found = found.unionByName(p)
        w = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Rows in a cell, most cells, and the share of cells a row looks into when stored rows are searched for many new ones.
ROWS_PER_CELL, MOST_CELLS, LOOK = 500, 1024, 8


def nearest_stored(new: DataFrame, stored: DataFrame, k: int, same: str | None = None, floor: float | None = None, sample: int = 20_000) -> DataFrame:
    """(q, id, sim, rank): the k nearest stored rows (id, v) of any number of new ones (q, v), by an index made for the search.

    Each new row looks into an eighth of the cells, at least eight of them, so up to 4,000 stored rows the
    result is exact. Vectors must be of one length.
    """
    cells = max(1, min(MOST_CELLS, stored.count() // ROWS_PER_CELL))
    index = CellIndex.fit(stored, cells, sample)
    if index.centres.shape == (1, 1):
        return new.sparkSession.createDataFrame([], f"q {new.schema['q'].dataType.simpleString()}, id {stored.schema['id'].dataType.simpleString()}, sim double, rank int")
    return index.join(new, index.assign(stored, same), k, max(8, cells // LOOK), same, floor)
