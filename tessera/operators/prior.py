"""The learned prior: a small network from a query's vector to the concepts it is about."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import CONFIG
from tessera.plans.durable import durable

#: Outputs of the network in one registry row.
OUTPUTS = 16_384


def dense_index(df: DataFrame, column: str) -> DataFrame:
    """(column, n): the place of each distinct value in their order, from 0, without bringing all into one task.

    Values are parted by range; each part is numbered on its own and moved on by the sizes of the parts before it.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = durable(df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(parts, column).withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    if not before:
        return ranged.select(column, F.lit(0).alias("n"))
    offset = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)])[F.col("part")]
    w = Window.partitionBy("part").orderBy(column)
    return ranged.select(column, (offset + F.row_number().over(w) - 1).cast("int").alias("n"))


def concept_index(concepts: DataFrame) -> DataFrame:
    """(concept_id, n): the place of each concept in the order of ids, from 0."""
    return dense_index(concepts, "concept_id")


def membership(concepts: DataFrame) -> DataFrame:
    """(id, concepts): the concepts of each chunk, sorted. concepts: concept_id, members."""
    return concepts.select("concept_id", F.explode("members").alias("id")).groupBy("id").agg(F.array_sort(F.collect_set("concept_id")).alias("concepts"))


def training_set(events: DataFrame, concepts: DataFrame, dims: int) -> DataFrame:
    """(event_id, v, concepts): events with a query vector of the right length and at least one concept. events: event_id, ids, query_embedding (text)."""
    v = F.from_json("query_embedding", "array<double>")
    able = events.withColumn("v", v).where(F.size("v") == dims)
    rows = able.select("event_id", "v", F.explode("ids").alias("id")).join(membership(concepts), "id").select("event_id", "v", F.explode("concepts").alias("c"))
    return rows.groupBy("event_id").agg(F.first("v").alias("v"), F.array_sort(F.collect_set("c")).alias("concepts"))


def influence(n: Column, cap: float = CONFIG.prior_weight) -> Column:
    """How much the prior counts after n samples: grows to the cap at 100."""
    return F.least(F.lit(cap), cap * n / 100)


def chunk_scores(chunk_concepts: DataFrame, concept_scores: DataFrame) -> DataFrame:
    """(q, id, prior): the greatest score of a chunk's concepts, at least 0. chunk_concepts: id, concepts; concept_scores: q, concept_id, score."""
    flat = chunk_concepts.select("id", F.explode("concepts").alias("concept_id"))
    return flat.join(concept_scores, "concept_id").groupBy("q", "id").agg(F.greatest(F.lit(0.0), F.max("score")).alias("prior"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def model_id(database: str) -> str:
    return f"associative:{database}"


@dataclass
class Prior:
    """Dense 256 (with weight decay and dropout), dense 128, one sigmoid for each concept; Adam on the cross-entropy."""

    dims: int
    concepts: list[str]
    seed: int = 11
    trained_on: int = 0
    layers: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.layers:
            rng = np.random.default_rng(self.seed)
            for a, b in zip((self.dims, 256, 128), (256, 128, len(self.concepts)), strict=True):
                limit = np.sqrt(6 / max(1, a + b))
                self.layers += [rng.uniform(-limit, limit, (a, b)), np.zeros(b)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2, w3, b3 = self.layers
        return _sigmoid(np.maximum(np.maximum(x @ w1 + b1, 0) @ w2 + b2, 0) @ w3 + b3)

    def influence(self) -> float:
        return min(CONFIG.prior_weight, CONFIG.prior_weight * self.trained_on / 100) if self.concepts else 0.0

    def fit(self, x: np.ndarray, y: np.ndarray | list[list[int]], epochs: int = CONFIG.prior_epochs, batch: int = CONFIG.prior_batch, rate: float = 1e-3, decay: float = 1e-3, drop: float = 0.2) -> bool:
        """Train on rows of vectors and 0/1 targets, or the places of the ones in each row; with fewer than ten samples or no concepts nothing happens."""
        if len(x) < CONFIG.prior_min_samples or not self.concepts:
            return False
        rng = np.random.default_rng(self.seed + self.trained_on)
        m, v, t = [np.zeros_like(p) for p in self.layers], [np.zeros_like(p) for p in self.layers], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                some = order[at : at + batch]
                xb, yb = x[some], y[some] if isinstance(y, np.ndarray) else self._targets([y[i] for i in some])
                w1, b1, w2, b2, w3, b3 = self.layers
                h1 = np.maximum(xb @ w1 + b1, 0)
                mask = (rng.random(h1.shape) >= drop) / (1 - drop)
                d1 = h1 * mask
                h2 = np.maximum(d1 @ w2 + b2, 0)
                g3 = (_sigmoid(h2 @ w3 + b3) - yb) / (len(xb) * max(1, yb.shape[1]))
                g2 = (g3 @ w3.T) * (h2 > 0)
                g1 = (g2 @ w2.T) * mask * (h1 > 0)
                grads = [xb.T @ g1 + 2 * decay * w1, g1.sum(0), d1.T @ g2, g2.sum(0), h2.T @ g3, g3.sum(0)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.layers[i] = self.layers[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-7)
        self.trained_on += len(x)
        return True

    def _targets(self, places: list[list[int]]) -> np.ndarray:
        """0/1 rows, made for one batch at a time: all of them would be samples times concepts."""
        y = np.zeros((len(places), len(self.concepts)))
        for i, at in enumerate(places):
            y[i, at] = 1
        return y

    def to_rows(self, database: str, as_of_ms: int, block: int = OUTPUTS) -> Iterator[dict]:
        """Registry rows: one with the hidden layers and the first `block` outputs, and one for each further block, so that no row grows with the concepts.

        The ids name the database, so models of two databases never mix.
        """
        *hidden, w, b = self.layers
        for at in range(0, max(1, len(self.concepts)), block):
            parts = [*(hidden if at == 0 else []), w[:, at : at + block], b[at : at + block]]
            shapes = [{"shape": list(p.shape), "data": p.ravel().tolist()} for p in parts]
            yield {"model_id": model_id(database) + (f"\x1f{at}" if at else ""), "weights": shapes, "num_concepts": len(self.concepts), "trained_on": self.trained_on, "last_trained": as_of_ms}

    def to_row(self, database: str, as_of_ms: int) -> dict:
        """All of the network in one registry row."""
        return next(self.to_rows(database, as_of_ms, max(1, len(self.concepts))))

    @classmethod
    def from_rows(cls, rows: Iterable[dict], dims: int, concepts: list[str]) -> Prior:
        """The stored network if it has as many concepts, else a fresh one."""
        parts, trained_on = {}, 0
        for r in rows:
            if r["num_concepts"] == len(concepts):
                parts[int(r["model_id"].partition("\x1f")[2] or 0)] = [np.array(p["data"]).reshape(p["shape"]) for p in r["weights"]]
                trained_on = r["trained_on"]
        if 0 not in parts or parts[0][0].shape[0] != dims:
            return cls(dims, concepts)
        outputs = [parts[at][-2:] for at in sorted(parts)]
        layers = [*parts[0][:-2], np.concatenate([w for w, _ in outputs], axis=1), np.concatenate([b for _, b in outputs])]
        return cls(dims, concepts, trained_on=trained_on, layers=layers)

    @classmethod
    def from_row(cls, row: dict, dims: int, concepts: list[str]) -> Prior:
        """As `from_rows`, of one row."""
        return cls.from_rows([row] if row else [], dims, concepts)


def train(samples: DataFrame, concepts: list[str], dims: int, most: int = 100_000, prior: Prior | None = None) -> Prior:
    """Fit on at most `most` samples (v, concepts, event_id), taken by hash of the event: a bound on what reaches the driver."""
    rows = samples.orderBy(F.xxhash64("event_id")).limit(most).collect()
    prior = prior or Prior(dims, concepts)
    place = {c: i for i, c in enumerate(prior.concepts)}
    y = [[place[c] for c in r["concepts"] if c in place] for r in rows]
    if len(rows):
        prior.fit(np.array([r["v"] for r in rows]), y)
    return prior
