"""Means, leader clustering and concepts of clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import CONFIG


def centroids(df: DataFrame) -> DataFrame:
    """(k, v): the mean vector of each key. df: k, v.

    Sums are combined by key and place before the shuffle, so a hot key costs one row per place and partition.
    """
    by_place = df.select("k", F.posexplode("v")).groupBy("k", "pos").agg(F.avg("col").alias("m"))
    return by_place.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("v"))


class Leaders:
    """Leader clusters that grow one vector at a time; sums are kept, so a mean costs nothing to renew."""

    def __init__(self, least: float = CONFIG.leader_cosine) -> None:
        self.least = least
        self.sums = np.zeros((0, 0))
        self.counts = np.zeros(0)

    def add(self, v: np.ndarray) -> int:
        """The number of the cluster that takes the vector: the first of greatest cosine if that is enough, else a new one."""
        if not len(self.counts):
            self.sums, self.counts = v[None, :].copy(), np.ones(1)
            return 0
        length = np.linalg.norm(self.sums, axis=1) * np.linalg.norm(v)
        cos = np.where(length > 0, self.sums @ v / np.where(length > 0, length, 1), 0.0)
        best = int(np.argmax(cos))
        if cos[best] >= self.least:
            self.sums[best] += v
            self.counts[best] += 1
            return best
        self.sums = np.vstack([self.sums, v])
        self.counts = np.append(self.counts, 1.0)
        return len(self.counts) - 1


def leader_clusters(df: DataFrame, least: float = CONFIG.leader_cosine) -> DataFrame:
    """(database_id, id, cluster): leader clustering within each database in the order of `ts`, then id.

    df: database_id, id, ts, v. The result depends on the order by definition, so a
    database is one task; the state it holds is the clusters, not the rows, which stream in sorted.
    """
    kind = df.schema["id"].dataType.simpleString()
    spread = df.select("database_id", "id", "ts", "v").repartition("database_id").sortWithinPartitions("database_id", F.asc_nulls_first("ts"), "id").drop("ts")

    def run(batches):  # noqa: ANN001, ANN202
        now, leaders = object(), None
        for part in batches:
            out = []
            for db, v in zip(part["database_id"], part["v"], strict=True):
                if leaders is None or db != now:
                    now, leaders = db, Leaders(least)
                out.append(leaders.add(np.asarray(v, dtype=np.float64)))
            yield pd.DataFrame({"database_id": part["database_id"], "id": part["id"], "cluster": out})

    return spread.mapInPandas(run, f"database_id string, id {kind}, cluster int")
