"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more than one HOT_SHARE-th of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 256


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE, least: int = 10_000) -> list:
    """Keys of `df` with more than max(rows / share, least) rows: at most `share` of them.

    The counts are combined on the map side, so a hot key costs one row per
    input partition. Nulls are not keys.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    total = df.count()
    if total <= least:
        return []
    return [r[0] for r in counts.where(F.col("count") > max(total // share, least)).select(key).collect()]


def lookup(df: DataFrame, key: str, dim: DataFrame, dim_key: str, hot: list | None = None, how: str = "inner") -> DataFrame:
    """Join `df` with the unique-keyed `dim`, whatever the skew of `df`'s key.

    Rows of hot keys meet a broadcast of those keys' rows of `dim` (at most
    HOT_SHARE, one each); all others go through an ordinary join, for which
    the optimiser chooses the strategy by size. `dim_key` is dropped; null keys
    match nothing. Columns of both sides must differ by name.
    """
    hot = hot_keys(df, key) if hot is None else hot
    on = F.col(key) == F.col(dim_key)
    if not hot:
        return df.join(dim, on, how).drop(dim_key)
    few = dim.where(F.col(dim_key).isin(hot))
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    a = df.where(is_hot).join(F.broadcast(few), on, how)
    b = df.where(~is_hot).join(dim, on, how)
    return a.unionByName(b).drop(dim_key)
