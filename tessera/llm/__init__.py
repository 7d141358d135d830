"""Operators for training data, with their queries and SQL.

Nothing outside this package imports it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import boilerplate, groups, leaks, neardup, scans, split, sql, tokenize, truncation

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """The queries of this package by name."""
    found = [neardup.p1_found, neardup.p1_classes, scans.p2_found, scans.p2_repaired, groups.p3_found, boilerplate.p4_found, boilerplate.p4_main, split.p5_found, split.p5_chunks, split.p5_cover, tokenize.p6_ids, leaks.p7_found, leaks.p7_scrubbed, truncation.p8_found, truncation.p8_rates]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL of those queries that it can express over whole tables."""
    return dict(sql.SQL)
