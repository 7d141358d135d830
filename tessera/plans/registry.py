"""All queries of the library with their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


#: Digits that are kept of doubles: two engines add in different orders, and differ after some fifteen.
DIGITS = 9


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows if there is one.

    The named columns of doubles (or arrays of them) are rounded on both sides.
    """
    cols = doubles.split()
    names = [c.removesuffix("[]") for c in cols]

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")

        @wraps(f)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = f(spark, folder)
            kinds = dict(df.dtypes)
            return df.withColumns({c: F.transform(c, lambda x: F.round(x, DIGITS)) if kinds[c].startswith("array") else F.round(c, DIGITS) for c in names}) if names else df

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = f"SELECT * REPLACE ({', '.join(_rounded(c) for c in cols)}) FROM ({sql})" if cols else sql
        return f

    return add


def _rounded(c: str) -> str:
    plain = c.removesuffix("[]")
    return f"list_transform({plain}, lambda x: round(cast(x as double),{DIGITS})) AS {plain}" if c.endswith("[]") else f"round(cast({c} as double),{DIGITS}) AS {c}"


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)
