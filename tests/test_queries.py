"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
CORE = {n for n in entry.queries() if not (n[0] == "p" and n[1].isdigit())}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(FOLDER + "/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(CORE & set(entry.oracle_sql())))
def test_same_rows_as_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = db.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == ordered(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(CORE - set(entry.oracle_sql())))
def test_runs(spark, name):
    # the smallest tables have no transcript whose path names an audio file
    assert entry.queries()[name](spark, FOLDER).count() > 0 or name == "audio_window_chunks"


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
