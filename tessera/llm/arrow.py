"""Small helpers around mapInArrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of text that a function sees at once; keeps Python's memory small where texts are long.
ROWS = 512


def per_row(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], schema: str) -> DataFrame:
    """Apply a function to each row of `df`; it returns any number of output tuples.

    `make` runs once per task and returns the function, so automata and caches
    are built once. Columns are passed by position.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out: list[tuple] = []
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    out += f(*row)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    return df.mapInArrow(run, schema)
