"""Folds over rows in a total order, one state per key, as a streaming pass over sorted partitions.

A key's rows are never gathered: they stream through the task in order and only the state is held, so a key may have any
number of rows. For operators whose result at a row depends on decisions about earlier rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], dict | None], added: str) -> DataFrame:
    """df with the columns `added` (DDL): step(state, row) may change the state and returns their values, or None to drop the row."""
    extra = T._parse_datatype_string(added)
    schema = T.StructType(df.schema.fields + extra.fields)
    arrow = to_arrow_schema(schema)
    names = [f.name for f in extra.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if state is None or key != current:
                    current, state = key, start()
                got = step(state, row)
                if got is not None:
                    out.append(row | {n: got.get(n) for n in names})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
