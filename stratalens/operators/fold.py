"""Folds over ordered groups: a state that each row of a group changes in turn.

Rows are dealt by key, sorted, and stream through; a task holds the state of one group, never its rows, so a group may be of
any length. For what neither a window nor an aggregate says in linear time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folded(rows: DataFrame, key: str, order: list, start: Callable, schema: StructType) -> DataFrame:
    """What start()(row) yields for the rows of each group: tuples of `schema`, made with a fresh start() for every key.

    row is a tuple of the frame's columns. Rows that `order` leaves equal come in any order.
    """
    at, types = rows.columns.index(key), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, of = None, None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or row[at] != of:
                    state, of = start(), row[at]
                out += state(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(types), types.types)], types.names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
