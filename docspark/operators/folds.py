"""Folds over ordered rows of a key whose state is small: rows pass through a sorted partition one by one, no group is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A step takes the state (None at a key's first row) and a row's values; it returns the new state and what it adds to the row.
Step = Callable[[object, tuple], tuple[object, tuple]]


def fold(rows: DataFrame, key: str, order: list[str], values: list[str], step: Step, added: str) -> DataFrame:
    """``rows`` with the columns ``added`` (a schema); rows of one key are visited by ``order``."""
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(added).fields])
    kinds = [f.dataType for f in T._parse_datatype_string(added).fields]
    names = [f.name for f in schema.fields]
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = object()
        state: object = None
        for batch in batches:
            made = []
            for k, *row in zip(batch.column(key).to_pylist(), *(batch.column(v).to_pylist() for v in values), strict=True):
                if k != last:
                    last, state = k, None
                state, out = step(state, tuple(row))
                made.append(out)
            more = [pa.array([x[i] for x in made], arrow[k.simpleString()]) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
