"""Ordered folds: operators whose result at a row hangs on their result at the row before.

A fold is a class with step(row) -> list of output rows, finish() -> list of output rows, and dump()/load() of its
state as JSON text, so that batch and streaming share one implementation. In batch the rows pass as a stream, sorted
by key and order; only the state of one key is held at a time, however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string


class Fold(Protocol):
    def step(self, row: tuple) -> list[tuple]: ...

    def finish(self) -> list[tuple]: ...

    def dump(self) -> str: ...

    def load(self, state: str) -> None: ...


def fold(df: DataFrame, key: str, order: str, columns: list[str], make: Callable[[], Fold], schema: str) -> DataFrame:
    """Runs make() over the rows of each key in order; output rows are the key and what the fold gives, by schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = _parse_datatype_string(schema)
    assert isinstance(wanted, StructType)
    arrow = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, started = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for key_, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or key_ != now:
                    if started:
                        out += [(now, *r) for r in state.finish()]
                    now, state, started = key_, make(), True
                out += [(key_, *r) for r in state.step(tuple(row))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)
        if started and (out := [(now, *r) for r in state.finish()]):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return df.select(key, *columns).repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def annotate(df: DataFrame, key: str, order: str, columns: list[str], begin: Callable[[], object], step: Callable[[object, list[np.ndarray]], list[np.ndarray]], schema: str) -> DataFrame:
    """df with the columns that a vectorised fold gives for each row.

    df must already be dealt out by key, as by repartition(key) or windows over it; here it is only sorted. begin() makes
    the state of a key, step(state, arrays of columns) the new columns for the next rows of the key. Text columns come as
    objects, nulls of number columns as NaN. Rows keep all their columns on the way, so
    nothing has to be joined back.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    added = _parse_datatype_string(schema)
    assert isinstance(added, StructType)
    arrow = to_arrow_schema(added)
    at, read = df.columns.index(key), [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys = batch.column(at).dictionary_encode()
            codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            values = [batch.column(k).to_numpy(zero_copy_only=False) for k in read]
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            parts: list[list[np.ndarray]] = []
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    found = (keys.dictionary[codes[a]].as_py() if codes[a] >= 0 else None,)
                    if found != now:
                        now, state = found, begin()
                    parts.append(step(state, [v[a:b] for v in values]))
            made = [pa.array(np.concatenate(x) if x else [], f.type) for x, f in zip([[p[k] for p in parts] for k in range(len(arrow))], arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema=pa.schema([*batch.schema, *arrow]))

    return df.sortWithinPartitions(key, order).mapInArrow(run, StructType([*df.schema.fields, *added.fields]))
