"""Rows in and out of ``mapInArrow`` functions, a batch at a time."""

from __future__ import annotations

from itertools import groupby
from typing import Iterable, Iterator

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows, and characters of text, of one outgoing batch.
BATCH_ROWS, BATCH_CHARS = 10_000, 8_000_000


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a partition in order, as tuples; null is None."""
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def runs(rows: Iterable[tuple], *key: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Neighbouring rows with equal values in the ``key`` columns."""
    return groupby(rows, key=lambda r: tuple(r[k] for k in key))


def batches_of(rows: Iterable[tuple], schema: StructType) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    pending: list[tuple] = []
    chars = 0
    for r in rows:
        pending.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(pending) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield _batch(pending, arrow)
            pending, chars = [], 0
    if pending:
        yield _batch(pending, arrow)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
