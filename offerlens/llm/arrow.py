"""Passing tables through Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes``; one row is never split."""
    for batch in batches:
        parts = max(1, -(-batch.nbytes // most_bytes))
        rows = max(1, -(-batch.num_rows // parts))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, most_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Apply a function of one batch to all rows. ``make`` runs once in each task
    and returns that function, so that models and caches are set up there. Rows of
    many nested numbers, which Python holds as objects, need smaller batches."""

    def run(batches):
        apply = make()
        for batch in slices(batches, most_bytes):
            yield apply(batch)

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Strings of a column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.view(kind).to_pylist()]


def lists(column: pa.Array) -> list[list]:
    """The lists of a column of lists of numbers, or of such lists, that holds no nulls."""
    flat = column.flatten()
    values = lists(flat) if pa.types.is_list(flat.type) else flat.to_numpy(zero_copy_only=False).tolist()
    stops = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    return [values[a:b] for a, b in zip([0, *stops], stops)]
