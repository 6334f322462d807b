"""Positions and neighbours in ordered groups, safe when one group is huge.

A plain window sends a whole group to one task. Here rows are range-partitioned over
group and order together and sorted, so a group of any size spreads over as many ranges
as it needs. Each range is numbered in one pass over its sorted rows, which also notes its
ends. What a range needs to know of those before it is a prefix sum over the ranges, one
small row each: how many rows its first group has there already, and which row came last.
These rows are broadcast (one per range). So the data are shuffled once; they are cut off
there durably, since ranges are drawn from samples and must not be drawn a second time.
All inputs take this one way.

Groups are told apart by columns of plain types; NULL is a group like others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from offerlens.session import durable

Batches = Iterator[pa.RecordBatch]
# What a pass adds to each row: the range, whether the row is a copy of the range's first
# (1) or last row (2) or none, its place in its group within the range, and whether
# that group is the range's first one.
_NOTES = StructType([StructField("_range", IntegerType()), StructField("_end", IntegerType()), StructField("_place", LongType()), StructField("_early", BooleanType())])


def _fresh(column: pa.Array, last: pa.Array | None) -> np.ndarray:
    """Where a value differs from the one before it; ``last`` is that of the batch before."""
    before = pa.concat_arrays([last if last is not None else pa.nulls(1, column.type), column.slice(0, len(column) - 1)])
    same = pc.or_(pc.fill_null(pc.equal(column, before), False), pc.and_(pc.is_null(column), pc.is_null(before)))
    return ~same.to_numpy(zero_copy_only=False)


def _noted(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], parts: int | None, more: StructType,
    make: Callable[[], Callable[[pa.RecordBatch, np.ndarray], list[pa.Array]]],
) -> DataFrame:
    """All rows in sorted ranges with the notes, and ``more`` columns that ``make``'s function
    of (batch, rows that start a group) adds."""
    parts = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = [F.col(f"`{k}`") for k in keys] + list(order)
    placed = df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    schema = StructType([*df.schema.fields, *more.fields, *_NOTES.fields])
    names, at = schema.fieldNames(), [df.columns.index(k) for k in keys]

    def run(batches: Batches) -> Batches:
        number, apply = TaskContext.get().partitionId(), make()
        last: list[pa.Array] | None = None  # the groups' columns of the last row so far
        rows, early, row = 0, True, None

        def out(columns: list[pa.Array], end: int, place: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
            n = len(place)
            notes = [pa.array(np.full(n, number, np.int32)), pa.array(np.full(n, end, np.int32)), pa.array(place.astype(np.int64)), pa.array(first)]
            return pa.RecordBatch.from_arrays([*columns, *notes], names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, bool)
            for i, k in enumerate(at):
                starts |= _fresh(batch.column(k), last[i] if last else None)
            starts[0] |= last is None
            here = np.arange(n)
            opened = np.maximum.accumulate(np.where(starts, here, -1))
            place = np.where(opened < 0, here + rows, here - opened) + 1
            # The range's first group goes on until the next one starts.
            first = early & (np.cumsum(starts) <= (1 if last is None else 0))
            columns = [*batch.columns, *apply(batch, starts)]
            if last is None:
                yield out([c.slice(0, 1) for c in columns], 1, place[:1], first[:1])
            yield out(columns, 0, place, first)
            last, rows, early = [batch.column(k).slice(n - 1) for k in at], int(place[-1]), bool(first[-1])
            row = [c.slice(n - 1) for c in columns]
        if row is not None:
            yield out(row, 2, np.array([rows]), np.array([early]))

    return durable(placed.mapInArrow(run, schema))


def _ends(noted: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """A row per range: ``_head`` and ``_tail`` group, the ``_rows`` of the last group, whether
    it is the ``_only`` one, the ``_value`` of the last row, and whether the first group
    goes on from the range before (``_goes_on``)."""
    group = F.struct(F.lit(0).alias("_"), *[F.col(f"`{k}`") for k in keys])
    last = F.col("_end") == 2
    ends = noted.filter("_end > 0").groupBy("_range").agg(
        F.max_by(group, F.when(~last, F.lit(1))).alias("_head"), F.max_by(group, F.when(last, F.lit(1))).alias("_tail"),
        F.max(F.when(last, F.col("_place"))).alias("_rows"), F.max(F.when(last, F.col("_early"))).alias("_only"),
        F.max_by(value, F.when(last, F.lit(1))).alias("_value"))
    before = F.lag("_tail").over(Window.orderBy("_range"))
    return ends.withColumn("_goes_on", F.coalesce(before.isNotNull() & before.eqNullSafe(F.col("_head")), F.lit(False)))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "position",
    parts: int | None = None,
) -> DataFrame:
    """1-based position of each row within its group. ``order`` must be total."""
    noted = _noted(df, keys, order, parts, StructType(), lambda: lambda batch, starts: [])
    by_range = Window.orderBy("_range")  # one row per range
    # Ranges that one group fills add up, from the range it starts in.
    stretch = F.sum((~(F.col("_only") & F.col("_goes_on"))).cast("int")).over(by_range)
    summed = _ends(noted, keys, F.lit(0)).withColumn("_stretch", stretch).withColumn(
        "_so_far", F.sum("_rows").over(Window.partitionBy("_stretch").orderBy("_range")))
    carried = summed.select("_range", F.when(F.col("_goes_on"), F.lag("_so_far").over(by_range)).otherwise(F.lit(0)).alias("_before"))
    place = F.col("_place") + F.when(F.col("_early"), F.col("_before")).otherwise(F.lit(0))
    return noted.filter("_end = 0").join(F.broadcast(carried), "_range").select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name))


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    columns: Sequence[str],
    name: str = "previous",
    parts: int | None = None,
) -> DataFrame:
    """Struct of the given columns of the row just before, NULL for the first."""
    at = [df.columns.index(c) for c in columns]

    def make() -> Callable[[pa.RecordBatch, np.ndarray], list[pa.Array]]:
        last: list[pa.Array] = []

        def apply(batch: pa.RecordBatch, starts: np.ndarray) -> list[pa.Array]:
            own = [batch.column(i) for i in at]
            shifted = [pa.concat_arrays([last[i] if last else pa.nulls(1, c.type), c.slice(0, len(c) - 1)]) for i, c in enumerate(own)]
            last[:] = [c.slice(len(c) - 1) for c in own]
            fields = [pa.field(n, c.type) for n, c in zip(columns, shifted)]
            return [pa.StructArray.from_arrays(shifted, fields=fields, mask=pa.array(starts))]

        return apply

    noted = _noted(df, keys, order, parts, StructType([StructField("_lag", StructType([df.schema[c] for c in columns]))]), make)
    value = F.struct(*[F.col(f"`{c}`") for c in columns])
    carried = _ends(noted, keys, value).select("_range", F.when(F.col("_goes_on"), F.lag("_value").over(Window.orderBy("_range"))).alias("_before"))
    # A range's first row looks into the range before it.
    before = F.when(F.col("_early") & (F.col("_place") == 1), F.col("_before")).otherwise(F.col("_lag"))
    return noted.filter("_end = 0").join(F.broadcast(carried), "_range").select(*[F.col(f"`{c}`") for c in df.columns], before.alias(name))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row that is last by ``order`` for each key. An aggregate, so every map
    task sends one row per key however many rows the key has, and the row once: its other
    columns stand behind the order's and decide between rows that are equal in that."""
    ahead = [c for c in order if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in ahead]
    packed = F.struct(*[F.col(c) for c in ahead], *[F.col(c) for c in rest])
    # Maps and variants have no order.
    unordered = any(k in kind for _, kind in df.dtypes for k in ("map<", "variant"))
    folded = df.groupBy(*keys).agg((F.max_by(packed, F.struct(*ahead)) if unordered else F.max(packed)).alias("_row"))
    return folded.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def first_page(df: DataFrame, order: Sequence[Column], per_page: int) -> DataFrame:
    """The first rows of an ordered frame, a top-k: no task holds more of them."""
    return df.orderBy(*order).limit(per_page)


def page_rows(df: DataFrame, order: Sequence[Column], page: int, per_page: int) -> DataFrame:
    """Any page of an ordered frame, cut out of distributed positions, so no task and
    no driver holds the rows before it. A page after a known row is cheaper by key."""
    if page < 1 or not 1 <= per_page <= 100:
        raise ValueError("page starts at 1 and per_page lies in 1..100")
    offset = (page - 1) * per_page
    placed = number_rows(df, [], order, "_position")
    return placed.filter(F.col("_position").between(offset + 1, offset + per_page)).orderBy("_position").drop("_position")
