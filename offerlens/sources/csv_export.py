"""CSV export of a priced history, with byte-order mark and the fixed headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.fixed import CHART_CSV_HEADER, TABLE_CSV_HEADER

_VALUES = ("record_date", "price", "points", "price_minus_points", "coupon", "effective_price")
LAYOUTS = {"chart": CHART_CSV_HEADER, "table": TABLE_CSV_HEADER}


def export_frame(priced: DataFrame, layout: str = "chart", *also: str) -> DataFrame:
    """The exported columns; the first header cell carries the mark."""
    header = LAYOUTS[layout]
    names = ["\ufeff" + header[0], *header[1:]]
    return priced.select(*[F.col(v).alias(n) for v, n in zip(_VALUES, names)], *also)


def write_csv(priced: DataFrame, folder: str, layout: str = "chart", by: str | None = None, single: bool = False) -> None:
    """One folder of CSV files. ``single`` asks for one file, which is meant for
    the history of one variant; ``by`` makes a folder per value of a column, with
    the rows range-partitioned so that no value burdens a single task."""
    order = F.col("record_date").asc() if layout == "chart" else F.col("record_date").desc()
    if by:
        placed = priced.repartitionByRange(F.col(by), order).sortWithinPartitions(F.col(by), order)
        writer = export_frame(placed, layout, by).write.partitionBy(by)
    else:
        out = export_frame(priced.orderBy(order), layout)
        writer = (out.coalesce(1) if single else out).write
    writer.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(folder)
