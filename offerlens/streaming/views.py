"""Views of each item over a stream of browse events: first seen, last seen, how often.

Events delivered again are dropped within the watermark, then counted per item and hour
(partial counts before the shuffle, so an item with a third of all events comes to one
row an hour), and only these rows reach the state of the item. The state is one row per
item. A timer clears it when the item has not been seen for ``idle``; what it held is out
by then, and the next view opens a new run of the item. Runs add up to the item's views.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from offerlens.streaming.rankings import timed

# The state store that keyed states with timers need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
RUN = "item string, run_start timestamp, last_seen timestamp, views long"


class ViewRuns(StatefulProcessor):
    def __init__(self, idle_hours: int):
        self.idle = pd.Timedelta(hours=idle_hours)

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "start timestamp, last timestamp, views long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("first_at")  # an item has one row for each hour of the batch
        start, last, views, timer = self.run.get() if self.run.exists() else (None, None, 0, None)
        runs = [] if start is None else [[pd.Timestamp(start), pd.Timestamp(last), views]]
        for first, latest, count in zip(found["first_at"], found["last_at"], found["views"]):
            # A gap ends a run whether or not its timer has fired, so batches don't matter.
            if runs and first - runs[-1][1] <= self.idle:
                runs[-1] = [min(runs[-1][0], first), max(runs[-1][1], latest), runs[-1][2] + int(count)]
            else:
                runs.append([first, latest, int(count)])
        start, last, views = runs[-1]
        due = int((last + self.idle).timestamp() * 1000)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.run.update((start.to_pydatetime(), last.to_pydatetime(), views, due))
        columns = list(zip(*runs))
        yield pd.DataFrame({
            "item": pd.Series([key[0]] * len(runs), dtype=object), "run_start": columns[0], "last_seen": columns[1], "views": columns[2],
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.run.clear()
        return iter(())

    def close(self) -> None:
        pass


def hourly_views(events: DataFrame, item: str, late: str = "1 hour", key: str = "event_id") -> DataFrame:
    """Events delivered once, counted per item and hour when the hour is complete."""
    once = timed(events.filter(F.col(item).isNotNull()), late=late, key=key)
    return once.groupBy(F.window("browsed_at", "1 hour").alias("hour"), F.col(item).alias("item")).agg(
        F.count("*").alias("views"), F.min("browsed_at").alias("first_at"), F.max("browsed_at").alias("last_at"))


def start_views(
    events: DataFrame, place: str, checkpoint: str, item: str = "shop_code", late: str = "1 hour", idle_hours: int = 24 * 30, key: str = "event_id", **trigger,
) -> StreamingQuery:
    """Write the runs that each micro-batch has changed into a folder of that batch; a batch
    that runs twice replaces its folder. The session needs ``STATE_STORE``."""
    runs = hourly_views(events, item, late, key).groupBy("item").transformWithStateInPandas(
        statefulProcessor=ViewRuns(idle_hours), outputStructType=RUN, outputMode="Append", timeMode="EventTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{place}/batch={number}")

    return (
        runs.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
    )


def view_counts(written: DataFrame) -> DataFrame:
    """Views per item from the written runs: the last state of each run, runs added up."""
    runs = written.groupBy("item", "run_start").agg(F.max("views").alias("views"), F.max("last_seen").alias("last_seen"))
    return runs.groupBy("item").agg(F.min("run_start").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("views").alias("views"))
