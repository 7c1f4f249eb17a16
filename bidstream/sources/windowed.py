"""Windows of time as a streaming source: what a run may read is bounded by a budget, lanes take turns, and a stopped run goes on where it was.

The source gives windows, not rows: (lane, number, after, through). A micro-batch has as many windows as the budget admits, its rows are then read
by Spark from wherever the tables lie, and the source's offset, which the checkpoint keeps, moves when all of the batch is written. So a
window is read whole or again, and how far each lane is needs no table of its own.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "lane string, number int, after date, through date"


def turns(position: dict[str, int], sizes: dict[str, int], reserved: dict[str, int], budget: int) -> dict[str, int]:
    """Positions after a batch: each lane first takes its reserve, if it has so many windows left, then the lanes share the rest in turn."""
    at = {lane: position.get(lane, 0) for lane in sizes}
    for lane, n in reserved.items():
        at[lane] += min(n, sizes[lane] - at[lane], budget)
        budget -= at[lane] - position.get(lane, 0)
    while budget > 0 and any(at[lane] < sizes[lane] for lane in sizes):
        for lane in sizes:
            if budget > 0 and at[lane] < sizes[lane]:
                at[lane], budget = at[lane] + 1, budget - 1
    return at


class _Reader(SimpleDataSourceStreamReader):
    """Windows between offsets; an offset is how many windows of each lane were admitted."""

    def __init__(self, options: dict[str, str]):
        self.lanes = json.loads(options["lanes"])
        self.days, self.budget = int(options.get("days", "1")), int(options["budget"])

    def _windows(self, lane: str, start: int, stop: int) -> Iterator[tuple]:
        first, last = (datetime.date.fromisoformat(self.lanes[lane][k]) for k in ("first", "last"))
        for number in range(start, stop):
            after = first + datetime.timedelta(days=number * self.days)
            yield lane, number, after, min(after + datetime.timedelta(days=self.days - 1), last)

    def _sizes(self) -> dict[str, int]:
        span = lambda x: (datetime.date.fromisoformat(x["last"]) - datetime.date.fromisoformat(x["first"])).days + 1
        return {lane: max(0, -(-span(x) // self.days)) for lane, x in self.lanes.items()}

    def initialOffset(self) -> dict:  # noqa: N802
        return dict.fromkeys(self.lanes, 0)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = turns(start, self._sizes(), {lane: x.get("reserved", 0) for lane, x in self.lanes.items()}, self.budget)
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([w for lane in self.lanes for w in self._windows(lane, start.get(lane, 0), end[lane])])


class WindowSource(DataSource):
    """Options: lanes, JSON of each lane's first and last day and its reserve; days, how long a window is; budget, windows of a micro-batch at most."""

    @classmethod
    def name(cls) -> str:
        return "windows"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Reader(dict(self.options))


def windows_stream(spark: SparkSession, lanes: dict[str, dict], days: int, budget: int) -> DataFrame:
    """A stream of windows; lanes: {name: {"first": day, "last": day, "reserved": windows of each batch}}."""
    spark.dataSource.register(WindowSource)
    return spark.readStream.format("windows").option("lanes", json.dumps(lanes)).option("days", str(days)).option("budget", str(budget)).load()


def read_windows(rows: DataFrame, lane: str, day: str, windows: DataFrame) -> DataFrame:
    """The rows of a batch's windows: those of a window's lane whose day lies in it, with its number. Windows are a budget's worth, so they are broadcast, a row for each day."""
    days = windows.select(F.col("lane").alias("lane_"), "number", F.explode(F.sequence("after", "through")).alias("day_"))
    return rows.join(F.broadcast(days), (F.col(lane) == F.col("lane_")) & (F.col(day) == F.col("day_"))).drop("lane_", "day_")


def drain_windows(windows: DataFrame, read: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, most_batches: int | None = None) -> None:
    """Runs until no window is left, or so many micro-batches were written; each writes its rows to a folder of its own, again if it runs again."""
    written: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        if most_batches is not None and len(written) >= most_batches:
            raise StopIteration  # the batch is not committed, and runs again
        held = batch.collect()  # a budget's worth
        found = read(batch.sparkSession.createDataFrame(held, SCHEMA))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")
        written.append(number)

    query = windows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    except Exception:
        if most_batches is None or len(written) < most_batches:
            raise
    finally:
        query.stop()
