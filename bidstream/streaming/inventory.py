"""Inventories that are verified, and retries that wait, as state of a stream: one state for each key, timers by event time.

What comes out does not depend on how rows were cut into micro-batches, as long as they come in order of time: a time that a row of the
key passes by itself counts as passed, whether or not its timer has fired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Settings that state with timers needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: How often a wait doubles at most.
MOST_DOUBLINGS = 5


class _Keyed(StatefulProcessor):
    """Rows of a key in order of time, each with the state before it; `step` gives rows to put out and the state after."""

    state_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # a micro-batch's rows of one key; admission bounds what a micro-batch has
        batch = sorted(rows, key=lambda r: (r.at_ms, r.tie) if "tie" in r else r.at_ms)
        state, out = self.state.get() if self.state.exists() else None, []
        for row in batch:
            state, passed = self.passed(state, int(row.at_ms))
            state, more = self.step(state, row)
            out += [*passed, *more]
        self._keep(state)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state, out = self.passed(self.state.get() if self.state.exists() else None, expiredTimerInfo.getExpiryTimeInMs())
        self._keep(state)
        yield from self._rows(key, out)

    def _keep(self, state) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if state is None:
            self.state.clear()
            return
        self.state.update(state)
        if self.timer(state) is not None:
            self.handle.registerTimer(self.timer(state))

    def _rows(self, key, out: list[tuple]) -> Iterator[Row]:
        return (Row(key=key[0], at_ms=at, status=status, attempts=attempts, due_ms=due) for at, status, attempts, due in out)

    def close(self) -> None:
        pass


class Retries(_Keyed):
    """Failed items wait, twice as long after each further failure; a success ends it. State: (attempts, due, fired)."""

    state_schema = "attempts long, due_ms long, fired boolean"

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def timer(self, state):
        return None if state[2] else int(state[1])

    def passed(self, state, now: int):
        """A due time that has come is told once."""
        if state is None or state[2] or now < state[1]:
            return state, []
        return (state[0], state[1], True), [(int(state[1]), "due", int(state[0]), int(state[1]))]

    def step(self, state, row):
        if row.ok:
            return None, [] if state is None else [(int(row.at_ms), "done", int(state[0]), None)]
        attempts = 1 if state is None else int(state[0]) + 1
        due = int(row.at_ms) + self.wait_ms * 2 ** min(attempts - 1, MOST_DOUBLINGS)
        return (attempts, due, False), [(int(row.at_ms), "waiting", attempts, due)]


class Confirmations(_Keyed):
    """A page counts once two readings in a row gave the same digest; one that is not read again in time is forgotten. State: (digest, until, times)."""

    state_schema = "digest string, until_ms long, times long"

    def __init__(self, within_ms: int):
        self.within_ms = within_ms

    def timer(self, state):
        return int(state[1])

    def passed(self, state, now: int):
        if state is None or now < state[1]:
            return state, []
        return None, [(int(state[1]), "forgotten", int(state[2]), None)]

    def step(self, state, row):
        same = state is not None and state[0] == row.digest
        times, until = (int(state[2]) + 1 if same else 1), int(row.at_ms) + self.within_ms
        said = "read" if state is None else "changed" if not same else "verified" if times == 2 else None
        return (row.digest, until, times), [] if said is None else [(int(row.at_ms), said, times, until)]


def told(rows: DataFrame, key: Column, at: Column, processor: StatefulProcessor, *more: Column) -> DataFrame:
    """(key, at_ms, status, attempts, due_ms): what a processor tells of a stream's rows; more: the columns that it reads, and tie, which orders rows of one time."""
    named = rows.select(key.cast("string").alias("key"), at.alias("at"), F.unix_millis(at).alias("at_ms"), *more).withWatermark("at", "0 seconds")
    return named.groupBy("key").transformWithState(processor, "key string, at_ms long, status string, attempts long, due_ms long", "Update", "EventTime")


def drain(told_: DataFrame, path: str, checkpoint: str, name: Callable[[int], str] = lambda n: f"batch={n}") -> None:
    """Runs the stream over all there is, a folder for each micro-batch; a run after a stop goes on where the checkpoint is, and a batch that runs again writes its own folder again."""
    query = told_.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/{name(n)}")).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, with the state store that timers need; read when a stream starts."""
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    return spark
