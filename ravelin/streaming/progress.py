"""Progress of tool calls as keyed state: what W6 and W7 say of a call, told as calls come in, whatever the batches.

Each user has the number and the last of the successes so far, and the calls made so far. Users that are idle for longer than `idle` are forgotten. State needs the RocksDB provider; see configure().
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Kinds of calls that are no successes.
NO_SUCCESS = ("error", "view")
OUT = "event_id long, duplicate boolean, last_success string, n_success long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    """The state store that keyed state needs, where the session has another."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Progress(StatefulProcessor):
    """idle: milliseconds of processing time after which a user's state goes; 0 keeps it."""

    def __init__(self, idle: int = 0):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.so_far = handle.getValueState("so_far", "n long, last string")
        self.calls = handle.getMapState("calls", "kind string, output string", "times long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A row for each call, in the order of time; calls of one batch are put in order first."""
        n, last = self.so_far.get() if self.so_far.exists() else (0, "")
        given = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out, known = [], {}  # of the calls of this batch, so that the state is asked and told once for each
        for event, kind, output in zip(given.event_id, given.event_type, given.output, strict=True):
            call = (str(kind), str(output))
            if call not in known:
                known[call] = self.calls.getValue(call)[0] if self.calls.containsKey(call) else 0
            if kind not in NO_SUCCESS:
                n, last = n + 1, str(output)
            out.append((int(event), known[call] > 0, last, int(n)))
            known[call] += 1
        self.so_far.update((n, last))
        for call, times in known.items():
            self.calls.updateValue(call, (times,))
        if self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame(out, columns=["event_id", "duplicate", "last_success", "n_success"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.so_far.clear()
        self.calls.clear()
        yield from ()

    def close(self) -> None:
        pass


def progress(calls: DataFrame, idle: int = 0) -> DataFrame:
    """(event_id, duplicate, last_success, n_success) for each row of a stream calls (user_id, ts, event_id, event_type, output).

    duplicate: the user has made the same call before; the other two tell of all calls up to this one. Batches must follow each other in time for each user; within a batch any order will do.
    """
    return calls.groupBy("user_id").transformWithStateInPandas(Progress(idle), OUT, "append", "processingtime" if idle else "none")
