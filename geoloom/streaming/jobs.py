"""The states of jobs as a stream, by a stateful processor: a value for each job, and a timer that ends it.

State stores must be RocksDB's (spark.sql.streaming.stateStore.providerClass), as processors of this kind need it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.stores import JOB_AGE, NEXT_STATES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "job_id string, status string, updated_at timestamp, accepted boolean"
#: Rows of an output batch.
OUT_ROWS = 10_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class JobStates(StatefulProcessor):
    """A job's state after each change. Of a batch's changes only times and codes are held, ten bytes each, so a hot job takes some megabytes a million."""

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, timer long")
        names = sorted({s for k, after in NEXT_STATES.items() for s in (k, *after)} | {"queued"})
        self.code = {s: i for i, s in enumerate(names)}
        self.names = np.array(names, dtype=object)
        self.next = np.zeros((len(names), len(names)), dtype=bool)
        for k, after in NEXT_STATES.items():
            for s in after:
                self.next[self.code[k], self.code[s]] = True

    def _codes(self, column: pd.Series) -> np.ndarray:
        return column.map(self.code).fillna(-1).to_numpy(dtype=np.int8)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (Spark's names)
        at, expected, to, rest = [], [], [], {}
        for batch in rows:
            start = sum(map(len, at))
            at.append(batch["at"].to_numpy(dtype="datetime64[us]"))
            expected.append(self._codes(batch["expected"]))
            to.append(self._codes(batch["to_status"]))
            # States that no rule knows are never reached; they only order changes of one time.
            for i in np.flatnonzero(to[-1] < 0):
                rest[start + int(i)] = str(batch["to_status"].iloc[int(i)])
        at, expected, to = np.concatenate(at), np.concatenate(expected), np.concatenate(to)
        if rest:
            order = np.array(sorted(range(len(at)), key=lambda i: (at[i], rest.get(i, self.names[to[i]] if to[i] >= 0 else ""))))
        else:
            order = np.lexsort((to, at))  # codes are in the names' order
        held = self.state.get() if self.state.exists() else None
        status = self.code[held[0]] if held else -1
        for start in range(0, len(order), OUT_ROWS):
            some = order[start : start + OUT_ROWS]
            after, accepted = np.empty(len(some), dtype=np.int8), np.empty(len(some), dtype=bool)
            for k, i in enumerate(some):
                ok = to[i] >= 0 and ((status < 0 and self.names[to[i]] == "queued") or (status >= 0 and expected[i] == status and self.next[status, to[i]]))
                status = int(to[i]) if ok else status
                after[k], accepted[k] = status, ok
            names = np.where(after >= 0, self.names[after], None)
            yield pd.DataFrame({"job_id": key[0], "status": names, "updated_at": pd.to_datetime(at[some]), "accepted": accepted})
        if status >= 0:
            if held and held[1]:
                self.handle.deleteTimer(int(held[1]))
            last = int(at[order[-1]].astype("datetime64[ms]").astype(np.int64))
            timer = max(timerValues.getCurrentWatermarkInMs() + 1, last + self.ttl_ms)
            self.handle.registerTimer(timer)
            self.state.update((str(self.names[status]), timer))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame({"job_id": pd.Series(dtype=object), "status": pd.Series(dtype=object), "updated_at": pd.Series(dtype="datetime64[us]"), "accepted": pd.Series(dtype=bool)})

    def close(self) -> None:
        pass


def job_states(changes: DataFrame, ttl_seconds: int = JOB_AGE, late: str = "1 hour") -> DataFrame:
    """(job_id, status, updated_at, accepted): a job's state after each change (job_id, expected, to_status, at).

    Changes of a batch come by time and then by the state that they lead to. A change counts if the job's state is the expected one and may be followed so; a job begins with a change to
    queued. The state of a job without changes for so long, by event time, is given up; changes later than `late` are dropped.
    """
    rows = changes.withWatermark("at", late).groupBy("job_id")
    return rows.transformWithStateInPandas(JobStates(ttl_seconds), STATE, "Append", "EventTime")
