"""Streams over events: windowed counts, sessions, and the state of grants.

Extensions: what the batch operators compute, kept up to date as events come in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, folder: str, schema, most_files: int = 1) -> DataFrame:
    """Stream of Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def windowed_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events and their values by type and window; what is later than ``late`` is left out."""
    found = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def _grants(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    until = state.get[0] if state.exists else 0
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"request_id": [key[0]], "status": ["expired"], "at": [pd.Timestamp(until, unit="ms")]})
        return
    out = []
    for row in pd.concat(list(frames)).sort_values(["ts", "event"]).itertuples():
        if row.event == "approve" and not until:
            until = int(row.ts.timestamp() * 1000 + row.ttl_minutes * 60_000)
            out.append((key[0], "approved", row.ts))
        elif row.event == "revoke" and until:
            until = 0
            out.append((key[0], "revoked", row.ts))
    if until:
        state.update((until,))
        if until > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(until)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["request_id", "status", "at"])


def grant_changes(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Approvals, revocations and ends of grants (``request_id``, ``event``, ``ts``, ``ttl_minutes``), each once."""
    marked = stream.withWatermark("ts", late).groupBy("request_id")
    return marked.applyInPandasWithState(_grants, "request_id long, status string, at timestamp", "until long", "append", GroupStateTimeout.EventTimeTimeout)


# --- grants with timers ---------------------------------------------------------------

#: Where the state of timers is kept; the default store has none.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = Row("request_id", "status", "at", "expires_at")
_CHANGES = "request_id long, status string, at long, expires_at long"


class GrantTimers(StatefulProcessor):
    """The life of a grant: the first decision counts, a revocation after an approval ends it, and so does its timer.

    Times are microseconds; those of timers are milliseconds.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: The decision, and the end; 0 for a grant without an end.
        self.grant = handle.getValueState("grant", "status string, until long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._approve(initialState.until or 0)

    def _approve(self, until: int) -> None:
        self.grant.update(("approved", until))
        if until:
            self.handle.registerTimer(_timer(until))

    def handleInputRows(self, key, rows, timerValues):
        status, until = self.grant.get() or (None, 0)
        for row in sorted(rows, key=lambda r: (r.us, r.event)):
            if row.event == "approve" and status is None:
                status, until = "approved", 0 if row.ttl_minutes is None else row.us + row.ttl_minutes * 60_000_000
                self._approve(until)
                yield CHANGE(key[0], status, row.us, until or None)
            elif row.event == "deny" and status is None:
                status = "denied"
                self.grant.update((status, 0))
                yield CHANGE(key[0], status, row.us, None)
            elif row.event == "revoke" and status == "approved":
                status = "revoked"
                self.grant.update((status, 0))
                if until:
                    self.handle.deleteTimer(_timer(until))
                yield CHANGE(key[0], status, row.us, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # the moment of the end is still inside: it has passed once the watermark is beyond it
        until = self.grant.get()[1]
        self.grant.update(("expired", 0))
        yield CHANGE(key[0], "expired", until, None)

    def close(self) -> None:
        pass


def _timer(until: int) -> int:
    return -(-until // 1000)


def timed_grants(stream: DataFrame, initial: DataFrame | None = None, late: str = "10 minutes") -> DataFrame:
    """``request_id``, ``status``, ``at`` and ``expires_at`` of decisions, revocations and ends of grants, each once, as the watermark passes them.

    ``stream`` has ``request_id``, ``event`` (approve, deny, revoke), ``ts`` and
    ``ttl_minutes`` (null: no end).  ``initial`` are grants that are already approved
    (``request_id``, ``expires_at``), whose ends are seen too.  The query that reads this
    needs ``ROCKS`` as its state store.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    held = None if initial is None else initial.select("request_id", us("expires_at").alias("until")).groupBy("request_id")
    rows = stream.select("request_id", "event", F.col("ts").cast("timestamp").alias("ts"), us("ts").alias("us"), "ttl_minutes")
    found = rows.withWatermark("ts", late).groupBy("request_id").transformWithState(GrantTimers(), _CHANGES, "Append", "EventTime", initialState=held)
    return found.select("request_id", "status", F.timestamp_micros("at").alias("at"), F.timestamp_micros("expires_at").alias("expires_at"))


def run_now(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives of all that is there, written below a folder that all executors reach, and read."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
