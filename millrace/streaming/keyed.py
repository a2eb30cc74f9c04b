"""Keyed streaming state with timers and expiry: run deadlines and the registry of open records.

State lives in Spark's RocksDB store, one small row for each open key; finished keys leave it. Both jobs start
with :func:`keyed_store`, which selects that store for the session.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_store(spark: SparkSession) -> None:
    """Timers and expiry need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# Deadlines


class _Deadline(StatefulProcessor):
    """One timer for each unfinished run; state: start and last event in milliseconds, events seen."""

    def __init__(self, cap_ms: int, remember_ms: int):
        self.cap_ms, self.remember_ms = cap_ms, remember_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "started long, last long, n long, over boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started = last = None
        n, over, ended = 0, False, False
        if self.run.exists():
            started, last, n, over = self.run.get()
        if over:  # finished or halted already; late events change nothing
            for _ in rows:
                pass
            return
        before = started
        for batch in rows:
            at = batch["at"]
            started = int(at.min()) if started is None else min(started, int(at.min()))
            last = int(at.max()) if last is None else max(last, int(at.max()))
            n += len(batch)
            done = batch.loc[batch["ended"], "at"]
            ended = ended or len(done) > 0
            if len(done):
                last = int(done.min())
        if ended and last - started < self.cap_ms:
            if before is not None:
                self.handle.deleteTimer(before + self.cap_ms)
            self._leave(started, last, n, last)
            yield self._row(started, last, n, "finished")
            return
        if before != started:
            if before is not None:
                self.handle.deleteTimer(before + self.cap_ms)
            self.handle.registerTimer(started + self.cap_ms)
        self.run.update((started, last, n, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.run.exists():
            return
        started, last, n, over = self.run.get()
        if over or expiredTimerInfo.getExpiryTimeInMs() < started + self.cap_ms:
            if over:
                self.run.clear()
            return
        self._leave(started, last, n, started + self.cap_ms)
        yield self._row(started, last, n, "halted")

    def _leave(self, started: int, last: int, n: int, at: int) -> None:
        """Keep a mark for a while, so that late events don't start the run anew; a second timer drops it."""
        self.run.update((started, last, n, True))
        self.handle.registerTimer(at + self.remember_ms)

    def _row(self, started: int, last: int, n: int, status: str) -> pd.DataFrame:
        epoch = dt.datetime(1970, 1, 1)
        limit = epoch + dt.timedelta(milliseconds=started + self.cap_ms)
        return pd.DataFrame(
            {"started_at": [epoch + dt.timedelta(milliseconds=started)], "deadline_at": [limit], "last_at": [epoch + dt.timedelta(milliseconds=last)], "n_events": [n], "status": [status]}
        )

    def close(self) -> None:
        pass


def deadline_stream(events: DataFrame, cap_ms: int, ended: Column, delay: str = "1 hour", remember_ms: int = 86_400_000) -> DataFrame:
    """``run_id, started_at, deadline_at, last_at, n_events, status`` of runs that finished in time or are halted.

    ``events``: run_id and ts (a timestamp without zone counts as UTC). A run is halted by a timer as soon as the watermark
    (the newest event of any run, less ``delay``) passes its start plus ``cap_ms``, also if the run itself has gone
    silent. ``ended`` marks events that finish a run. Of a finished or halted run a mark stays in the state for
    ``remember_ms`` of event time.
    """
    keyed_store(events.sparkSession)
    ts = F.col("ts").cast("timestamp")
    rows = events.select("run_id", ts.alias("ts"), F.unix_millis(ts).alias("at"), F.coalesce(ended, F.lit(False)).alias("ended"))
    kind = events.schema["run_id"].dataType.simpleString()
    processor = _WithKey(_Deadline(cap_ms, remember_ms), "run_id")
    schema = f"run_id {kind}, started_at timestamp_ntz, deadline_at timestamp_ntz, last_at timestamp_ntz, n_events long, status string"
    return rows.withWatermark("ts", delay).groupBy("run_id").transformWithStateInPandas(processor, schema, "Update", "EventTime")


# Open and closed records


_CHANGE = Row("comm_id", "run_id", "opened_at", "model", "tokens", "closed_at", "status")


def _moment(message: Row) -> tuple[bool, int]:
    return message.at is None, message.at or 0


class _Registry(StatefulProcessor):
    """State of the open records of a key, as parallel arrays; closed ones leave marks that expire."""

    def __init__(self, remember_ms: int, kind: str):
        self.remember_ms, self.kind = remember_ms, kind

    def init(self, handle) -> None:
        self.open = handle.getValueState("open", f"comm_id array<{self.kind}>, run_id array<bigint>, opened_at array<bigint>, model array<string>, tokens array<bigint>")
        # Written anew with each closing, so when the store lets it expire every mark in it has expired too.
        self.closed = handle.getValueState("closed", f"comm_id array<{self.kind}>, until array<bigint>", self.remember_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        messages: dict[object, list[Row]] = {}
        for m in rows:
            messages.setdefault(m.comm_id, []).append(m)
        held, marks = self.open.get(), self.closed.get()
        known = {} if held is None else {c: fields for c, *fields in zip(*held)}
        closed = {} if marks is None else {c: until for c, until in zip(*marks) if until > now}
        changes, ended = [], False
        for comm_id, own in messages.items():
            if comm_id in closed:
                continue  # exported already
            run_id, opened_at, model, tokens = known.pop(comm_id, (None,) * 4)
            closed_at = None
            for m in sorted(own, key=_moment):
                if m.action == "open":
                    opened_at = m.at if opened_at is None else min(opened_at, m.at)
                run_id = run_id if m.run_id is None else m.run_id
                model = model if m.model is None else m.model
                tokens = tokens if m.tokens is None else m.tokens
                if m.action == "close":
                    closed_at = m.at
                    break
            if closed_at is None:
                known[comm_id] = run_id, opened_at, model, tokens
            else:
                closed[comm_id], ended = now + self.remember_ms, True
            changes.append(_CHANGE(comm_id, run_id, opened_at, model, tokens, closed_at, "open" if closed_at is None else "closed"))
        if known and changes:
            self.open.update(([*known], *map(list, zip(*known.values()))))
        elif held is not None and not known:
            self.open.clear()
        if ended:
            self.closed.update(([*closed], [*closed.values()]))
        yield from changes

    def close(self) -> None:
        pass


def registry_stream(messages: DataFrame, remember_ms: int = 86_400_000, groups: int | None = None) -> DataFrame:
    """Changes of communication records: comm_id, run_id, opened_at, model, tokens, closed_at, status.

    ``messages``: comm_id, run_id, action (open, enrich, close), at, model, tokens. Later messages fill in what
    earlier ones left out. Every batch gives one row for each record it touched; the row with status ``closed`` comes
    exactly once, when the record's state is dropped, and for ``remember_ms`` further messages of that record
    are ignored. Rows whose newest status is ``open`` are the records in flight.

    Each record has a row of state of its own. A call to the state store takes about a millisecond, so for very many records
    ``groups`` lets them share that many rows by hash: a batch then reads and writes a row for each group it touched.
    A group's open records, and its messages of a batch, are held in memory one group at a time.
    """
    keyed_store(messages.sparkSession)
    kind = messages.schema["comm_id"].dataType.simpleString()
    schema = f"comm_id {kind}, run_id long, opened_at long, model string, tokens long, closed_at long, status string"
    rows = messages.select("comm_id", "run_id", "action", "at", "model", "tokens")
    key = "comm_id"
    if groups is not None:
        key, rows = "group", rows.withColumn("group", F.pmod(F.xxhash64("comm_id"), F.lit(groups)))
    return rows.groupBy(key).transformWithState(_Registry(remember_ms, kind), schema, "Update", "ProcessingTime")


def communications_view(records: DataFrame) -> DataFrame:
    """Per run: the newest record in flight, how many there are, and the last record, from the latest row of each record."""
    at = F.struct("opened_at", "comm_id")
    open_ = F.col("status") == "open"
    return records.where("opened_at IS NOT NULL").groupBy("run_id").agg(
        F.max_by("comm_id", F.when(open_, at)).alias("in_flight"),
        F.count_if(open_).alias("n_in_flight"),
        F.max_by("comm_id", at).alias("last_comm"),
        F.max_by("tokens", at).alias("last_tokens"),
    )


class _WithKey(StatefulProcessor):
    """Puts the key in front of the rows of another processor."""

    def __init__(self, inner: StatefulProcessor, name: str):
        self.inner, self.name = inner, name

    def init(self, handle) -> None:
        self.inner.init(handle)

    def _named(self, key, frames):
        for frame in frames:
            frame.insert(0, self.name, key[0])
            yield frame

    def handleInputRows(self, key, rows, timerValues):
        yield from self._named(key, self.inner.handleInputRows(key, rows, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._named(key, self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo))

    def close(self) -> None:
        self.inner.close()
