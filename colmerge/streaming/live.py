"""Streaming forms: a file stream of changes folded into winners, notifications, views and debounced pushes.

The state of conflict resolution has no end by design (a late change may always win), so no watermark is set. The folds that aggregate are
streaming aggregations; those that need the state of before are ``foreachBatch`` over the log of state, each batch a run of it and a new pointer.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from colmerge.operators.notify import notifications
from colmerge.operators.resolve import winners
from colmerge.operators.state import merged
from colmerge.sources.statelog import StateLog
from colmerge.sources.tables import CHANGELOG, TOMBSTONE

EVENTS = StructType().add("event_id", "long").add("ts", "timestamp_ntz").add("user_id", "long").add("event_type", "string").add("value", "double").add("props", "string")


#: Kinds of a run's events by number, and no events.
SYNCED, CONNECTED, _NO_EVENTS = 1, 2, np.zeros((0, 3), np.int64)


def _stateful(spark: SparkSession) -> None:
    """Processors with state of several kinds need a state store with column families, which is RocksDB's."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, None) or ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_files(spark: SparkSession, folder: str, name: str, schema: StructType, per_batch: int = 1) -> DataFrame:
    """A stream of the files of one name in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_batch).parquet(folder)


def stream_winners(changes: DataFrame) -> DataFrame:
    """The winning change of each cell so far: a streaming aggregation, for update or complete mode."""
    return winners(changes)


def stream_state(changes: DataFrame) -> DataFrame:
    """The state so far, tombstones included: as ``stream_winners``, and any operator of converged mode can read it."""
    return merged(changes)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands everything that is there to ``sink``, in batches, and stops. A batch is handed on again after a failure."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def apply_stream(changes: DataFrame, log: StateLog, notified: str, checkpoint: str, policy: str, raw: str | None = None) -> None:
    """Commits a stream of changes to the log, and writes each batch's notifications under ``notified``, and what came, unresolved, under ``raw``.

    The log's ledger has the last batch of each stream (by the id in its checkpoint), and changes in one step with the state. A batch is told against the state
    before it, then committed. Handed on again before that, it is told once more, in the place of what was written; after that, it is left
    alone, and what it told stands. ``told`` reads what belongs to committed batches.
    """
    spark = changes.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if number <= log.committed(stream):
            return
        delta = batch.select(*CHANGELOG.names).persist()
        if raw:
            delta.write.mode("overwrite").parquet(f"{raw}/stream={stream}/batch={number}")
        notifications(log.read(delta.select("tbl", "pk")), delta, policy).write.mode("overwrite").parquet(f"{notified}/stream={stream}/batch={number}")
        log.commit(delta, number, stream)
        log.fold()
        delta.unpersist()

    run_available(changes, one, checkpoint)


def told(log: StateLog, folder: str) -> DataFrame | None:
    """What ``apply_stream`` wrote under a folder for the batches that are committed, with ``stream`` and ``batch``; None if there are none."""
    last = log.ledger()
    if not last:
        return None
    rows = log.spark.read.option("basePath", folder).parquet(*[f"{folder}/stream={stream}" for stream in last])
    done = F.lit(False)
    for stream, batch in last.items():
        done = done | ((F.col("stream") == stream) & (F.col("batch") <= batch))
    return rows.filter(done)


def _text(val: Any) -> str | None:
    """A text of a pandas column, in which nulls may have other forms."""
    return val if isinstance(val, str) else None


class ReactiveRow(StatefulProcessor):
    """A row of a view that follows its notifications: inserts and updates patch cells, a delete drops the row.

    A batch's events are folded as they come; what is held is the last write of each cell and the last delete. The output names the delete, so that
    a sink can drop the row, and the cells that are there.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        # as many cells as the table has columns, so they are read and written at once
        self.cells = handle.getValueState("cells", "cells string")

    def _held(self) -> dict[str, tuple[str | None, int]]:
        held = self.cells.get()
        return {cid: (val, position) for cid, val, position in json.loads(held[0])} if held else {}

    def _hold(self, cells: dict[str, tuple[str | None, int]]) -> None:
        self.cells.update((json.dumps([(cid, *cell) for cid, cell in cells.items()]),))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self._hold(self._held() | {cid: (_text(val), int(position)) for cid, val, position in zip(*(initialState[c] for c in ("cid", "val", "position")), strict=True)})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = self._held()
        gone = last.pop(TOMBSTONE, (None, -1))[1]
        deleted = False
        for part in rows:
            for cid, val, position in zip(part["cid"].tolist(), part["val"].tolist(), part["position"].tolist(), strict=True):
                if cid == TOMBSTONE:
                    gone, deleted = max(gone, int(position)), True
                elif cid not in last or position >= last[cid][1]:
                    last[cid] = _text(val), int(position)
        last = {cid: cell for cid, cell in last.items() if cell[1] > gone}
        kept = last | ({TOMBSTONE: (None, gone)} if gone >= 0 else {})
        self._hold(kept)
        shown = sorted((kept if deleted else last).items())
        yield pd.DataFrame([(*key, cid, *cell) for cid, cell in shown] or None, columns=["tbl", "pk", "cid", "val", "position"])

    def close(self) -> None:
        pass


def reactive_view(events: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Cells of each row that changed, after each batch of events (tbl, pk, cid, val, position).

    ``start`` has the cells (same columns) that rows begin with, as a snapshot or ``fold_view`` gives them: a view loads the state that is there, then follows.
    """
    _stateful(events.sparkSession)
    columns = ["tbl", "pk", "cid", "val", "position"]
    keyed = events.select(*columns).groupBy("tbl", "pk")
    state = start.select(*columns).groupBy("tbl", "pk") if start is not None else None
    return keyed.transformWithStateInPandas(ReactiveRow(), "tbl string, pk string, cid string, val string, position long", "Update", "None", initialState=state)


class Debounced(StatefulProcessor):
    """One push at once, the last of those within the cooldown at its end: ``operators.peers.debounce`` by processing time, whenever its timers run.

    A push that waited past its time fires before a newer event is looked at, as of its time. A timer of a cooldown that was followed by another is ignored.
    """

    def __init__(self, cooldown_ms: int):
        self.cooldown = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "until long, waiting string")

    def _fired(self, key: Any, at: int, edge: str, payload: str) -> pd.DataFrame:
        return pd.DataFrame([(*key, at, edge, payload)], columns=["topic", "fired_at", "edge", "payload"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        before, waiting = self.state.get() if self.state.exists() else (None, None)
        until = before
        for part in rows:
            for payload in part["payload"]:
                if waiting is not None and until <= now:
                    yield self._fired(key, until, "trailing", waiting)
                    until, waiting = until + self.cooldown, None
                if until is None or now >= until:
                    yield self._fired(key, now, "leading", payload)
                    until, waiting = now + self.cooldown, None
                else:
                    waiting = payload
        self.state.update((until, waiting))
        if until != before:
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until, waiting = self.state.get() if self.state.exists() else (None, None)
        if until is None or expiredTimerInfo.getExpiryTimeInMs() < until:
            return
        if waiting is None:
            self.state.clear()
            return
        yield self._fired(key, until, "trailing", waiting)
        self.state.update((until + self.cooldown, None))
        self.handle.registerTimer(until + self.cooldown)

    def close(self) -> None:
        pass


def debounced(events: DataFrame, cooldown_ms: int) -> DataFrame:
    """Pushes of a stream of (topic, payload), by processing time."""
    _stateful(events.sparkSession)
    return events.select("topic", "payload").groupBy("topic").transformWithStateInPandas(Debounced(cooldown_ms), "topic string, fired_at long, edge string, payload string", "Append", "ProcessingTime")


class _Timely(StatefulProcessor):
    """Events of a key wait until the watermark has passed them, and are then folded in the order of their times.

    So the result doesn't depend on how events are dealt out to batches, but for those that come later than the watermark allows. What waits is
    bounded by that delay; it is held in blocks of times, positions and kinds, so that the state is asked once for many events. Events that repeat time and
    position count once.
    """

    #: The most events of a block.
    block = 1 << 14

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "events binary")

    def _folded(self, key: Any, due: np.ndarray, now: int) -> tuple[list[tuple], list[int]]:
        """Rows that follow from events (time, position, kind) before ``now``, and times at which there may be more."""
        raise NotImplementedError

    def _blocks(self, events: np.ndarray) -> list[tuple[bytes]]:
        return [(events[k : k + self.block].tobytes(),) for k in range(0, len(events), self.block)]

    def _advance(self, key: Any, now: int, came: np.ndarray) -> Iterator[pd.DataFrame]:
        stored = [np.frombuffer(bytes(events), np.int64).reshape(-1, 3) for (events,) in self.pending.get()]
        held = np.concatenate([*stored, came])
        early = held[:, 0] < now
        due, waiting = held[early], held[~early]
        if len(due) and len(waiting):
            self.pending.put(self._blocks(waiting))
        elif len(due):
            if stored:
                self.pending.clear()
        elif len(came):
            self.pending.appendList(self._blocks(came))
        # what comes last of those that repeat time and position counts
        due = due[np.lexsort((due[:, 1], due[:, 0]))]
        due = due[np.append((due[1:, :2] != due[:-1, :2]).any(axis=1), True)] if len(due) else due
        rows, times = self._folded(key, due, now)
        if rows:
            yield pd.DataFrame([(*key, *row) for row in rows], columns=[self.key, *self.columns])
        if len(waiting):
            times.append(int(waiting[:, 0].min()))
        if times:
            self.handle.registerTimer(max(min(times), now) + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = [part[["at_ms", "position", "kind"]].to_numpy(np.int64) for part in rows]
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), np.concatenate(came) if came else _NO_EVENTS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), _NO_EVENTS)

    def close(self) -> None:
        pass


class TimelyDebounce(_Timely):
    """``operators.peers.debounce`` over a stream, by the events' own times."""

    key, columns = "topic", ("fired_at", "edge", "position")

    def __init__(self, cooldown_ms: int):
        self.cooldown = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "until long, waiting long")

    def _folded(self, key: Any, due: np.ndarray, now: int) -> tuple[list[tuple], list[int]]:
        until, waiting = self.state.get() or (None, None)
        ats, positions, rows, k = due[:, 0], due[:, 1], [], 0
        while True:
            at = int(ats[k]) if k < len(ats) else now  # after the events: what is known up to now
            if waiting is not None and until <= at:
                rows.append((until, "trailing", waiting))
                until, waiting = until + self.cooldown, None
            if k == len(ats):
                break
            if until is None or at >= until:
                rows.append((at, "leading", int(positions[k])))
                until, waiting, k = at + self.cooldown, None, k + 1
            else:  # of all that come before its end, the last one waits
                k = int(np.searchsorted(ats, until))
                waiting = int(positions[k - 1])
        if waiting is None and (until is None or until <= now):
            self.state.clear()  # the next event is as a topic's first
            return rows, []
        self.state.update((until, waiting))
        return rows, [until]


class TimelyOutcome(_Timely):
    """``operators.metrics.sync_outcome`` over a stream: a run's outcome is told once it can't change, ``grace`` after its first sync or ``timeout`` after its start."""

    key, columns = "run_id", ("outcome", "synced")

    def __init__(self, grace_ms: int, timeout_ms: int):
        self.grace, self.timeout = grace_ms, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "begun long, end long, synced long, seen long, told boolean")

    def _folded(self, key: Any, due: np.ndarray, now: int) -> tuple[list[tuple], list[int]]:
        begun, end, synced, seen, told = self.state.get() or (None, None, 0, 0, False)
        for at, _, kind in due.tolist():
            if begun is None:
                begun, end = at, at + self.timeout
            if at <= end and not told:
                if kind == SYNCED and not synced:
                    end = min(end, at + self.grace)
                synced, seen = synced + (kind == SYNCED), seen + (kind == CONNECTED)
        rows = []
        if begun is not None and not told and end < now:
            rows, told = [("Synced" if synced else "TimedOut" if seen else "NoPeers", synced)], True
        if len(due) or rows:
            self.state.update((begun, end, synced, seen, told))
        return rows, [] if told or begun is None else [end]


def debounced_by_time(events: DataFrame, cooldown_ms: int, late: str) -> DataFrame:
    """Pushes (topic, fired_at in ms, edge, position) of a stream of (topic, at: timestamp, position); events may be ``late`` by so much."""
    _stateful(events.sparkSession)
    timed = events.withWatermark("at", late).select("topic", "at", "position", F.unix_millis("at").alias("at_ms"), F.lit(0).cast("long").alias("kind"))
    return timed.groupBy("topic").transformWithStateInPandas(TimelyDebounce(cooldown_ms), "topic string, fired_at long, edge string, position long", "Append", "EventTime")


def outcomes_by_time(events: DataFrame, grace_ms: int, timeout_ms: int, late: str) -> DataFrame:
    """(run_id, outcome, synced) of a stream of (run_id, event_type, at: timestamp, position); events may be ``late`` by so much."""
    _stateful(events.sparkSession)
    kind = F.when(F.col("event_type") == "peer_synced", SYNCED).when(F.col("event_type") == "peer_connected", CONNECTED).otherwise(0).cast("long")
    timed = events.withWatermark("at", late).select("run_id", "at", "position", F.unix_millis("at").alias("at_ms"), kind.alias("kind"))
    return timed.groupBy("run_id").transformWithStateInPandas(TimelyOutcome(grace_ms, timeout_ms), "run_id long, outcome string, synced long", "Append", "EventTime")


def windowed_counts(events: DataFrame, size: str, late: str) -> DataFrame:
    """(starts, event_type, n): events per kind and time window, with a watermark: for operational counters, whose state may end.

    Times are without a zone; they are read as UTC, whatever the session's zone is, so that days begin at midnight.
    """
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    timed = events.withColumn("at", F.timestamp_micros(micros)).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"))
    starts = F.expr("timestampadd(MICROSECOND, unix_micros(window.start), TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    return counts.select(starts.alias("starts"), "event_type", "n")
