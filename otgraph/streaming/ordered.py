"""Deadband on a stream whose events come out of order (T3): exact, with bounded state; rate cap on a stream.

Tags are dealt to slots by hash. Events wait in their slot's list state, in Arrow blocks, until the watermark has passed them;
an event-time timer then folds them in the order of their times, so shuffled input over any micro-batches keeps what the batch
deadband keeps. What is held is the events newer than the watermark and one last kept value per tag, those of a slot in one row. With ``expire`` a tag that has been silent for that
long (in event time) is forgotten; its next event counts as its first. ``initial`` hands over the last kept values
of a batch run (``last_kept``), so a stream goes on where the batch ended.

The rate cap counts the events of each ``unit`` of a gateway in a value state of its own, which an event-time timer clears when
no more can come, and lets the first ``n`` pass; what exceeds them is dropped, as in the batch form.

Needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` is set on the session by
``use_rocksdb``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from otgraph.operators.changes import _changed, change_columns_from_typed, deadband
from otgraph.operators.triples import latest_by

#: Slots that tags are dealt to: tags of a slot share state rows, timers and calls of Python.
SLOTS = 256
#: Events of one Arrow block of a slot's list state.
BLOCK_ROWS = 10_000
_LAST = "tag array<string>, kind array<string>, num array<double>, key array<string>, at array<bigint>"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _none(x):
    return None if x is None or x != x else x


def _block(pdf: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(pdf, preserve_index=False)
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


class OrderedDeadband(StatefulProcessor):
    """Rows carry the output columns, then ``_kind``, ``_num``, ``_key``, ``_ms`` (event time) and ``_tag``; keys are slots.
    ``names``, ``initial``: columns of the rows and of the initial state (names that begin with _ do not reach the frames)."""

    def __init__(self, threshold: float, columns: list[str], order: list[str], expire_ms: int | None, names: list[str], initial: list[str]):
        self.threshold, self.columns, self.order, self.expire_ms, self.names, self.initial = threshold, columns, order, expire_ms, names, initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _LAST)
        self.waiting = handle.getListState("waiting", "block binary")
        self.folded = handle.getValueState("folded", "mark long")      # the watermark of the last fold

    def _held(self) -> dict:
        return {t: (k, n, s, at) for t, k, n, s, at in zip(*self.last.get())} if self.last.exists() else {}

    def _hold(self, held: dict) -> None:
        if held:
            self.last.update(([*held], *(list(x) for x in zip(*held.values()))))
        else:
            self.last.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        held, initialState = self._held(), initialState.set_axis(self.initial, axis=1)
        for t, k, n, s, at in zip(*(initialState[c] for c in ("_tag", "_kind", "_num", "_key", "_ms"))):
            held[_none(t)] = (k, _none(n), _none(s), int(at))
        self._hold(held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                pdf = pdf.set_axis(self.names, axis=1)
                for a in range(0, len(pdf), BLOCK_ROWS):
                    self.waiting.appendValue((_block(pdf.iloc[a:a + BLOCK_ROWS]),))
                low = int(pdf["_ms"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            # fires when the watermark has passed the first of them
            self.handle.registerTimer(first + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        if self.folded.exists() and self.folded.get()[0] == mark:         # another timer has come before
            return
        self.folded.update((mark,))
        due, later, low = [], [], {}
        for (block,) in self.waiting.get() if self.waiting.exists() else ():
            pdf = pa.ipc.open_stream(bytes(block)).read_pandas()
            now = pdf["_ms"] < mark
            if now.any():
                due.append(pdf[now])
            rest = pdf[~now]
            if len(rest):
                later.append(rest)
                for t, ms in zip(rest["_tag"], rest["_ms"]):
                    low[_none(t)] = min(ms, low.get(_none(t), ms))
        held = self._held()
        if due:
            pdf = pd.concat(due, ignore_index=True)
            walk = pdf[list(dict.fromkeys([*self.order, "_tag", "_kind", "_num", "_key"]))].sort_values(self.order, kind="mergesort")
            keep = np.zeros(len(pdf), bool)
            for i, t, k, n, s, ms in zip(walk.index, walk["_tag"], walk["_kind"], walk["_num"], walk["_key"], walk["_ms"]):
                t, ms = _none(t), int(ms)
                last = held.get(t, ("NULL", None, None, None))
                if self.expire_ms and last[3] is not None and ms - last[3] >= self.expire_ms:
                    last = ("NULL", None, None, None)
                if _changed(k, n, s, *last[:3], self.threshold):
                    keep[i] = True
                    held[t] = (k, float(n) if k == "NUMBER" else None, _none(s), ms)
                else:
                    held[t] = (*last[:3], ms)
            blocks = [(_block(x),) for x in _cut(later)]
            if blocks:
                self.waiting.put(blocks)
            else:
                self.waiting.clear()
        ends = [int(x) + 1 for x in low.values()]
        if self.expire_ms:
            held = {t: x for t, x in held.items() if t in low or x[3] is None or x[3] + self.expire_ms >= mark}
            ends += [x[3] + self.expire_ms + 1 for t, x in held.items() if t not in low and x[3] is not None]
        self._hold(held)
        if ends:
            self.handle.registerTimer(max(mark + 1, min(ends)))
        if due and keep.any():
            yield pdf.loc[keep, self.columns]


def _cut(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Some frames in blocks of ``BLOCK_ROWS``."""
    held, size = [], 0
    for p in parts:
        if held and size + len(p) > BLOCK_ROWS:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
        held.append(p)
        size += len(p)
    if held:
        yield pd.concat(held, ignore_index=True)


def _typed(df: DataFrame, ts: str) -> DataFrame:
    cols = change_columns_from_typed()
    return df.withColumns({"_kind": cols["kind"], "_num": cols["num"], "_key": cols["key"], "_ms": F.unix_millis(F.col(ts).cast("timestamp"))})


def last_kept(df: DataFrame, threshold: float, tag: str = "tag_path", ts: str = "event_time") -> DataFrame:
    """The last kept value of every tag after the batch deadband: the initial state of a stream that goes on from there."""
    kept = _typed(deadband(df, threshold, tag=tag), ts)
    return latest_by(kept, [tag], "_ms", ["_kind", "_num", "_key"]).select(tag, "_kind", "_num", "_key", "_ms")


def ordered_deadband_stream(stream: DataFrame, threshold: float, delay: str, tag: str = "tag_path", ts: str = "event_time",
                            tie: str = "event_id", expire_ms: int | None = None, initial: DataFrame | None = None, slots: int = SLOTS) -> DataFrame:
    """The batch deadband (F6) of a stream whose events are at most ``delay`` late."""
    use_rocksdb(stream.sparkSession)
    columns = list(stream.columns)
    deal = lambda df: df.withColumn("_tag", F.col(tag).cast("string")).withColumn("_slot", F.pmod(F.xxhash64("_tag"), F.lit(int(slots))).cast("int"))
    rows = deal(_typed(stream.withWatermark(ts, delay), ts))
    out = rows.select(*columns).schema
    initial = deal(initial) if initial is not None else None
    processor = OrderedDeadband(float(threshold), columns, list(dict.fromkeys(["_ms", ts, tie])), expire_ms, rows.columns,
                                initial.columns if initial is not None else [])
    return rows.groupBy("_slot").transformWithStateInPandas(processor, out, "Append", "EventTime",
                                                            initialState=initial.groupBy("_slot") if initial is not None else None)


class RateCap(StatefulProcessor):
    """Rows carry the output columns, then ``_unit`` (milliseconds of the start of the unit)."""

    def __init__(self, n: int, columns: list[str], order: list[str], keep_ms: int):
        self.n, self.columns, self.order, self.keep_ms = n, columns, order, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        done = self.passed.get()[0] if self.passed.exists() else 0
        room = max(0, self.n - done)
        # at most n rows of a unit are held, however many come
        first = heapq.nsmallest(room, rows, key=lambda r: tuple(r[c] for c in self.order))
        for r in first:
            yield Row(*self.columns)(*[r[c] for c in self.columns])
        self.passed.update((done + len(first),))
        self.handle.registerTimer(int(key[-1]) + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.passed.clear()
        return iter(())


_UNIT_MS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def rate_cap_stream(stream: DataFrame, n: int, ts: str = "ingest_ts", unit: str = "second", tie: str = "event_id",
                    gateway: str = "source_system", delay: str = "10 minutes") -> DataFrame:
    """The first ``n`` events of each ``unit`` and gateway (F7): those of earlier micro-batches first, within one by (ts, tie).
    Events more than ``delay`` late are dropped."""
    use_rocksdb(stream.sparkSession)
    columns = list(stream.columns)
    rows = stream.withWatermark(ts, delay).withColumn("_unit", F.unix_millis(F.date_trunc(unit, F.col(ts))))
    out = rows.select(*columns).schema
    processor = RateCap(int(n), columns, [ts, tie], _UNIT_MS[unit])
    return rows.groupBy(gateway, "_unit").transformWithState(processor, out, "Append", "EventTime")
