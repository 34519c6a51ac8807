"""Deadband filter with state across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from otgraph.operators.changes import _changed, change_columns_from_typed
from otgraph.session import duration_ms

__all__ = ["deadband_stream"]

#: Slots that tags are dealt to: tags of a slot share a state row and a call of Python.
SLOTS = 256
_STATE = "tag array<string>, kind array<string>, num array<double>, key array<string>, seen array<bigint>"


def _none(x):
    return None if x is None or x != x else x


def deadband_stream(stream: DataFrame, threshold: float, tag: str = "tag_path",
                    order: tuple[str, ...] = ("event_time", "event_id"),
                    timeout: str | None = None, slots: int = SLOTS) -> DataFrame:
    """The batch deadband (F6) on a stream: per tag the last kept value lives in the state
    store, events of a micro-batch are folded in event-time order (T3). With ``timeout`` the
    state of a silent tag expires after that processing-time duration.

    Tags are dealt to ``slots`` by hash; the last values of a slot's tags are one state row, and its events
    one sorted walk, so what a call costs is not paid per tag."""
    cols = change_columns_from_typed()
    name = F.col(tag).cast("string")
    base = stream.withColumns({"_kind": cols["kind"], "_num": cols["num"], "_key": cols["key"], "_tag": name,
                               "_slot": F.pmod(F.xxhash64(name), F.lit(int(slots))).cast("int")})
    out_cols = list(stream.columns)
    schema = base.select(*out_cols).schema
    thr = float(threshold)
    order = list(order)
    silent = duration_ms(timeout) if timeout else None

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if silent else 0
        held = {t: (k, n, s, at) for t, k, n, s, at in zip(*state.get)} if state.exists else {}
        if not state.hasTimedOut:
            parts = list(pdfs)
            if not parts:
                return
            small = pd.concat([p[list(dict.fromkeys([*order, "_tag", "_kind", "_num", "_key"]))] for p in parts], ignore_index=True)
            walk = small.sort_values(order, kind="mergesort")
            keep = np.zeros(len(small), bool)
            for i, t, k, n, s in zip(walk.index, walk["_tag"], walk["_kind"], walk["_num"], walk["_key"]):
                t = _none(t)
                lk, ln, lkey, _ = held.get(t, ("NULL", None, None, 0))
                if _changed(k, n, s, lk, ln, lkey, thr):
                    keep[i] = True
                    held[t] = (k, float(n) if k == "NUMBER" else None, _none(s), now)
                else:
                    held[t] = (lk, ln, lkey, now)
            end = 0
            for p in parts:
                mine = keep[end:end + len(p)]
                end += len(p)
                if mine.any():
                    yield p.loc[mine, out_cols]
        if silent:                                       # tags of this micro-batch have just been seen
            held = {t: x for t, x in held.items() if x[3] + silent > now}
        if held:
            state.update(([*held], *(list(x) for x in zip(*held.values()))))
            if silent:
                state.setTimeoutDuration(max(1, min(x[3] for x in held.values()) + silent - now))
        elif state.exists:
            state.remove()

    return base.groupBy("_slot").applyInPandasWithState(
        fn, outputStructType=schema, stateStructType=_STATE, outputMode="append",
        timeoutConf=GroupStateTimeout.ProcessingTimeTimeout if timeout
        else GroupStateTimeout.NoTimeout)
