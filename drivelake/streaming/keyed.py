"""Folds over keyed state: a drive's rows wait for late ones, go through its fold in order, and its state goes when it has been silent for long."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Fold(Protocol):
    def take(self, row: tuple, late: bool) -> list[tuple]:
        """What a row gives; rows come in order but for late ones."""


def keyed_stream(rows: DataFrame, columns: list[str], make: Callable[[], Fold], out: str, reorder_ns: int = 500_000_000, flush_ms: int = 2000, forget_ms: int = 600_000) -> DataFrame:
    """drive_id and out (a DDL text) of a stream of rows (drive_id and columns, of which the first three are t_ns, rank and seq).

    Rows wait in their drive's state until one comes that is reorder_ns later, and are taken in the order (t_ns, rank, seq), so what comes out is what a
    fold over sorted rows gives, if no row comes more than reorder_ns behind a later one of its drive. What comes later still is taken at once, as late. End of
    input isn't told to a stream: a drive that no micro-batch has brought rows for flush_ms of processing time is flushed, so flush_ms must be longer than
    a source may stall; after forget_ms without rows its state is removed, and it begins anew should it come back. State is one fold and the rows of reorder_ns.
    """
    kind = rows.schema["drive_id"].dataType.simpleString()
    names = [c.strip().split(" ")[0] for c in out.split(", ")]
    lists = {c.split(" ")[0] for c in out.split(", ") if "array<" in c}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold, waiting, seen, done = pickle.loads(state.get[0]) if state.exists else (make(), [], -(1 << 62), -(1 << 62))
        if state.hasTimedOut and not waiting:
            state.remove()
            return
        for b in batches:
            values = [[None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v for v in b[c].astype(object).tolist()] for c in columns]
            waiting += zip(*values)
        seen = max([seen, *(x[0] for x in waiting)])
        limit = seen if state.hasTimedOut else seen - reorder_ns
        waiting.sort(key=lambda x: x[:3])
        ready, waiting = [x for x in waiting if x[0] <= limit], [x for x in waiting if x[0] > limit]
        told = []
        for x in ready:
            told += fold.take(x, x[0] < done)
            done = x[0]
        state.update((pickle.dumps((fold, waiting, seen, done)),))
        state.setTimeoutDuration(flush_ms if waiting else forget_ms)
        if told:
            frame = pd.DataFrame(told, columns=names)
            for c in lists:
                frame[c] = [None if v is None else list(v) for v in frame[c]]
            frame.insert(0, "drive_id", key[0])
            yield frame

    picked = rows.select("drive_id", *columns)
    return picked.groupBy("drive_id").applyInPandasWithState(run, f"drive_id {kind}, {out}", "memory binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
