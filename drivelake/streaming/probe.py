"""When to let real satellite fixes through while our own output replaces them: a state machine over statuses, verdicts and ticks.

A window opens when the receiver has looked healthy for a while, and closes with the first clear verdict or after a time; failures double the pause.
After some recoveries in a row the real fixes stay (passthrough) until they are lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivelake.streaming.keyed import keyed_stream

#: Reasons of a rejection that don't speak against the receiver, and those that mark our own output.
AMBIGUOUS = {"INNOVATION_GATE", "RECOVERING"}
OWN = {"SOURCE_OVERRIDDEN", "SYNTHETIC_INPUT"}


@dataclass(frozen=True)
class ProbeRules:
    """Seconds, but for the number of recoveries that lead to passthrough (0: never)."""

    healthy_s: float = 10.0
    pause_s: float = 60.0
    longest_pause_s: float = 300.0
    window_s: float = 20.0
    no_fix_s: float = 12.0
    status_age_s: float = 3.0
    recoveries: int = 2
    loss_s: float = 5.0
    unhealthy_s: float = 5.0


class Probe:
    """One drive's state. Times are nanoseconds; phase is IDLE, WINDOW or PASSTHROUGH."""

    def __init__(self, rules: ProbeRules = ProbeRules()):
        self.rules, self.phase, self.result = rules, "IDLE", "NONE"
        self.healthy, self.status_at, self.healthy_since, self.ill_since = None, None, None, None
        self.pause_s, self.ended, self.opened, self.fix_seen = rules.pause_s, None, 0, False
        self.verdict, self.recovered, self.trusted_at = None, 0, 0

    def on_status(self, t: int, healthy: bool) -> None:
        self.healthy, self.status_at = healthy, t
        self.healthy_since = (t if self.healthy_since is None else self.healthy_since) if healthy else None

    def on_verdict(self, t: int, source: str, state: str, reasons: set[str]) -> None:
        """Verdicts of real satellite fixes while they are let through; what only disagrees with our estimate says nothing."""
        if source != "GNSS" or reasons & OWN or self.phase == "IDLE" or self.phase == "WINDOW" and t < self.opened:
            return
        hard = state == "REJECTED" and not reasons <= AMBIGUOUS
        if self.phase == "PASSTHROUGH":
            if state == "TRUSTED":
                self.trusted_at = t
            elif hard:
                self.verdict = "LOST"
        else:
            self.fix_seen = True
            self.verdict = "RECOVERED" if state == "TRUSTED" else "FAILED" if hard else self.verdict

    def step(self, t: int) -> str:
        """NONE, OPEN, CLOSE or HOLD; to be asked about once a second."""
        since = lambda x: (t - x) / 1e9
        r = self.rules
        if self.phase == "IDLE":
            fresh = self.status_at is not None and since(self.status_at) <= r.status_age_s
            if not (fresh and self.healthy_since is not None and since(self.healthy_since) >= r.healthy_s and (self.ended is None or since(self.ended) >= self.pause_s)):
                return "NONE"
            self.phase, self.opened, self.fix_seen, self.verdict = "WINDOW", t, False, None
            return "OPEN"
        if self.phase == "WINDOW":
            late = since(self.opened) >= (r.window_s if self.fix_seen else min(r.window_s, r.no_fix_s))
            result = self.verdict or ("FAILED" if late else None)
            if result is None:
                return "NONE"
            self.recovered = self.recovered + 1 if result == "RECOVERED" else 0
            if 0 < r.recoveries <= self.recovered:
                self.phase, self.result, self.recovered, self.trusted_at, self.ill_since, self.verdict = "PASSTHROUGH", result, 0, t, None, None
                return "HOLD"
            self.pause_s = r.pause_s if result == "RECOVERED" else min(2 * self.pause_s, r.longest_pause_s)
        else:
            self.ill_since = None if self.healthy is not False else t if self.ill_since is None else self.ill_since
            lost = since(self.trusted_at) >= r.loss_s or self.ill_since is not None and since(self.ill_since) >= r.unhealthy_s
            result = self.verdict or ("LOST" if lost else None)
            if result is None:
                return "NONE"
            self.pause_s, self.recovered = r.pause_s, 0
        self.phase, self.result, self.ended = "IDLE", result, t
        return "CLOSE"


def _probe_rows(statuses: DataFrame, verdicts: DataFrame, ticks: DataFrame) -> DataFrame:
    """All three as (drive_id, t_ns, rank, seq, a, b, c): at equal times statuses come first, then verdicts, then ticks. Rows without drive or time are left out."""
    lit = F.lit
    none = lit(None).cast("string")
    rows = statuses.select("drive_id", "t_ns", lit(0).alias("rank"), "seq", F.col("healthy").cast("string").alias("a"), none.alias("b"), none.alias("c"))
    rows = rows.unionByName(verdicts.select("drive_id", "t_ns", lit(1).alias("rank"), "seq", F.col("source").alias("a"), F.col("state").alias("b"), F.col("reasons").alias("c")))
    rows = rows.unionByName(ticks.select("drive_id", "t_ns", lit(2).alias("rank"), F.col("t_ns").alias("seq"), none.alias("a"), none.alias("b"), none.alias("c")))
    return rows.filter("drive_id IS NOT NULL AND t_ns IS NOT NULL")


class _Actions:
    """The probe as a fold over rows."""

    def __init__(self, rules: ProbeRules):
        self.probe = Probe(rules)

    def take(self, row: tuple, late: bool = False) -> list[tuple]:
        t, rank, _, a, b, c = row
        if rank == 0:
            self.probe.on_status(t, a == "true")
        elif rank == 1:
            self.probe.on_verdict(t, a, b, set(filter(None, (c or "").split(","))))
        elif (action := self.probe.step(t)) != "NONE":
            return [(t, action, self.probe.phase, self.probe.result)]
        return []


_OUT = "t_ns long, action string, phase string, result string"
_IN = ["t_ns", "rank", "seq", "a", "b", "c"]


def probe_actions(statuses: DataFrame, verdicts: DataFrame, ticks: DataFrame, rules: ProbeRules = ProbeRules()) -> DataFrame:
    """drive_id, t_ns, action, phase, result of every tick at which something is done.

    statuses: drive_id, t_ns, seq, healthy; verdicts: drive_id, t_ns, seq, source, state, reasons (comma text); ticks: drive_id, t_ns. At equal times statuses come
    first, then verdicts. Rows stream through a task drive by drive, with one state in memory.
    """
    rows = _probe_rows(statuses, verdicts, ticks)
    kind = rows.schema["drive_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drive, fold = None, _Actions(rules)
        for batch in batches:
            out: list[tuple] = []
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != drive:
                    drive, fold = key, _Actions(rules)
                out += [(key, *x) for x in fold.take(row)]
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int64()), *(pa.array(x, pa.string()) for x in columns[2:])], ["drive_id", "t_ns", "action", "phase", "result"])

    ordered = rows.select("drive_id", *_IN).repartition("drive_id").sortWithinPartitions("drive_id", "t_ns", "rank", "seq")
    return ordered.mapInArrow(run, f"drive_id {kind}, {_OUT}")


def probe_stream(statuses: DataFrame, verdicts: DataFrame, ticks: DataFrame, rules: ProbeRules = ProbeRules(), reorder_ns: int = 500_000_000, flush_ms: int = 2000, forget_ms: int = 600_000) -> DataFrame:
    """The actions of streams of statuses, verdicts and ticks, equal to those of probe_actions under the conditions of keyed_stream."""
    return keyed_stream(_probe_rows(statuses, verdicts, ticks), _IN, lambda: _Actions(rules), _OUT, reorder_ns, flush_ms, forget_ms)
