"""What a recorder keeps of chatty sources. Rules that depend on the last row kept are folds over sorted partitions; the rest are windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drivelake.streaming.keyed import keyed_stream


def newly_seen(members: DataFrame) -> DataFrame:
    """Members of scans (drive_id, t_ns, seq, seen_ns) that were seen later than all members of earlier scans."""
    before = Window.partitionBy("drive_id").orderBy("t_ns").rangeBetween(Window.unboundedPreceding, -1)
    return members.withColumn("_p", F.max("seen_ns").over(before)).filter("_p IS NULL OR seen_ns > _p").drop("_p")


def at_most_every(rows: DataFrame, watched: list[str], period_s: float, least_s: float = 0.0) -> DataFrame:
    """Rows of each drive that differ from the last one kept in a watched column, or come period_s after it or later; none sooner than least_s.

    Rows stream through a task in the order (t_ns, seq), with the last one kept in memory. Rows without a drive or time are left out.
    """
    period, least = int(period_s * 1e9), int(least_s * 1e9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drive, last, t_last = None, None, 0
        for b in batches:
            keep = []
            for key, t, *now in zip(*(b.column(c).to_pylist() for c in ("drive_id", "t_ns", *watched))):
                ok = key != drive or (t - t_last >= least and (now != last or t - t_last >= period))
                keep.append(ok)
                if ok:
                    drive, last, t_last = key, now, t
            yield b.filter(pa.array(keep, pa.bool_()))

    ordered = rows.filter("drive_id IS NOT NULL AND t_ns IS NOT NULL").repartition("drive_id").sortWithinPartitions("drive_id", "t_ns", "seq")
    return ordered.mapInArrow(run, rows.schema)


class _Kept:
    """Rows that differ from the last one kept, or come a period after it."""

    def __init__(self, period_ns: int, least_ns: int):
        self.period, self.least, self.last, self.at = period_ns, least_ns, None, None

    def take(self, row: tuple, late: bool = False) -> list[tuple]:
        t, _, seq, *now = row
        if self.at is not None and (t - self.at < self.least or now == self.last and t - self.at < self.period):
            return []
        self.last, self.at = now, t
        return [(t, seq, *now)]


def at_most_every_stream(rows: DataFrame, watched: list[str], period_s: float, least_s: float = 0.0, reorder_ns: int = 500_000_000, flush_ms: int = 2000, forget_ms: int = 600_000) -> DataFrame:
    """drive_id, t_ns, seq and the watched columns of the rows of a stream that at_most_every keeps, under the conditions of keyed_stream."""
    period, least = int(period_s * 1e9), int(least_s * 1e9)
    kinds = dict(rows.dtypes)
    ready = rows.filter("drive_id IS NOT NULL AND t_ns IS NOT NULL").withColumn("rank", F.lit(0))
    out = ", ".join(["t_ns long", "seq long", *(f"{c} {kinds[c]}" for c in watched)])
    return keyed_stream(ready, ["t_ns", "rank", "seq", *watched], lambda: _Kept(period, least), out, reorder_ns, flush_ms, forget_ms)
