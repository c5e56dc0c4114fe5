"""A dead-reckoned path laid over coarse fixes: turned and moved, never stretched, by what fixes of the last minutes say."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drivelake.functions import geo
from drivelake.operators import tracks

#: Rounds of the fit, fixes it needs, and how far apart on the path they must lie.
ROUNDS, LEAST, SPAN_M = 5, 6, 150.0


def fit(z: np.ndarray, p: np.ndarray, acc: np.ndarray) -> tuple[complex, complex] | None:
    """The turn (a unit complex number) and shift that lay path places p (complex, east + north i) over fixes z best, by weights that residuals
    beyond two accuracies lower in ROUNDS rounds. None where the places don't tell a turn."""
    w = 1 / acc**2
    turn = shift = None
    for _ in range(ROUNDS):
        zm, pm = (w @ z) / w.sum(), (w @ p) / w.sum()
        h = (w * (z - zm)) @ np.conj(p - pm)
        if h == 0:
            return None
        turn = h / abs(h)
        shift = zm - turn * pm
        w = np.minimum(1, 2 * acc / np.maximum(np.abs(z - (turn * p + shift)), 1e-6)) / acc**2
    return turn, shift


def fits(starts: np.ndarray, z: np.ndarray, p: np.ndarray, acc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fit for many ticks at once, whose places lie one after another and begin at starts: turns, shifts, and whether the places tell a turn."""
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(z))))
    total = lambda v: np.add.reduceat(v, starts)
    w = 1 / acc**2
    turn = shift = None
    told = np.ones(len(starts), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(ROUNDS):
            all_w = total(w)
            zm, pm = total(w * z) / all_w, total(w * p) / all_w
            h = total(w * (z - zm[row]) * np.conj(p - pm[row]))
            told &= h != 0
            turn = h / np.abs(h)
            shift = zm - turn * pm
            w = np.minimum(1, 2 * acc / np.maximum(np.abs(z - (turn[row] * p + shift[row])), 1e-6)) / acc**2
    return turn, shift, told


def rigid_places(ticks: DataFrame, fixes: DataFrame, path: DataFrame, window_s: float = 300.0) -> DataFrame:
    """drive_id, t_ns, n, lat, lon, turn_rad at each tick (drive_id, t_ns) that has LEAST fixes in the last window_s, SPAN_M apart at least.

    fixes: drive_id, t_ns, seq, lat, lon, h_acc_m (those without place or accuracy, or of none, are left out); path: drive_id, t_ns, seq, east, north from an
    arbitrary start in an arbitrary direction. Fixes and ticks take the last path row that isn't later; without one they are left out. Only fixes up to
    the tick count. The plane is that of the drive's mean fix. A tick's fixes are a range frame, bounded by the window.
    """
    f = fixes.filter("lat IS NOT NULL AND lon IS NOT NULL AND h_acc_m > 0").select("drive_id", "t_ns", "seq", "lat", "lon", "h_acc_m")
    place = {"px": F.col("east"), "py": F.col("north")}
    f = tracks.as_of(f, path, place).filter("px IS NOT NULL")
    own = Window.partitionBy("drive_id")
    f = f.withColumns({"lat0": F.avg("lat").over(own), "lon0": F.avg("lon").over(own)})
    e, n = geo.to_enu(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    f = f.select("drive_id", "t_ns", F.struct("t_ns", "seq", e.alias("zx"), n.alias("zy"), "px", "py", F.col("h_acc_m").alias("acc"), "lat0", "lon0").alias("fix"))
    t = tracks.as_of(ticks.select("drive_id", "t_ns", F.lit(0).cast("long").alias("seq")), path, place).filter("px IS NOT NULL").select("drive_id", "t_ns", "px", "py")
    frame = Window.partitionBy("drive_id").orderBy("t_ns").rangeBetween(-int(window_s * 1e9), 0)
    rows = f.unionByName(t, allowMissingColumns=True).withColumn("fixes", F.collect_list("fix").over(frame)).filter(f"px IS NOT NULL AND size(fixes) >= {LEAST}")
    rows = rows.select("drive_id", "t_ns", "px", "py", F.array_sort("fixes").alias("fixes"))
    last = F.element_at("fixes", -1)
    rows = rows.filter(F.array_max(F.transform("fixes", lambda x: F.hypot(x["px"] - last["px"], x["py"] - last["py"]))) >= SPAN_M)
    names = ("zx", "zy", "px", "py", "acc")
    flat = rows.select("drive_id", "t_ns", "px", "py", last["lat0"].alias("lat0"), last["lon0"].alias("lon0"), *(F.col(f"fixes.{c}").alias(f"f_{c}") for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["drive_id", "t_ns", "n", "lat0", "lon0", "x", "y", "turn_rad"]
        for b in batches:
            # A tick's lists have one length and no nulls; they are fitted as they lie, one after another.
            counts = pc.list_value_length(b.column(6)).to_numpy(zero_copy_only=False).astype(np.int64)
            zx, zy, px, py, acc = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(6, 11))
            if len(counts):
                turn, shift, told = fits(np.append(0, np.cumsum(counts)[:-1]), zx + 1j * zy, px + 1j * py, acc)
            else:
                turn = shift = told = np.zeros(0, complex)
            at = turn * (b.column(2).to_numpy(zero_copy_only=False) + 1j * b.column(3).to_numpy(zero_copy_only=False)) + shift
            columns = [b.column(0), b.column(1), pa.array(counts, pa.int32()), b.column(4), b.column(5), pa.array(at.real), pa.array(at.imag), pa.array(np.angle(turn))]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(told.astype(bool)))

    kind = ticks.schema["drive_id"].dataType.simpleString()
    fitted = flat.mapInArrow(run, f"drive_id {kind}, t_ns long, n int, lat0 double, lon0 double, x double, y double, turn_rad double")
    lat, lon = geo.offset_by(F.col("lat0"), F.col("lon0"), F.col("x"), F.col("y"))
    return fitted.select("drive_id", "t_ns", "n", lat.alias("lat"), lon.alias("lon"), "turn_rad")
