"""Trips for people: thinned and simplified routes, length and duration, texts.

Simplification and thinning depend on what was kept before, so they are folds: of one drive in a task, in the order (t_ns, seq).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivelake.functions import geo

#: Metres of a degree of latitude in the plane of simplification.
DEGREE_M = 111_195.0


def _far(x: np.ndarray, y: np.ndarray, low: int, high: int) -> tuple[int, float]:
    """The inner point that is farthest from the segment between two points, and how far."""
    dx, dy = x[high] - x[low], y[high] - y[low]
    px, py = x[low + 1 : high] - x[low], y[low + 1 : high] - y[low]
    square = dx * dx + dy * dy
    t = np.clip((px * dx + py * dy) / square, 0, 1) if square > 0 else np.zeros(len(px))
    d = np.hypot(px - t * dx, py - t * dy)
    at = int(np.argmax(d))
    return low + 1 + at, float(d[at])


def kept(lat: np.ndarray, lon: np.ndarray, tolerance_m: float) -> np.ndarray:
    """Places of the points that stay: both ends, and whatever keeps every other point within the tolerance of the line. Without recursion."""
    n = len(lat)
    if n <= 2:
        return np.arange(n)
    x, y = (lon - lon[0]) * DEGREE_M * math.cos(math.radians(lat[0])), (lat - lat[0]) * DEGREE_M
    stay, spans = {0, n - 1}, [(0, n - 1)]
    while spans:
        low, high = spans.pop()
        if high - low < 2:
            continue
        at, d = _far(x, y, low, high)
        if d > tolerance_m:
            stay.add(at)
            spans += [(low, at), (at, high)]
    return np.array(sorted(stay))


def simplified(points: DataFrame, most: int = 1500, tolerance_m: float = 3.0, rounds: int = 24) -> DataFrame:
    """Each drive's route (drive_id, t_ns, seq, lat, lon) with `most` points at most: the tolerance doubles until it fits, `rounds` times at most. A task holds one drive's route."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("t_ns", "ascending"), ("seq", "ascending")])
        lat, lon = (table.column(c).to_numpy() for c in ("lat", "lon"))
        tolerance = tolerance_m
        out = kept(lat, lon, tolerance)
        for _ in range(rounds):
            if len(out) <= most:
                break
            tolerance *= 2
            out = kept(lat, lon, tolerance)
        return table.take(pa.array(out))

    known = points.select("drive_id", "t_ns", "seq", "lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL AND drive_id IS NOT NULL")
    return known.groupBy("drive_id").applyInArrow(run, known.schema)


def thinned(points: DataFrame, least_m: float = 3.0) -> DataFrame:
    """The points of each drive that are least_m or more from the last one kept. Rows stream through a task with one place in memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drive, at = None, (0.0, 0.0)
        for b in batches:
            stay = []
            for key, lat, lon in zip(*(b.column(c).to_pylist() for c in ("drive_id", "lat", "lon"))):
                p, q = math.radians(at[0]), math.radians(lat)
                h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon - at[1]) / 2) ** 2
                ok = key != drive or 2 * geo.EARTH_RADIUS * math.asin(math.sqrt(min(max(h, 0.0), 1.0))) >= least_m
                stay.append(ok)
                if ok:
                    drive, at = key, (lat, lon)
            yield b.filter(pa.array(stay, pa.bool_()))

    ordered = points.filter("drive_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").repartition("drive_id").sortWithinPartitions("drive_id", "t_ns", "seq")
    return ordered.mapInArrow(run, points.schema)


def lengths(points: DataFrame) -> DataFrame:
    """drive_id, length_m: the sum of steps along great circles; 0 for a single point."""
    w = Window.partitionBy("drive_id").orderBy("t_ns", "seq")
    step = geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return points.withColumn("_s", step).groupBy("drive_id").agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("length_m"))


def summaries(route: DataFrame, drawn: DataFrame | None = None) -> DataFrame:
    """drive_id, points, from_estimates, length_m and duration_s of routes (drive_id, t_ns, seq, lat, lon, from_estimates); the length is that of the drawn (simplified) route, if one is given."""
    r = route.groupBy("drive_id").agg(F.count("*").alias("points"), F.max("from_estimates").alias("from_estimates"), ((F.max("t_ns") - F.min("t_ns")) / F.lit(1e9)).alias("duration_s"))
    return r.join(lengths(route if drawn is None else drawn), "drive_id", "left").select("drive_id", "points", "from_estimates", "length_m", "duration_s")


def duration_text(seconds: Column) -> Column:
    """To the nearest minute: "< 1 min" below one, "12 min", "1 h 05 min"."""
    minutes = F.floor((F.floor(seconds) + 30) / 60)
    hours = F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit(" min"))
    return F.when(seconds < 60, "< 1 min").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(hours)


def cell_text(c: Column) -> Column:
    """What a radio cell tells of itself; unknown parts are left out."""
    part = lambda before, x: F.concat(F.lit(before), x.cast("string"))
    network = F.when(c["mcc"].isNotNull(), F.concat(c["mcc"].cast("string"), F.lit("-"), F.coalesce(c["mnc"].cast("string"), F.lit("null"))))
    level = F.coalesce(c["rsrp_dbm"], c["rssi_dbm"])
    return F.concat_ws(" ", c["rat"], network, part("area ", c["area"]), part("cid ", c["cid"]), F.concat(level.cast("string"), F.lit(" dBm")), part("TA ", c["timing_advance"]))
