"""Along-track matching: how far a driven course lies before or behind a road's, by the shapes of their bearings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Metres looked back, largest shift, step; least turn and its distance from the ends; largest residual; a rival's distance and cost; least overlap and uncertainty.
WINDOW_M, SHIFT_M, STEP_M = 250.0, 50.0, 2.0
TURN_DEG, INSET_M, RMS_DEG = 20.0, 30.0, 6.0
RIVAL_M, RIVAL_COST, OVERLAP_M, SIGMA_M = 15.0, 2.0, 120.0, 4.0


def shift_of(course: tuple[np.ndarray, np.ndarray], road: tuple[np.ndarray, np.ndarray]) -> tuple[float, float, float, float] | None:
    """(shift, sigma, rms_deg, turn_deg) of two profiles: metres back from now (rising) and unwrapped bearing in radians; None where no shift can be told.

    The road has to turn inside the window; the best shift must fit well, lie inside the range, and beat every other valley of the cost.
    """
    if min(len(course[0]), len(road[0])) < 3:
        return None
    window = min(WINDOW_M, course[0][-1], road[0][-1])
    if window < OVERLAP_M or not ((road[0] >= INSET_M) & (road[0] <= window - INSET_M)).any():
        return None
    at = lambda p, back: np.interp(back, *p, left=np.nan, right=np.nan)
    turn, inside = (math.degrees(abs(at(road, a) - at(road, b))) for a, b in ((0.0, window), (INSET_M, window - INSET_M)))
    if not (turn >= TURN_DEG and inside >= 0.7 * TURN_DEG):
        return None
    shifts, costs = [], []
    for shift in np.arange(-SHIFT_M, SHIFT_M + 1e-9, STEP_M):
        back = np.arange(max(0.0, shift), window + 1e-9, STEP_M)
        d = at(course, back) - at(road, back - shift)
        d = d[~np.isnan(d)]
        if len(d) * STEP_M >= OVERLAP_M:  # a constant difference of heading doesn't count
            d = d - math.atan2(np.sin(d).sum(), np.cos(d).sum())
            shifts.append(shift)
            costs.append(float((((d + np.pi) % (2 * np.pi) - np.pi) ** 2).mean()))
    if not shifts:
        return None
    s, c = np.array(shifts), np.array(costs)
    best = int(np.argmin(c))
    rms = math.degrees(math.sqrt(c[best]))
    if rms > RMS_DEG or not -SHIFT_M + STEP_M < s[best] < SHIFT_M - STEP_M:
        return None
    valley = (np.concatenate([[True], c[1:] < c[:-1]])) & (np.concatenate([c[:-1] <= c[1:], [True]]))
    rivals = c[valley & (np.abs(s - s[best]) >= RIVAL_M)]
    if len(rivals) and rivals.min() < RIVAL_COST * c[best]:
        return None
    wide = s[c <= 2 * c[best] + math.radians(1.0) ** 2]
    return float(s[best]), max(SIGMA_M, float(wide[-1] - wide[0]) / 2), rms, turn


def along_track(courses: DataFrame, road_profiles: DataFrame) -> DataFrame:
    """id, shift_m, sigma_m, rms_deg, turn_deg for each id of courses whose profile fits its road's. Both have id, back_m, bearing (rad, unwrapped); a profile is a few hundred rows."""
    kind = courses.schema["id"].dataType.simpleString()
    names = ["shift_m", "sigma_m", "rms_deg", "turn_deg"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        course, road = (tuple(x.sort_by("back_m").column(c).to_numpy() for c in ("back_m", "bearing")) for x in (a, b))
        found = shift_of(course, road)
        ids = a.column("id").slice(0, 1 if found else 0)
        return pa.table([ids, *(pa.array([v], pa.float64()) if found else pa.array([], pa.float64()) for v in found or names)], ["id", *names])

    usable = [x.select("id", F.col("back_m").cast("double").alias("back_m"), F.col("bearing").cast("double").alias("bearing")).filter("id IS NOT NULL AND back_m IS NOT NULL AND bearing IS NOT NULL") for x in (courses, road_profiles)]
    return usable[0].groupBy("id").cogroup(usable[1].groupBy("id")).applyInArrow(run, f"id {kind}, shift_m double, sigma_m double, rms_deg double, turn_deg double")
