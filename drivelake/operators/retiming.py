"""A track whose places come late or early, set right at the corners: there the gyroscope tells when the car turned."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class RetimingRules:
    """What counts as a corner and as a clear one, windows, and the search."""

    turn_deg: float = 30.0
    span_m: float = 60.0
    window_m: float = 70.0
    shift_s: float = 8.0
    step_s: float = 0.1
    rms_deg: float = 8.0
    apart_m: float = 80.0
    alone_m: float = 100.0
    latency_s: float = 0.8
    rival_s: float = 2.0
    rival_cost: float = 2.0
    gap_s: float = 3.0
    least_s: float = 4.0
    most_s: float = 60.0


def _half(d: np.ndarray | float):
    return (d + 180) % 360 - 180


class _Track:
    """Places of a track by metres along it, and metres by time."""

    def __init__(self, t: np.ndarray, lat: np.ndarray, lon: np.ndarray, latency_s: float, gap_s: float):
        self.t, self.gap = t, gap_s
        k = np.cos(np.radians((lat[1:] + lat[:-1]) / 2))
        step = np.hypot(np.diff(lon) * k, np.diff(lat)) * 111_320
        raw = np.concatenate([[0.0], np.cumsum(step)])
        # Places that came late: where the car really was at t is what was told at t + latency.
        self.way = np.interp(t + latency_s * 1e9, t, raw)
        keep = np.concatenate([[True], np.diff(raw) > 0])
        self.metres, self.lat, self.lon = raw[keep], lat[keep], lon[keep]

    def place(self, s):
        return np.interp(s, self.metres, self.lat), np.interp(s, self.metres, self.lon)

    def bearing(self, s):
        """Of the twelve metres around, in degrees."""
        (a, b), (c, d) = self.place(np.asarray(s) - 6.0), self.place(np.asarray(s) + 6.0)
        return np.degrees(np.arctan2((d - b) * np.cos(np.radians(a)), c - a)) % 360

    def at(self, t):
        """Metres at a time; nan outside and in gaps."""
        t = np.asarray(t, float)
        i = np.clip(np.searchsorted(self.t, t), 1, len(self.t) - 1)
        ok = (t > self.t[0]) & (t <= self.t[-1]) & (self.t[i] - self.t[i - 1] <= self.gap * 1e9)
        return np.where(ok, np.interp(t, self.t, self.way), np.nan)

    def when(self, s: float) -> float:
        """The first time at which the track is that far."""
        return float(self.t[min(int(np.searchsorted(self.way, s)), len(self.t) - 1)])


def corners(track: _Track, rules: RetimingRules = RetimingRules()) -> list[float]:
    """Metres of the corners that stand alone: the largest turn of each group within apart_m."""
    at = np.arange(rules.span_m / 2, track.metres[-1] - rules.span_m / 2, 2.0)
    if not len(at):
        return []
    turn = np.abs(_half(track.bearing(at + rules.span_m / 2) - track.bearing(at - rules.span_m / 2)))
    found: list[tuple[float, float]] = []
    for s, d in zip(at[turn >= rules.turn_deg].tolist(), turn[turn >= rules.turn_deg].tolist()):
        if found and s - found[-1][0] < rules.apart_m:
            if d > found[-1][1]:
                found[-1] = (s, d)
        else:
            found.append((s, d))
    return [s for i, (s, _) in enumerate(found) if all(abs(o - s) >= rules.alone_m for j, (o, _) in enumerate(found) if j != i)]


def anchors(track: _Track, gyro_t: np.ndarray, gyro_deg: np.ndarray, rules: RetimingRules = RetimingRules()) -> list[tuple[float, float]]:
    """(time, metres by which the track is to be moved on) at each corner where one shift of the gyroscope's turn fits clearly best."""
    out = []
    shifts = np.round(np.arange(-rules.shift_s, rules.shift_s + 1e-9, rules.step_s), 3)
    for s in corners(track, rules):
        start, end = track.when(s - rules.window_m), track.when(s + rules.window_m)
        if not rules.least_s <= (end - start) / 1e9 <= rules.most_s:
            continue  # too fast to tell, or a stop in between
        t = track.when(s)
        now = float(track.at(t))
        if math.isnan(now):
            continue  # a corner in a gap can't be moved
        times = start + np.arange(int((end - start) / 2e8) + 1) * 2e8
        way = track.at(times[None, :] + shifts[:, None] * 1e9)
        known = ~np.isnan(way)
        enough = known.sum(1) >= 0.8 * len(times)
        if not enough.any():
            continue
        way, known = way[enough], known[enough]
        heading = np.interp(times, gyro_t, gyro_deg)
        off = np.where(known, _half(heading - track.bearing(np.nan_to_num(way))), 0.0)
        middle = np.degrees(np.arctan2((np.sin(np.radians(off)) * known).sum(1), (np.cos(np.radians(off)) * known).sum(1)))
        cost = np.full(len(shifts), np.inf)
        cost[enough] = (known * _half(off - middle[:, None]) ** 2).sum(1) / np.maximum(known.sum(1), 1)
        best = int(np.argmin(cost))
        rivals = cost[(np.abs(shifts - shifts[best]) >= rules.rival_s) & np.isfinite(cost)]
        clear = math.isfinite(cost[best]) and math.sqrt(cost[best]) <= rules.rms_deg and abs(shifts[best]) < rules.shift_s - rules.step_s and (not len(rivals) or rivals.min() > rules.rival_cost * cost[best])
        true = float(track.at(t + shifts[best] * 1e9))
        if clear and not math.isnan(true):
            out.append((t, true - now))
    return out


def retimed(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, gyro_t: np.ndarray, gyro_deg: np.ndarray, rules: RetimingRules = RetimingRules()) -> tuple[np.ndarray, np.ndarray, np.ndarray, int] | None:
    """New lat, lon, bearing_deg of a track's times, and how many corners told; None where none did. Between corners the move is interpolated; the car never drives back."""
    if len(t) < 3 or len(gyro_t) < 2:
        return None
    track = _Track(t.astype(float), lat, lon, rules.latency_s, rules.gap_s)
    told = anchors(track, gyro_t.astype(float), gyro_deg, rules) if len(track.metres) > 1 else []
    if not told:
        return None
    way = np.maximum.accumulate(track.way + np.interp(track.t, *map(np.array, zip(*told))))
    return *track.place(way), track.bearing(way), len(told)


OUT = "t_ns long, seq long, lat double, lon double, bearing_deg double, corners int"


def retime_tracks(track: DataFrame, turns: DataFrame, rules: RetimingRules = RetimingRules()) -> DataFrame:
    """drive_id and OUT: tracks (drive_id, t_ns, seq, lat, lon, bearing_deg) with places moved along their own route so that their corners fall where turns
    (drive_id, t_ns, seq, heading_deg: cumulated, clockwise) has them. A drive without a clear corner stays as it is, with corners 0.

    Of rows at one time the last counts and the others take its place; rows with a null are left out. A drive's track of a row a second and its turns of ten
    rows a second are held together.
    """
    names = [c.split(" ")[0] for c in OUT.split(", ")]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = (x.sort_by([("t_ns", "ascending"), ("seq", "ascending")]) for x in (a, b))
        t, lat, lon, bearing = (a.column(c).to_numpy() for c in ("t_ns", "lat", "lon", "bearing_deg"))
        last = np.append(np.diff(t) > 0, True) if len(t) else np.zeros(0, bool)
        new = retimed(t[last], lat[last], lon[last], b.column("t_ns").to_numpy(), b.column("heading_deg").to_numpy(), rules)
        group = np.concatenate([[0], np.cumsum(last)[:-1]]).astype(int) if len(t) else np.zeros(0, int)
        if new is not None:
            lat, lon, bearing = (x[group] for x in new[:3])
        return pa.table([a.column("drive_id"), a.column("t_ns"), a.column("seq"), pa.array(lat), pa.array(lon), pa.array(bearing), pa.array([0 if new is None else new[3]] * len(t), pa.int32())], ["drive_id", *names])

    kind = track.schema["drive_id"].dataType.simpleString()
    full = lambda df, *cs: df.select("drive_id", "t_ns", "seq", *cs).dropna()
    return full(track, "lat", "lon", "bearing_deg").groupBy("drive_id").cogroup(full(turns, "heading_deg").groupBy("drive_id")).applyInArrow(run, f"drive_id {kind}, {OUT}")
