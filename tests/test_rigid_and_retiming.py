"""Paths laid over fixes, and tracks set right at their corners."""

import math
import random

import numpy as np
import pytest

from drivelake.operators import retiming, rigid

S = 10**9
LAT, LON = 50.4, 30.5
KX = 111_195 * math.cos(math.radians(LAT))


def test_fit_finds_turn_and_shift_despite_outliers():
    rng = np.random.default_rng(1)
    for _ in range(20):
        p = rng.normal(0, 400, 15) + 1j * rng.normal(0, 400, 15)
        turn, shift = np.exp(1j * rng.uniform(-3, 3)), complex(*rng.normal(0, 1000, 2))
        z = turn * p + shift + rng.normal(0, 5, 15) + 1j * rng.normal(0, 5, 15)
        z[:2] += 900
        acc = np.full(15, 20.0)
        got = rigid.fit(z, p, acc)
        plain_turn = (z - z.mean()) @ np.conj(p - p.mean())
        assert abs(np.angle(got[0] / turn)) < 0.12 and abs(got[1] - shift) < 120
        assert abs(np.angle(got[0] / turn)) < abs(np.angle(plain_turn / turn)) + 1e-9 or abs(np.angle(got[0] / turn)) < 0.02
    assert rigid.fit(np.ones(6) + 0j, np.ones(6) + 0j, np.ones(6)) is None


def test_path_over_fixes_gives_places_without_satellites(spark):
    rng = random.Random(3)
    turn = 1.1
    path, fixes, truth = [], [], {}
    for t in range(600):
        x, y = 10.0 * t, 300 * math.sin(t / 60)  # east, north of the path's own frame
        e, n = math.cos(turn) * x - math.sin(turn) * y, math.sin(turn) * x + math.cos(turn) * y
        truth[t] = (LAT + n / 111_195, LON + e / KX)
        path.append((1, t * S, t, x, y))
        if t % 15 == 0:
            off = 800 if t == 150 else 0
            fixes.append((1, t * S, t, LAT + (n + rng.gauss(0, 25) + off) / 111_195, LON + (e + rng.gauss(0, 25)) / KX, 40.0))
    fixes += [(1, 5 * S, 900, None, 30.0, 5.0), (1, 6 * S, 901, 50.0, 30.0, None), (2, 0, 1, 50.0, 30.0, 9.0)]
    ticks = spark.createDataFrame([(1, t * S) for t in range(0, 600, 10)] + [(2, 0), (3, 0)], "drive_id long, t_ns long")
    out = rigid.rigid_places(ticks, spark.createDataFrame(fixes, "drive_id long, t_ns long, seq long, lat double, lon double, h_acc_m double"), spark.createDataFrame(path, "drive_id long, t_ns long, seq long, east double, north double"), 240.0)
    rows = out.collect()
    off = {r.t_ns // S: math.hypot((r.lat - truth[r.t_ns // S][0]) * 111_195, (r.lon - truth[r.t_ns // S][1]) * KX) for r in rows}
    assert min(off) == 80 and len(off) == 52 and np.median(list(off.values())) < 25 and max(off.values()) < 120
    assert all(abs(r.turn_rad - turn) < 0.3 for r in rows if r.t_ns > 200 * S)


def route(delay_s, seconds=240, turn_at=(60, 130, 190)):
    """A drive of 9 m/s with corners of 90 degrees; places are told delay_s late. Times, places, gyroscope times and headings, true places."""
    heading, x, y, told, true, gyro = 0.0, 0.0, 0.0, [], [], []
    trail = [(0.0, 0.0)]
    for i in range(seconds * 10):
        t = i / 10
        for k, c in enumerate(turn_at):
            if c <= t < c + 3:
                heading += math.radians(30 if k % 2 == 0 else -30) / 10
        x, y = x + 0.9 * math.sin(heading), y + 0.9 * math.cos(heading)
        trail.append((x, y))
        gyro.append((i * S // 10, math.degrees(heading) + 33.0))
        if i % 10 == 0:
            late = trail[max(0, i - round(delay_s * 10))]
            told.append((i * S // 10, LAT + late[1] / 111_195, LON + late[0] / KX))
            true.append((LAT + y / 111_195, LON + x / KX))
    return told, gyro, true


@pytest.mark.parametrize("delay", [0.0, 2.5, 5.0])
def test_delay_is_found_at_corners(delay):
    told, gyro, true = route(delay)
    t, lat, lon = (np.array(x) for x in zip(*told))
    got = retiming.retimed(t, lat, lon, *(np.array(x) for x in zip(*gyro)))
    assert got is not None and got[3] == 3
    off = np.hypot((got[0] - [x[0] for x in true]) * 111_195, (got[1] - [x[1] for x in true]) * KX)[30:220]
    before = np.hypot((lat - [x[0] for x in true]) * 111_195, (lon - [x[1] for x in true]) * KX)[30:220]
    assert np.median(off) < 6 and (delay < 1 or np.median(off) < 0.4 * np.median(before))
    assert (np.diff(retiming._Track(t.astype(float), got[0], got[1], 0.0, 3.0).way) >= -1e-6).all()


def test_unclear_tracks_stay(spark):
    told, gyro, _ = route(2.0, turn_at=())
    back, gyro2, _ = route(2.0, turn_at=(60, 70))  # two corners ninety metres apart
    rows = [(d, ns, i, a, b, 0.0) for d, xs in ((1, told), (2, back), (3, route(2.0)[0])) for i, (ns, a, b) in enumerate(xs)]
    rows += [(3, 5 * S, 9999, 50.0, None, 0.0), (4, 0, 1, 50.0, 30.0, 0.0)]
    turns = [(d, ns, i, h) for d, xs in ((1, gyro), (2, gyro2), (3, route(2.0)[1])) for i, (ns, h) in enumerate(xs)]
    track = spark.createDataFrame(rows, "drive_id long, t_ns long, seq long, lat double, lon double, bearing_deg double")
    out = retiming.retime_tracks(track, spark.createDataFrame(turns, "drive_id long, t_ns long, seq long, heading_deg double"))
    got = {(r.drive_id, r.seq): r for r in out.collect()}
    assert len(got) == 3 * 240 + 1 and {d: r.corners for (d, s), r in got.items() if s == 1} == {1: 0, 2: 0, 3: 3, 4: 0}
    assert all(got[d, s].lat == a for d, _, s, a, b, _ in rows if d in (1, 2)) and any(got[3, i].lat != x[1] for i, x in enumerate(route(2.0)[0]))
    assert retiming.retime_tracks(track.limit(0), spark.createDataFrame(turns[:1], "drive_id long, t_ns long, seq long, heading_deg double")).count() == 0


def test_many_fits_are_those_of_each_tick():
    rng = np.random.default_rng(3)
    sizes = [6, 9, 6, 40]
    z, p, acc = rng.normal(0, 300, sum(sizes)) + 1j * rng.normal(0, 300, sum(sizes)), rng.normal(0, 300, sum(sizes)) + 1j * rng.normal(0, 300, sum(sizes)), rng.uniform(3, 90, sum(sizes))
    starts = np.append(0, np.cumsum(sizes)[:-1])
    p[starts[2] : starts[3]] = 5 + 5j  # a path that stays tells no turn
    turn, shift, told = rigid.fits(starts, z, p, acc)
    assert told.tolist() == [True, True, False, True]
    for i, (a, n) in enumerate(zip(starts, sizes)):
        one = rigid.fit(z[a : a + n], p[a : a + n], acc[a : a + n])
        assert (one is None) == (not told[i]) and (one is None or np.allclose([turn[i], shift[i]], one, rtol=1e-9))


def test_corners_in_gaps_cost_no_search(monkeypatch):
    """No shift is tried at a corner whose place in time no track tells."""
    t = np.arange(12) * 10 * 10**9
    east, north = np.repeat(np.arange(6), 2) * 200.0, np.append(0, np.repeat(np.arange(1, 7), 2)[:11]) * 200.0
    rules = retiming.RetimingRules()
    track = retiming._Track(t.astype(float), 50 + north / 111_320, 30 + east / 111_320 / np.cos(np.radians(50)), rules.latency_s, rules.gap_s)
    assert len(retiming.corners(track, rules)) >= 5
    tried = []
    at = retiming._Track.at
    monkeypatch.setattr(retiming._Track, "at", lambda self, x: tried.append(np.size(x)) or at(self, x))
    assert retiming.anchors(track, t.astype(float), np.zeros(12), rules) == [] and max(tried) == 1
