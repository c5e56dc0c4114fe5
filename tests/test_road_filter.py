"""The filter on roads: what each correction is good for, and what it must not do."""

import math
import random

import numpy as np
import pytest

from drivelake.streaming import drive_fold
from drivelake.streaming.estimators import PSI, V, Filter, FilterRules
from drivelake.streaming.road_filter import RoadFilter, RoadRules
from drivelake.streaming.road_matcher import Network, road_of
from test_drive_fold import LAT, LON, S, drive_events, fix, metres, moving, plain, rows_of, speed


def place(e, n):
    return LAT + n / 111_230, LON + e / (111_320 * math.cos(math.radians(LAT)))


def road(key, a, b, *points, oneway=False, name=""):
    lats, lons = zip(*(place(*p) for p in points))
    return road_of((key, 0), a, b, oneway, "primary", 2, name, list(lats), list(lons))


def line(n=8, length=400.0):
    """A straight street to the north, with a crossing at each end of its pieces."""
    roads = [road(k, k, k + 1, (0, k * length), (0, (k + 1) * length), name="Main") for k in range(n)]
    return Network(roads + [road(100 + k, k, 1000 + k, (0, k * length), (300, k * length), name=f"Side {k}") for k in range(1, n)])


def drive(f, seconds, v=12.0, bias=0.0, turns=(), obd=True, until=20, coarse=None, seed=1):
    """Northwards from the start, satellites only at first; turns: (second, rate clockwise, seconds). Returns true places by second."""
    rng, x, y, h, out = random.Random(seed), 0.0, 0.0, 0.0, []
    for i in range(seconds * 20):
        t = i / 20
        rate = next((r for s, r, n in turns if s <= t < s + n), 0.0)
        f.on_motion(moving(t, yaw_rate=-rate + bias, along_accel=None, tilt_rms=0.05))
        if obd and i % 10 == 0:
            f.on_event(speed(t, v), None)
        if i % 20 == 0:
            out.append(place(x, y))
            if t < until:
                f.on_event(fix(t, *place(x + rng.gauss(0, 2), y + rng.gauss(0, 2)), speed=v, bearing=math.degrees(h) % 360, seq=i), "TRUSTED")
            elif coarse and i % (20 * coarse) == 0:
                f.on_event(fix(t, *place(x + rng.gauss(0, 20), y + rng.gauss(0, 20)), acc=60.0, source="NETWORK", seq=i), "TRUSTED")
        h += rate / 20
        x, y = x + v / 20 * math.sin(h), y + v / 20 * math.cos(h)
    return out


def errors(f, seconds, **more):
    true = drive(f, seconds, **more)
    e = f.estimate((seconds - 1) * S)
    return metres(e, *true[-1]), e


def test_a_drifting_heading_is_held_by_the_road():
    more = {"bias": 0.004, "until": 4}
    free, _ = errors(Filter(), 200, **more)
    f = RoadFilter(line())
    held, e = errors(f, 200, **more)
    assert free > 100 and held < 40 and f.counts["line"][0] > 5
    assert np.linalg.eigvalsh(f.main.p).min() > -1e-9
    # The road-free twin is as bad as a filter alone, and the radius doesn't claim more than it.
    assert metres(f.free.estimate(199 * S), *place(0, 199 * 12)) > 100 and e.r68 >= f.free.estimate(199 * S).r68 - 1e-9


def test_away_from_roads_nothing_changes():
    f, alone = RoadFilter(Network([])), Filter()
    drive(f, 90, bias=0.001)
    drive(alone, 90, bias=0.001)
    assert np.allclose(f.main.x, alone.x) and np.allclose(f.main.p, alone.p) and not any(map(sum, f.counts.values()))


def test_a_road_never_makes_a_state_surer_than_itself():
    f = RoadFilter(line())
    drive(f, 30)
    p = f.main.p.copy()
    for std, changes in ((math.sqrt(p[PSI, PSI]) / 2, True), (math.sqrt(p[PSI, PSI]) * 2, False)):
        before = f.main.p.copy()
        assert f._try("heading", np.eye(7)[PSI], 0.0, std**2)
        assert np.allclose(before, f.main.p) != changes
    assert not f._try("heading", np.eye(7)[PSI], 2.0, 1e-6) and f.counts["heading"][1] == 1


def test_a_wrong_road_is_left_again():
    """A line refused twice in a row, and the filter is the free one again."""
    f = RoadFilter(line())
    drive(f, 60)
    f.main.x[0] += 500
    f.rejected, f.last["line"] = 1, -math.inf
    while f.counts["line"][1] == 0:
        drive_on(f)
    assert abs(f.main.x[0]) < 20 and math.hypot(*(f.main.x[:2] - f.free.x[:2])) < 10


def drive_on(f):
    t = f.free.t / S
    for i in range(1, 41):
        f.on_motion(moving(t + i / 20, tilt_rms=0.05))
        f.on_event(speed(t + i / 20, 12.0), None)


def test_bends_tell_the_place_along_the_road():
    """The speedometer reads six in a hundred too much; two bends on the way show how far the car really is."""
    roads = [road(1, 1, 2, (0, 0), (0, 600), name="R"), road(2, 2, 3, (0, 600), (50, 650), name="R"), road(3, 3, 4, (50, 650), (450, 650), name="R"), road(4, 4, 5, (450, 650), (500, 700), name="R"), road(5, 5, 6, (500, 700), (500, 2000), name="R")]
    turns = [(50.0, math.pi / 8, 2.0), (55.9, math.pi / 8, 2.0), (91.2, -math.pi / 8, 2.0), (97.1, -math.pi / 8, 2.0)]
    f = RoadFilter(Network(roads))
    drive(f, 125, turns=turns)
    assert f.counts["shape"][0] + f.counts["shape"][1] >= 1 and f.matcher.best().key == (5, 0)


def test_axis_without_a_speed():
    """No speed from the car, a network fix now and then: roads still straighten the heading."""
    f = RoadFilter(line(), FilterRules(accel=False))
    drive(f, 120, obd=False, coarse=10, bias=0.003)
    plain_f = Filter(FilterRules(accel=False))
    drive(plain_f, 120, obd=False, coarse=10, bias=0.003)
    assert f.counts["axis"][0] >= 2 and abs(f.main.x[PSI]) < abs(plain_f.x[PSI]) + 0.02
    assert f.main.x[V] == pytest.approx(f.free.x[V], abs=4)


def test_fold_with_networks_equals_steps(spark):
    events = {d: drive_events(d)[0] for d in (1, 2)}
    net = line()
    roads = [(1, *r.key, r.start, r.end, r.oneway, r.road_class, r.lanes, r.name, [(float(a), float(b)) for a, b in zip(r.lats, r.lons)]) for r in net.roads.values()]
    networks = spark.createDataFrame(roads, "drive_id long, way_id long, piece long, start_node long, end_node long, oneway boolean, road_class string, lanes int, name string, points array<struct<lat: double, lon: double>>")
    want = []
    for d, xs in events.items():
        fold = drive_fold.Drive(lambda: RoadFilter(line() if d == 1 else Network([])))  # noqa: B023
        want += [(d, *r) for x in xs for r in fold.take(x)]
    out = drive_fold.fold_batch(rows_of(spark, events), "baseline-roads", networks=networks)
    assert plain(out.collect()) == plain(want)
