"""The compass: fits against known shapes, drives through a car's own field, and what makes it keep silent."""

import math
import random

import numpy as np
import pytest

from drivelake.streaming import compass as cp
from drivelake.streaming.compass import Compass, CompassRules, fit_circle, fit_ellipse
from drivelake.streaming.estimators import Filter
from drivelake.streaming.tracker import Tracker
from test_tracker import mount, phone

S = 1_000_000_000
#: Turns all the way round, twice.
LEGS = [(4, 0, 0), (5, 2, 0), *[(15, 0, 2 * math.pi / 30), (8, 0, 0), (15, 0, 2 * math.pi / 30), (8, 0, 0)] * 2]


def test_fits_find_known_shapes():
    rng = np.random.default_rng(1)
    for _ in range(50):
        centre, radius = rng.normal(0, 60, 2), rng.uniform(10, 30)
        a = rng.uniform(0, 2 * np.pi, 20)
        c = fit_circle(centre + radius * np.column_stack([np.cos(a), np.sin(a)]))
        assert np.allclose(c.centre, centre) and c.radius == pytest.approx(radius) and not c.ellipse
        turn, ratio = rng.uniform(0, np.pi), rng.uniform(1.05, 1.9)
        axes = np.array([[math.cos(turn), -math.sin(turn)], [math.sin(turn), math.cos(turn)]])
        points = centre + np.column_stack([radius * ratio * np.cos(a), radius * np.sin(a)]) @ axes.T
        e = fit_ellipse(points)
        assert np.allclose(e.centre, centre, atol=1e-6) and e.radius == pytest.approx(radius * math.sqrt(ratio))
        assert np.allclose(np.hypot(*e.corrected(points).T), e.radius) and np.allclose(e.shape, e.shape.T)
    flat = np.column_stack([np.arange(9.0), np.arange(9.0)])
    assert fit_circle(flat) is None and fit_ellipse(flat) is None and fit_circle(flat[:2]) is None
    a = np.linspace(0, 6, 30)
    assert fit_ellipse(np.column_stack([30 * np.cos(a), 10 * np.sin(a)])) is None  # three to one


def car(legs=LEGS, hard=(40.0, -25.0, 30.0), soft=0.15, seed=1, hz=50, north_up=45.0, noise=0.3, axes=None, kind="MAG_UNCAL", jump=None, shake=0.02):
    """Samples of a phone with a magnetometer in a car of hard and soft iron, by time; truth (t, bearing, speed)."""
    axes = mount(20, 50) if axes is None else axes
    samples, truth = phone(legs, hz=hz, seed=seed, axes=axes, speeds=False, noise=shake)
    rng, out = random.Random(seed), list(samples)
    distort = np.eye(3) + soft * np.array([[1, 0.3, 0], [0.3, -0.5, 0], [0, 0, 0]])
    for t, b, _ in truth:
        field = np.array([-20 * math.sin(b), 20 * math.cos(b), -north_up])  # right, forward, up of the car
        v = axes @ (distort @ field) + np.array(hard) + [rng.gauss(0, noise) for _ in range(3)]
        if jump and jump[0] * S <= t < jump[1] * S:
            v = v + axes @ np.array([0, 8.0, 12.0])
        out.append(("imu", t + 500, kind, *map(float, v), None))
    return sorted(out, key=lambda s: s[1]), truth


def drive(samples, truth, align_until=0.0, declination=0.0, rules=CompassRules()):
    """Readings each second with their error, and the compass."""
    c, t, out, at = Compass(rules), Tracker(), [], {}
    c.reference(declination, 66.0, 49.2)
    courses = {x[0] // (S // 10): x for x in truth}
    after = 0
    for kind, ns, sub, x, y, z, w in samples:
        if sub and sub.startswith("MAG"):
            c.magnetic(sub, ns, (x, y, z))
        m = t.take(kind, ns, sub, x, y, z, w)
        if m is None:
            continue
        c.motion(m)
        _, b, v = courses.get(ns // (S // 10), (0, None, 0))
        if b is not None and ns < align_until * S:
            c.calibrate(ns, b, v, m.yaw_rate)
        if ns >= after:
            after = ns + S
            r = c.reading(ns)
            if r is not None and b is not None:
                out.append((ns / S, r, abs(math.degrees(math.pi - (math.pi - (r.bearing_rad - b)) % (2 * math.pi)))))
    return out, c


def test_aligned_compass_is_right_within_its_own_sigma():
    out, c = drive(*car(), align_until=70)
    late = [(r, e) for t, r, e in out if t > 70]
    q = c.quality()
    assert len(late) > 15 and q.fit == "ellipse" and q.octants == 8 and q.verdict in ("USABLE", "MARGINAL")
    assert np.percentile([e for _, e in late], 95) < 8 and all(e < 2.5 * math.degrees(r.sigma_rad) for r, e in late) and late[-1][0].mode == "GNSS_ALIGNED"
    assert q.hard_iron_ut > 20 and 0.7 < q.radius_ratio < 1.3 and q.scatter_deg < 5


def test_without_satellites_the_forward_axis_aligns():
    legs = [(4, 0, 0), (5, 2, 0), *[(20, 0, 2 * math.pi / 40), (4, 0, 0), (20, 0, -2 * math.pi / 40), (4, 0, 0)] * 2]
    out, c = drive(*car(legs, soft=0.0, hz=100))
    late = [(r, e) for t, r, e in out if t > 60]
    assert late and {r.mode for r, _ in late} == {"FORWARD_ALIGNED"} and np.median([e for _, e in late]) < 15


def test_a_local_anomaly_silences_it():
    samples, truth = car(jump=(80, 90))
    out, _ = drive(samples, truth, align_until=70)
    assert not [t for t, *_ in out if 80.2 < t < 92] and [t for t, *_ in out if t < 80 and t > 70]


def test_shaking_and_saturation_silence_it():
    t = Tracker()
    c = Compass()
    for kind, ns, sub, x, y, z, w in car()[0][:4000]:
        if sub.startswith("MAG"):
            c.magnetic(sub, ns, (900.0, y, z))
        if (m := t.take(kind, ns, sub, x, y, z, w)) is not None:
            c.motion(m)
    q = c.quality()
    assert q.saturated and q.verdict == "UNUSABLE" and q.reasons[0] == "SATURATED" and c.reading(ns) is None
    c2, m = Compass(), t.latest
    c2.motion(m._replace(steady_up=False, tilt_rms=0.2))
    assert c2.shaky and not c2.motion(m._replace(tilt_rms=0.2, steady_up=True)) and not c2.shaky


def test_a_new_mount_forgets_and_wireless_charging_warns():
    _, c = drive(*car(), align_until=70)
    assert c.aligned and c.iron is not None
    c.power("WIRELESS", True)
    assert "WIRELESS_CHARGING" in c.quality().reasons and c.quality().verdict == "MARGINAL"
    t = Tracker()
    for x in car(LEGS[:1])[0]:
        t.take(*x)
    c.motion(t.latest._replace(mount=7))
    assert not c.aligned and c.iron is None and c.quality().verdict == "UNKNOWN" and c.mount == 7


def test_vertical_median_moves_by_small_steps():
    f, up, r = cp._Field(), (0.0, 0.0, 1.0), CompassRules()
    rng, seen = random.Random(1), []
    for i in range(400):
        v = rng.gauss(40, 0.5) + (5 if i == 300 else 0)
        f.now = (0.0, 0.0, v)
        before = f.median
        jumped = f.off(up, r)
        seen.append(v)
        if i < 50:
            assert f.median == pytest.approx(np.mean(seen)) and not jumped
        else:
            assert abs(f.median - before) == pytest.approx(0.02, abs=1e-9) and jumped == (abs(v - before) > 3)
    assert jumped is False and abs(f.median - 40) < 1.5


def test_the_filter_takes_its_first_heading_from_the_compass():
    from drivelake.streaming.trust_fold import Event

    samples, truth = car()
    f, t = Filter(), Tracker()
    f.compass.reference(0.0, 66.0, 49.2)
    for kind, ns, sub, x, y, z, w in samples:
        if sub.startswith("MAG"):
            f.on_event(Event(seq=0, t_ns=ns, rank=3, kind="imu", event=sub, x=x, y=y, z=z), None)
        if (m := t.take(kind, ns, sub, x, y, z, w)) is not None:
            f.on_motion(m)
    assert f.known and np.linalg.eigvalsh(f.p).min() > -1e-9


def test_rows_of_a_table_equal_steps(spark):
    samples, truth = car()
    imu = [(1, ns, sub, x, y, z) for _, ns, sub, x, y, z, _ in samples]
    df = spark.createDataFrame(imu + [(2, *r[1:]) for r in imu[:3000]], "drive_id long, t_ns long, kind string, x double, y double, z double")
    tr = spark.createDataFrame([(1, t, math.degrees(b) % 360, v) for t, b, v in truth[::25]], "drive_id long, t_ns long, bearing_deg double, speed_mps double")
    geo = spark.createDataFrame([(1, 0, 0.0, 66.0, 49.2)], "drive_id long, t_ns long, declination_deg double, inclination_deg double, field_ut double")
    power = spark.createDataFrame([(1, 5 * S, "WIRELESS", True)], "drive_id long, t_ns long, plug string, charging boolean")
    out = cp.compass_rows(df, tr, geo, power)
    rows = sorted(out.filter("drive_id = 1").collect(), key=lambda r: r.t_ns)
    assert len(rows) > 80 and rows[-1].wireless and rows[-1].plug == "WIRELESS" and all(b.t_ns - a.t_ns >= S for a, b in zip(rows, rows[1:]))
    late = [r for r in rows if r.later_half and r.err_deg is not None]
    assert late and np.percentile([r.err_deg for r in late], 90) < 12
    s = {r.drive_id: r for r in cp.compass_summary(out).collect()}
    assert set(s) == {1, 2} and s[1].n_errors == len(late) and s[2].n_errors == 0 and s[2].availability is None and s[1].mounts == 1
    assert cp.compass_rows(df.limit(0), tr, geo, power).count() == 0


def test_table_fits_equal_the_folds(spark):
    from drivelake.operators import motion

    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(12):
        n = [3, 6, 40][k % 3]
        a = rng.uniform(0, 2 * np.pi, n)
        p = rng.normal(0, 50, 2) + np.column_stack([20 * np.cos(a), (20 if k % 2 else 8) * np.sin(a + 0.3)]) + rng.normal(0, 0.3, (n, 2))
        rows += [(k, *map(float, x)) for x in p]
        want[k] = fit_ellipse(p)
    rows += [(99, float(i), 2.0 * i) for i in range(9)]
    got = {r.k: r for r in motion.ellipse_fit(spark.createDataFrame(rows, "k long, x double, y double"), ["k"]).collect()}
    assert len(got) == 13 and got[99].radius is None
    for k, e in want.items():
        assert (got[k].radius is None) == (e is None), k
        if e is not None:
            assert np.allclose([got[k].a, got[k].b, got[k].radius], [*e.centre, e.radius], rtol=1e-5)
            assert np.allclose([got[k].w11, got[k].w12, got[k].w22], [e.shape[0, 0], e.shape[0, 1], e.shape[1, 1]], atol=1e-5)
