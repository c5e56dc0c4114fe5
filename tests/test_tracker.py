"""The motion tracker: hand-made drives of a phone, plain windows, batch against stream."""

import math
import random
import time

import numpy as np
import pytest

from drivelake.streaming import tracker as tk
from drivelake.streaming.tracker import MotionRules, Tracker

S = 1_000_000_000


def mount(tilt_deg=25.0, yaw_deg=40.0):
    """Rows: the car's right, forward and up axes seen from the phone's frame, as a matrix car -> phone."""
    a, b = math.radians(tilt_deg), math.radians(yaw_deg)
    rx = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    rz = np.array([[math.cos(b), -math.sin(b), 0], [math.sin(b), math.cos(b), 0], [0, 0, 1]])
    return rx @ rz


def phone(legs, hz=100, seed=1, noise=0.02, axes=None, speeds=True):
    """Samples (kind, t, sub, x, y, z, w) and truth (t, bearing, speed) of legs (seconds, acceleration, turn rate clockwise in rad/s)."""
    rng, axes = random.Random(seed), mount() if axes is None else axes
    t, v, bearing, out, truth = 0.0, 0.0, 0.0, [], []
    for seconds, acceleration, rate in legs:
        for i in range(int(seconds * hz)):
            shake = 1.0 if v > 0.1 else 0.2
            car = np.array([v * rate, acceleration, 9.81]) + [rng.gauss(0, noise * 10 * shake) for _ in range(3)]
            turn = np.array([0.0, 0.0, -rate]) + [rng.gauss(0, noise * 0.1 * shake) for _ in range(3)]
            ns = round(t * S)
            out.append(("imu", ns, "ACCEL", *map(float, axes @ car), None))
            out.append(("imu", ns + 1000, "GYRO", *map(float, axes @ turn), None))
            if speeds and i % 20 == 0:
                out.append(("vehicle_speed", ns + 2000, None, v, None, None, None))
            truth.append((ns, bearing, v))
            v, bearing, t = max(0.0, v + acceleration / hz), bearing + rate / hz, t + 1 / hz
    return out, truth


TURN = [(5, 0, 0), (5, 2, 0), (5, 0, 0), (6, 0, math.pi / 12), (5, 0, 0)]


def run(samples, rules=MotionRules(), tracker=None):
    t = tracker or Tracker(rules)
    return t, [m for s in samples if (m := t.take(*s)) is not None]


@pytest.mark.parametrize("axes", [mount(0, 0), mount(25, 40), mount(80, 200)])
def test_turn_is_measured_whatever_the_mount(axes):
    t, out = run(phone(TURN, axes=axes)[0])
    assert math.degrees(t.turn(6 * S, 25 * S)) == pytest.approx(90, abs=4)
    assert t.turn(6 * S, 60 * S) is None and t.turn(-5, S) is None
    assert all(b.t_ns - a.t_ns >= 50_000_000 for a, b in zip(out, out[1:]))


def test_rest():
    _, out = run(phone([(5, 0, 0), (5, 2, 0), (5, 0, 0)])[0])
    assert all(m.still and m.still_loose for m in out if 3 * S < m.t_ns < 4 * S)
    assert next(m for m in out if m.t_ns > 4 * S).still_s == pytest.approx(4, abs=1.2)
    assert not any(m.still for m in out if 12 * S < m.t_ns)


def steady(t, start, end, force):
    for i in range(round((end - start) * 100)):
        at, n = start + i / 100, 0.05 * math.sin(i * 1.7)
        x, y, z = force(at)
        t.take("imu", round(at * S), "ACCEL", x + n, y - n, z + n)
        t.take("imu", round(at * S) + 1000, "GYRO", 0.001 * n, 0.0, 0.0)


def lean(deg):
    return 9.81 * math.sin(math.radians(deg)), 0.0, 9.81 * math.cos(math.radians(deg))


def angle(a, b):
    return math.degrees(math.acos(min(1.0, float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)))))


def test_up_follows_gravity_within_seconds_at_a_stop():
    left = []
    for rules in (MotionRules(), MotionRules(still_up_s=None)):
        t = Tracker(rules)
        t.speed_hint = 0.0
        steady(t, 0, 5, lambda _: lean(0))
        steady(t, 5, 17, lambda _: lean(12))
        left.append(angle(t.up(17 * S), lean(12)))
    assert left[0] < 1.5 and left[1] > 5


def test_pulling_away_is_no_tilt():
    t = Tracker()
    t.speed_hint = 0.0
    steady(t, 0, 8, lambda _: lean(0))
    steady(t, 8, 9, lambda s: (1.5 * (s - 8), 0.0, 9.81))
    t.speed_hint = 1.0
    steady(t, 9, 10, lambda _: (1.5, 0.0, 9.81))
    t.speed_hint = 3.0
    steady(t, 10, 13, lambda _: (1.5, 0.0, 9.81))
    assert angle(t.up(13 * S), lean(0)) < 1.5


def test_forward_axis_comes_from_turns_and_goes_with_a_new_mount():
    axes = mount(30, 70)
    legs = [(4, 0, 0), (5, 2, 0), *[(10, 0, math.pi / 20), (5, 0, 0), (10, 0, -math.pi / 20), (5, 0, 0)] * 2]
    samples, _ = phone(legs, axes=axes)
    t, out = run(samples)
    assert out[10].forward is None and angle(out[-1].forward, axes @ [0, 1, 0]) < 6 and out[-1].mount == 0
    turning = [m for m in out if m.left_accel is not None and abs(m.yaw_rate) > 0.1]
    # Ten metres a second times the turn rate, to the left where it is counter-clockwise.
    assert np.mean([m.left_accel / m.yaw_rate for m in turning]) == pytest.approx(10, abs=1)
    end = samples[-1][1]
    for i in range(200):
        t.take("imu", end + i * 10_000_000, "GYRO", 1.0 if i < 60 else 0.0, 0.0, 0.0)
    assert t.mount == 1 and t.forward(end + 2 * S) is None and t.gravity is None


def test_odometry_needs_the_cars_speed():
    samples, truth = phone([(3, 0, 0), (5, 2, 0), (15, 0, 0), (8, 0, math.pi / 16), (15, 0, 0)])
    t, _ = run(samples)
    way, chord, *_ = t.odometry(4 * S, 45 * S)
    e = sum(v * math.sin(b) / 100 for ns, b, v in truth if 4 * S < ns < 45 * S)
    n = sum(v * math.cos(b) / 100 for ns, b, v in truth if 4 * S < ns < 45 * S)
    assert chord == pytest.approx(math.hypot(e, n), rel=0.03) and way > chord + 20
    silent, _ = run([s for s in samples if s[0] != "vehicle_speed"])
    assert silent.odometry(4 * S, 45 * S) is None and silent.turn(4 * S, 45 * S) is not None
    gap, _ = run([s for s in samples if s[0] != "vehicle_speed" or not 20 * S < s[1] < 30 * S])
    assert gap.odometry(4 * S, 45 * S) is None and gap.odometry(31 * S, 45 * S) is not None


def test_windows_equal_plain_ones():
    samples, _ = phone(TURN, noise=0.1)
    _, out = run(samples)
    acc = [(s[1], np.linalg.norm(s[3:6])) for s in samples if s[2] == "ACCEL"]
    gyro = [(s[1], np.linalg.norm(s[3:6])) for s in samples if s[2] == "GYRO"]
    for m in out[::7]:
        last = max(t for t, _ in acc if t <= m.t_ns)
        a = [v for t, v in acc if last - S <= t <= last]
        g = [v for t, v in gyro if m.t_ns - S <= t <= m.t_ns]
        if len(a) > 1:
            assert m.accel_std == pytest.approx(np.std(a, ddof=1), rel=1e-9)
        assert m.gyro_mean == pytest.approx(np.mean(g), rel=1e-9)


def test_slow_gravity_equals_its_closed_form():
    """Without the gyroscope's up, gravity is a weighted mean of all samples, with irregular steps."""
    rng = random.Random(2)
    t, ts, xs = Tracker(MotionRules(up_s=None)), [0], [(1.0, 2.0, 9.0)]
    for _ in range(200):
        ts.append(ts[-1] + rng.randrange(1, 300_000_000))
        xs.append((rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(9.8, 1)))
    for ns, x in zip(ts, xs):
        t.take("imu", ns, "ACCEL", *x)
    keep = [math.exp(-(b - a) / S / 5) for a, b in zip(ts, ts[1:])]
    weights = [math.prod(keep), *((1 - k) * math.prod(keep[i + 1 :]) for i, k in enumerate(keep))]
    assert sum(weights) == pytest.approx(1)
    assert np.allclose(t.gravity, np.array(weights) @ np.array(xs))
    assert np.allclose(t.up(ts[-1]), np.array(t.gravity) / np.linalg.norm(t.gravity))


def test_uncalibrated_gyroscope_only_until_a_calibrated_one():
    t = Tracker()
    t.take("imu", 0, "ACCEL", 0.0, 0.0, 9.8)
    for i in range(20):
        t.take("imu", i * 10_000_000, "GYRO_UNCAL", 0.0, 0.0, 0.1)
    assert t.latest is not None
    t.take("imu", 210_000_000, "GYRO", 0.0, 0.0, 0.1)
    before = t.gyro_t
    assert t.take("imu", 400_000_000, "GYRO_UNCAL", 0.0, 0.0, 9.0) is None and t.gyro_t == before
    assert t.take("imu", 410_000_000, "GYRO", None, 0.0, 9.0) is None and t.take("imu", 410_000_000, "MAG", 1.0, 0.0, 9.0) is None


def frame(spark, drives):
    rows = [(d, t, {"imu": 3, "vehicle_speed": 12}[k], i, k, *rest) for d, samples in drives.items() for i, (k, t, *rest) in enumerate(samples)]
    return spark.createDataFrame(rows, f"drive_id long, {tk.SAMPLES}")


def plain(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else tuple(round(x, 9) for x in v) if isinstance(v, (list, tuple)) else v for v in r) for r in rows)


def test_batch_equals_steps_and_times_between(spark):
    drives = {d: phone(TURN, seed=d, hz=50)[0] for d in range(4)}
    df = frame(spark, drives)
    out = tk.motion_batch(df)
    got = plain(out.collect())
    assert got == plain((d, *m) for d, s in drives.items() for m in run(s)[1])
    assert tk.motion_batch(df.limit(0)).count() == 0
    rng = random.Random(3)
    times = [(d, rng.randrange(-S, 30 * S)) for d in drives for _ in range(50)]
    at = tk.path_at(spark.createDataFrame(times, "drive_id long, t_ns long"), out).collect()
    trackers = {d: run(s)[0] for d, s in drives.items()}
    assert len(at) == len(times)
    for r in at:
        want = trackers[r.drive_id]._at(r.t_ns)
        assert (r.at is None) == (want is None) and (want is None or np.allclose(tuple(r.at), want))


def test_stream_equals_batch(spark, tmp_path):
    """Samples late by up to 0.4 s, over several files."""
    drives = {d: phone([(2, 0, 0), (3, 2, 0)], seed=d, hz=50)[0] for d in (1, 2)}
    df = frame(spark, drives)
    want = plain(tk.motion_batch(df).collect())
    rng = random.Random(1)
    rows = sorted(df.collect(), key=lambda r: r.t_ns + rng.randrange(400_000_000))
    source, n = tmp_path / "in", len(rows) // 3 + 1
    for i in range(3):
        spark.createDataFrame(rows[i * n : (i + 1) * n], df.schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = tk.motion_stream(stream, flush_ms=500).writeStream.format("memory").queryName("motion_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("motion_rows").count() < len(want):
            time.sleep(0.5)
    finally:
        q.stop()
    assert plain(spark.table("motion_rows").collect()) == want
