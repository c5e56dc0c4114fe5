"""The filter, the bank of headings and the vote of coarse fixes: hand-made drives, batch against stream."""

import math
import random
import time

import numpy as np
import pytest

from drivelake.streaming import drive_fold, estimators
from drivelake.streaming.drive_fold import Drive, fold_batch, fold_stream
from drivelake.streaming.estimators import ABIAS, PSI, V, Filter, FilterRules, HeadingBank, HoldLastFix, filter_of
from drivelake.streaming.tracker import Motion
from drivelake.streaming.trust_fold import EVENTS, Event, Prediction, TrustRules, assess
from test_tracker import phone

S = 1_000_000_000
LAT, LON = 50.4, 30.5


def north(m):
    return LAT + m / 111_195


def east(m):
    return LON + m / (111_195 * math.cos(math.radians(LAT)))


def fix(t, lat, lon, acc=5.0, speed=None, bearing=None, source="GNSS", **more):
    values = {"seq": round(t * 1000), "t_ns": round(t * S), "rank": 13, "kind": "location", "source": source, "provider": {"GNSS": "gps"}.get(source, source.lower())}
    return Event(**(values | {"lat": lat, "lon": lon, "h_acc_m": acc, "speed_mps": speed, "bearing_deg": bearing, "synthetic": False, "latency_s": 0.1} | more))


def speed(t, v):
    return Event(seq=round(t * 1000), t_ns=round(t * S), rank=12, kind="vehicle_speed", speed_mps=v, speed_acc_mps=0.3)


def moving(t, dt=0.05, **values):
    base = {n: None for n in Motion._fields} | {"t_ns": round(t * S), "dt_s": dt, "yaw_rate": 0.0, "still": False, "still_s": 0.0, "gyro_mean": 0.0, "accel_std": 0.5, "up": (0, 0, 1), "tilt_rms": 0.0, "still_loose": False, "mount": 0, "horizontal_accel": 0.0, "steady_up": True}
    return Motion(**(base | values))


def metres(a, lat, lon):
    return math.hypot((a.lat - lat) * 111_195, (a.lon - lon) * 111_195 * math.cos(math.radians(LAT)))


def healthy(f):
    return np.linalg.eigvalsh(f.p).min() > -1e-9 and np.allclose(f.p, f.p.T)


# The filter.


def test_dead_reckoning_after_satellites_end():
    f = Filter()
    for i in range(20 * 20):
        t = i / 20
        f.on_motion(moving(t))
        if i % 20 == 0:
            f.on_event(fix(t, north(15 * t), LON, speed=15.0, bearing=0.0), "TRUSTED")
            f.on_event(speed(t, 15.0), None)
    before = f.estimate(20 * S)
    for i in range(400, 400 + 60 * 20):
        f.on_motion(moving(i / 20))
        if i % 10 == 0:
            f.on_event(speed(i / 20, 15.0), None)
        assert i % 100 or healthy(f)
    e = f.estimate(80 * S)
    assert metres(e, north(15 * 80), LON) < 30 and e.mode == "DEAD_RECKONING" and e.r68 > before.r68 and before.mode == "GNSS_TRACKING"
    assert f.estimate(80 * S) == e and metres(e, north(15 * 80), LON) < 2.5 * e.r68


def test_turn_by_the_gyroscope():
    f = Filter()
    f.on_event(fix(0, LAT, LON, speed=10.0, bearing=90.0), "TRUSTED")
    for i in range(1, 20 * 9 + 1):
        f.on_motion(moving(i / 20, yaw_rate=-math.radians(10)))  # clockwise
        f.on_event(speed(i / 20, 10.0), None)
    assert math.degrees(f.estimate(9 * S).heading_rad) == pytest.approx(180, abs=3)


def test_rest_pins_speed_and_teaches_the_bias():
    f = Filter()
    f.on_event(fix(0, LAT, LON, speed=1.0, bearing=0.0), "TRUSTED")
    at = f.estimate(0)
    for i in range(1, 400):
        f.on_motion(moving(i / 20, still=True, still_s=i / 20, yaw_rate=0.004))
    assert f.x[V] == pytest.approx(0, abs=0.01) and f.x[4] == pytest.approx(0.004, abs=0.001) and f.estimate(20 * S).mode == "STATIONARY"
    assert metres(f.estimate(20 * S), at.lat, at.lon) < 2
    f.on_motion(moving(20.0))
    assert f.x[V] == FilterRules().pull_away_mps and f.p[V, V] == pytest.approx(100)


def test_local_updates_move_one_state_only():
    rng = np.random.default_rng(1)
    f = Filter()
    a = rng.normal(size=(7, 7))
    f.p, f.x = a @ a.T, rng.normal(size=7)
    x, p = f.x.copy(), f.p.copy()
    f._scalar(V, 3.0, 0.5, local=True)
    assert np.allclose(np.delete(f.x, V), np.delete(x, V)) and f.p[V, V] == pytest.approx(p[V, V] * 0.5 / (p[V, V] + 0.5)) and healthy(f)
    f.p, f.x = p.copy(), x.copy()
    f._scalar(V, 3.0, 0.5)
    gain = p[:, V] / (p[V, V] + 0.5)
    want = x + gain * (3.0 - x[V])
    want[PSI] = estimators._half_turn(want[PSI])
    assert np.allclose(f.x, want) and np.allclose(f.p, p - np.outer(gain, p[V]))


def test_speedometer_scale_is_learned():
    f = Filter()
    for t in range(300):
        f.on_motion(moving(t, dt=1.0))
        f.on_event(fix(t, north(15 * t), LON, speed=15.0, bearing=0.0, speed_acc_mps=0.2), "TRUSTED")
        f.on_event(speed(t + 0.1, 15.45), None)
    assert f.x[5] == pytest.approx(0.03, abs=0.008) and f.x[V] == pytest.approx(15, abs=0.2)


def test_centripetal_force_is_a_speed():
    f = Filter()
    f.on_event(fix(0, LAT, LON, speed=8.0, bearing=0.0), "TRUSTED")
    f.p[ABIAS, ABIAS] = 0.01
    for i in range(1, 20 * 8):
        f.on_motion(moving(i / 20, yaw_rate=0.2, along_accel=0.0, left_accel=0.2 * 12))
    assert f.x[V] == pytest.approx(12, abs=0.7)


def unsteady(rate, rules):
    """A car at 17 m/s whose accelerometer's bias wanders; network fixes only after 20 s."""
    f, worst = Filter(rules), 0.0
    for i in range(200 * 20 + 1):
        t = i / 20
        bias = -1.5 if t < 20 else -1.5 + 2.5 * min(1.0, (t - 20) / 180)
        f.on_motion(moving(t, along_accel=bias, left_accel=0.0, forward=(0, 1, 0), tilt_rms=rate))
        if i % 20 == 0 and t <= 20:
            f.on_event(fix(t, north(17 * t), LON, speed=17.0, bearing=0.0), "TRUSTED")
        elif i % 400 == 0:
            f.on_event(fix(t, north(17 * t), LON, acc=60.0, source="NETWORK"), "TRUSTED")
        if t > 21 and i % 20 == 0:
            worst = max(worst, abs(f.estimate(round(t * S)).speed_mps - 17))
    assert healthy(f)
    return worst


def test_a_wandering_bias_does_not_run_the_speed_away():
    hand, before = unsteady(0.13, FilterRules()), unsteady(0.13, FilterRules(unsteady_rate=None))
    assert hand < 5 and before > 1.5 * hand


def test_a_satellite_fix_far_off_resets_the_place():
    f = Filter()
    f.on_event(fix(0, LAT, LON, speed=10.0, bearing=0.0), "TRUSTED")
    f.on_motion(moving(0.0))
    f.on_motion(moving(1.0))
    f.on_event(fix(1, north(900), LON, speed=10.0, bearing=0.0), "TRUSTED")
    assert metres(f.estimate(S), north(900), LON) < 1
    f.on_event(fix(1.5, north(5000), LON), "QUESTIONABLE")
    f.on_event(fix(1.6, north(5000), LON), "REJECTED")
    f.on_event(fix(1.7, north(5000), LON, synthetic=True), "TRUSTED")
    assert metres(f.estimate(2 * S), north(900), LON) < 15


def coarse_run(f, fixes, until=200, v=10.0):
    """Northwards with the car's speed; coarse fixes at times with offsets to the east."""
    for i in range(until * 4):
        t = i / 4
        f.on_motion(moving(t, dt=0.25))
        f.on_event(speed(t, v), None)
        if t in fixes:
            f.on_event(fix(t, north(v * t), east(fixes[t]), acc=40.0, source="NETWORK"), "TRUSTED")
    return f


def started(**rules):
    f = Filter(FilterRules(bias_std=1e-4, **rules))  # as after a stop
    f.on_event(fix(0, LAT, LON, speed=10.0, bearing=0.0), "TRUSTED")
    return f


def test_one_stray_coarse_fix_barely_counts():
    robust = coarse_run(started(), {100.0: 900}, 101)
    plain = coarse_run(started(robust_nis=None, coarse_reset_nis=1e9), {100.0: 900}, 101)
    off = lambda f: metres(f.estimate(100_750_000_000), north(1007.5), LON)
    assert off(robust) < 0.5 * off(plain) and healthy(robust)
    assert len(robust.strays) == 1


def test_stray_fixes_that_agree_reset_the_place_and_search_the_heading():
    f = coarse_run(started(satellites_recent_s=30.0), {100.0: 5000, 120.0: 5000, 140.0: 5000}, 141)
    assert metres(f.estimate(140_750_000_000), north(1407.5), east(5000)) < 60 and not f.known and f.bank.plane is not None
    kept = coarse_run(started(satellites_recent_s=1e9), {100.0: 5000, 120.0: 5000, 140.0: 5000}, 141)
    assert kept.known
    mixed = coarse_run(started(), {100.0: 5000, 120.0: -5000, 140.0: 5000}, 141)
    assert mixed.known and len(mixed.strays) == 1


def test_coarse_fixes_are_spaced():
    f = coarse_run(started(), {50.0: 0}, 51)
    p = f.p.copy()
    f.on_event(fix(50.8, north(508), LON, acc=400.0, source="NETWORK"), "TRUSTED")
    assert f.coarse[0] == 50 * S and f.p[0, 0] >= p[0, 0] - 1e-9


# The bank of headings.


def bank_drive(heading_deg, seconds=80, speed_std=0.3, noise=30.0, seed=1):
    rng, bank = random.Random(seed), HeadingBank()
    h = math.radians(heading_deg)
    for i in range(seconds * 4):
        t = i / 4
        if i % 52 == 0:
            bank.fix(north(10 * t * math.cos(h) + rng.gauss(0, noise)), east(10 * t * math.sin(h) + rng.gauss(0, noise)), noise**2)
        if bank.converged():
            return t, bank
        bank.move(0.25, 0.0, 10.0, speed_std**2)
    return None, bank


@pytest.mark.parametrize("heading", [0, 77, 185, 300])
def test_bank_finds_the_heading(heading):
    t, bank = bank_drive(heading)
    mean, cov = bank.mixture()
    assert t is not None and abs((math.degrees(mean[2]) - heading + 180) % 360 - 180) < 25
    assert np.linalg.eigvalsh(cov).min() > 0


def test_bank_needs_fixes_way_and_speed():
    assert bank_drive(77, seconds=28)[0] is None
    assert bank_drive(77)[0] < bank_drive(77, speed_std=10.0)[0]


def test_bank_gives_the_filter_its_heading():
    f = Filter()
    for i in range(140 * 4):
        t = i / 4
        f.on_motion(moving(t, dt=0.25))
        f.on_event(speed(t, 10.0), None)
        if i % 52 == 0:
            f.on_event(fix(t, north(10 * t), LON, acc=40.0, source="NETWORK"), "TRUSTED")
    e = f.estimate(140 * S)
    assert f.known and abs((math.degrees(e.heading_rad) + 180) % 360 - 180) < 15 and metres(e, north(1400), LON) < 100 and healthy(f)


# The vote of coarse fixes.


class Road:
    """A straight road northwards at a speed; the path's own bearing is 0 where vector is true."""

    def __init__(self, v, known_from=-math.inf, vector=False):
        self.v, self.known_from, self.vector = v, known_from, vector

    def still_s(self):
        return 0.0

    def turn(self, t1, t2):
        return 0.0

    def odometry(self, t1, t2):
        d = (t2 - t1) / 1e9 * self.v
        return None if t1 < self.known_from * S else (d, d, 0.0, d if self.vector else 0.0, 0.0 if self.vector else None)


def judged(road, fixes, predicted=None, **rules):
    memory, out = {}, []
    for t, m, acc, *more in fixes:
        x = fix(t, north(m), east(more[0]) if more else LON, acc=acc, source="NETWORK")
        out.append(assess(memory, x, TrustRules(**rules), road, predicted)[::2][0:2])
    return [s for s, _ in out], [r for _, r in out]


def test_a_stale_coarse_fix_is_rejected_once_the_voters_are_confirmed():
    states, reasons = judged(Road(15), [(-16, -240, 40), (0, 0, 40), (20, 20, 40), (33, 480, 40)])
    assert states == ["TRUSTED", "TRUSTED", "REJECTED", "TRUSTED"] and reasons[2] == ["COARSE_ODOMETRY_MISMATCH"]
    states, reasons = judged(Road(15), [(0, 0, 40), (20, 20, 40), (36, 540, 40), (52, 560, 40)])
    assert states == ["TRUSTED", "QUESTIONABLE", "TRUSTED", "REJECTED"] and reasons[1] == ["COARSE_ODOMETRY_DISPUTED"]


def test_a_jump_is_rejected_and_vague_voters_count_less():
    assert judged(Road(13), [(-17, -221, 60), (0, 0, 60), (17, 1100, 140)])[0][-1] == "REJECTED"
    vague = [(0, 0, 200), (13, 169, 700), (26, 338, 700), (39, 1600, 157)]
    assert judged(Road(13), vague)[0][-1] == "REJECTED" and judged(Road(13), vague, vote_weighted=False)[0][-1] == "TRUSTED"


def test_one_bad_reference_does_not_lock_the_source_out():
    assert judged(Road(10), [(0, 400, 40), (13, 130, 40), (26, 260, 40), (39, 390, 40)])[0] == ["TRUSTED", "QUESTIONABLE", "TRUSTED", "TRUSTED"]


def test_start_of_a_drive_without_odometry():
    at = lambda t: (t - 32.2) * 12.5
    fixes = [(1.7, at(1.7) + 1000, 52), (32.2, at(32.2) - 190, 60), (53.4, at(53.4) + 10, 28), (91.8, at(91.8) - 10, 17)]
    assert judged(Road(12.5, 12), fixes)[0] == ["TRUSTED", "TRUSTED", "QUESTIONABLE", "TRUSTED"]
    assert judged(Road(12.5, 12), fixes, unconfirmed_reject=True)[0] == ["TRUSTED", "TRUSTED", "REJECTED", "TRUSTED"]


def sideways(heading_deg, std_deg, satellite=False):
    memory, road = {}, Road(10, vector=True)
    told = Prediction(LAT, LON, 1e4, 0.0, 1e4, None if heading_deg is None else math.radians(heading_deg), math.radians(std_deg))
    if satellite:
        assess(memory, fix(-5, north(-50), LON, speed=10.0, bearing=0.0), TrustRules(), road, None)
    for i in range(3):
        assess(memory, fix(13 * i, north(130 * i), LON, acc=60.0, source="NETWORK"), TrustRules(), road, told)
    return assess(memory, fix(52, north(260), east(260), acc=130.0, source="NETWORK"), TrustRules(), road, told)[0]


def test_direction_counts_only_where_the_heading_is_known_without_satellites():
    assert sideways(0, 5) == "REJECTED"
    assert sideways(None, 5) == sideways(0, 40) == sideways(0, 5, satellite=True) == "TRUSTED"


def test_course_and_rest_are_checked():
    class Turned(Road):
        def turn(self, t1, t2):
            return math.radians(80)

        def still_s(self):
            return 4.0

    fixes = [fix(0, LAT, LON, speed=10.0, bearing=0.0), fix(1, north(10), LON, speed=10.0, bearing=0.0)]
    memory = {}
    got = [assess(memory, x, TrustRules(agree_m=-1.0), Turned(10), None)[2] for x in fixes]
    assert got[0] == ["MOVING_WHILE_STATIONARY"] and got[1] == ["COURSE_GYRO_MISMATCH", "MOVING_WHILE_STATIONARY"]


# Whole drives.


def drive_events(seed=1, gap=(30, 60), hz=20):
    """A drive of a phone with satellites but for a gap, the car's speed, and network fixes."""
    samples, truth = phone([(5, 0, 0), (5, 2, 0), (20, 0, 0), (6, 0, math.pi / 12), (40, 0, 0)], hz=hz, seed=seed)
    rng, out, e, n = random.Random(seed), [], 0.0, 0.0
    for i, (kind, t, sub, x, y, z, w) in enumerate(samples):
        if kind == "imu":
            out.append(Event(seq=i, t_ns=t, rank=3, kind="imu", event=sub, x=x, y=y, z=z))
        else:
            out.append(Event(seq=i, t_ns=t, rank=12, kind="vehicle_speed", speed_mps=x, speed_acc_mps=0.3))
    for i, (t, bearing, v) in enumerate(truth):
        e, n = e + v * math.sin(bearing) / hz, n + v * math.cos(bearing) / hz
        if i % hz == 0 and not gap[0] <= t / S < gap[1]:
            out.append(fix(t / S, north(n + rng.gauss(0, 2)), east(e + rng.gauss(0, 2)), speed=v, bearing=math.degrees(bearing) % 360, seq=10**6 + i))
        if i % (13 * hz) == 0:
            out.append(fix(t / S, north(n + rng.gauss(0, 20)), east(e + rng.gauss(0, 20)), acc=40.0, source="NETWORK", seq=2 * 10**6 + i))
    places = {}
    e = n = 0.0
    for t, bearing, v in truth:
        places[t] = (north(n), east(e))
        e, n = e + v * math.sin(bearing) / hz, n + v * math.cos(bearing) / hz
    return sorted(out, key=lambda x: (x.t_ns, x.rank, x.seq)), places


def test_filter_bridges_a_gap_where_the_held_fix_drifts_off():
    events, places = drive_events()
    worst = {}
    for name in ("baseline", "passthrough"):
        d = Drive(name)
        rows = [r for x in events for r in d.take(x) if r[0] == "estimate"]
        worst[name] = max(metres(estimators.Estimate(*[r[1], r[11], r[12], *[0] * 3], *[None] * 4, ""), *places[r[1]]) for r in rows if 35 * S < r[1] < 59 * S)
        assert [r[1] for r in rows] == sorted(r[1] for r in rows) and all(r[1] % S == 0 for r in rows)
        if name == "baseline":
            assert {"GNSS_TRACKING", "DEAD_RECKONING"} <= {r[-1] for r in rows}
    assert worst["baseline"] < 60 < worst["passthrough"]


def rows_of(spark, drives):
    return spark.createDataFrame([(d, *x) for d, events in drives.items() for x in events], f"drive_id long, {EVENTS}")


def plain(rows):
    return sorted((tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r) for r in rows), key=str)


def test_batch_equals_steps(spark):
    drives = {d: drive_events(d)[0] for d in (1, 2)}
    df = rows_of(spark, drives)
    want = []
    for d, events in drives.items():
        fold = Drive()
        want += [(d, *r) for x in events for r in fold.take(x)]
    out = fold_batch(df)
    assert plain(out.collect()) == plain(want) and fold_batch(df.limit(0)).count() == 0
    assert drive_fold.verdicts_of(out).count() + drive_fold.estimates_of(out).count() == len(want)
    with pytest.raises(ValueError):
        fold_batch(df, "none")


def test_registered_estimators_and_runs_by_variant(spark):
    estimators.register("no-accelerometer", filter_of(accel=False))
    events = drive_events(3)[0]
    runs = {"3|a": "baseline", "3|b": "no-accelerometer", "3|c": "passthrough"}
    df = spark.createDataFrame([(k, *x) for k in runs for x in events], f"drive_id string, {EVENTS}")
    out = fold_batch(df, {k.split("|")[1]: v for k, v in runs.items()})
    for key, name in runs.items():
        fold = Drive(name)
        assert plain(tuple(r)[1:] for r in out.filter(f"drive_id = '{key}'").collect()) == plain(r for x in events for r in fold.take(x))


def test_stream_equals_batch(spark, tmp_path):
    df = rows_of(spark, {d: [x for x in drive_events(d)[0] if x.t_ns < 15 * S] for d in (1, 2)})
    want = plain(fold_batch(df).collect())
    rng = random.Random(1)
    rows = sorted(df.collect(), key=lambda r: r.t_ns + rng.randrange(400_000_000))
    n = len(rows) // 3 + 1
    for i in range(3):
        spark.createDataFrame(rows[i * n : (i + 1) * n], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = fold_stream(stream, flush_ms=500).writeStream.format("memory").queryName("fold_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("fold_rows").count() < len(want):
            time.sleep(0.5)
    finally:
        q.stop()
    assert plain(spark.table("fold_rows").collect()) == want


def test_held_fix_needs_trust():
    h = HoldLastFix()
    h.on_event(fix(0, LAT, LON), "QUESTIONABLE")
    assert h.estimate(0) is None
    h.on_event(fix(0, LAT, LON, acc=None), "TRUSTED")
    e = h.estimate(4 * S)
    assert e.r68 == pytest.approx(90) and e.mode == "COARSE_ONLY" and h.estimate(S).mode == "GNSS_TRACKING"


def test_an_estimate_leaves_the_filter_as_it_is_and_copies_nothing_at_its_own_time(monkeypatch):
    for course in (90.0, None):  # the heading known, and a bank of headings
        f = Filter()
        f.on_event(fix(0, LAT, LON, speed=10.0, bearing=course), "TRUSTED")
        f.on_event(fix(1, north(40), LON, acc=80.0, source="NETWORK"), "TRUSTED")
        f.on_motion(moving(1.5, yaw_rate=0.1))
        before = f.x.copy(), f.p.copy(), f.t, f.known, f.way, f.bank.clone().__dict__
        later = f.estimate(4 * S)
        assert later != f.estimate(3 * S) and f.estimate(4 * S) == later
        after = f.x, f.p, f.t, f.known, f.way, f.bank.__dict__
        assert all(np.array_equal(a, b) for a, b in zip(before[:2], after)) and before[2:5] == after[2:5]
        assert all(np.array_equal(a, b) for a, b in zip(before[5].values(), after[5].values()))
        with monkeypatch.context() as m:
            m.setattr(HeadingBank, "clone", lambda _: pytest.fail("copied"))
            assert f.estimate(f.t).t_ns == f.t
