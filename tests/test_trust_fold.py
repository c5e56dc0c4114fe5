import random
import time

import pytest
from pyspark.sql import functions as F

from drivelake.operators import replay
from drivelake.streaming import trust_fold
from drivelake.streaming.trust_fold import EVENTS, Event, TrustRules, assess, observe, trust_batch, trust_stream

S = 1_000_000_000
STEP = 10 / 111_195  # ten metres of latitude


def fix(t, lat=50.0, source="GNSS", **more):
    values = {"seq": int(t * 10), "t_ns": int(t * S), "rank": 13, "kind": "location", "source": source, "provider": {"GNSS": "gps"}.get(source, source.lower()), "lat": lat, "lon": 30.0, "h_acc_m": 5.0, "speed_mps": 10.0, "bearing_deg": 0.0, "synthetic": False, "latency_s": 0.1}
    return Event(**(values | more))


def drive(seconds, start=0, lat=50.0, **more):
    """Northwards at 10 m/s, one fix a second."""
    return [fix(start + t, lat + t * STEP, **more) for t in range(seconds)]


def run(events, **rules):
    memory, out = {}, []
    for x in events:
        observe(memory, x) if x.kind != "location" else out.append(assess(memory, x, TrustRules(**rules)))
    return out


def states(events, **rules):
    return [r[0] for r in run(events, **rules)]


def other(t, kind, **values):
    return Event(**({"seq": int(t * 10), "t_ns": int(t * S), "rank": 2, "kind": kind} | values))


def test_recovery_after_a_rejection():
    """With rules under which no fix agrees with the estimate."""
    got = states([fix(0), fix(1, 51.0), *drive(7)[2:]], recovery_fixes=3, agree_m=-1.0)
    assert got == ["TRUSTED", "REJECTED", "QUESTIONABLE", "QUESTIONABLE", "QUESTIONABLE", "TRUSTED", "TRUSTED"]


def test_agreement_ends_recovery_at_once():
    got = run([fix(0), fix(1, 51.0), fix(2)])
    assert [r[0] for r in got] == ["TRUSTED", "REJECTED", "TRUSTED"] and got[2][2] == ["AGREES_WITH_ESTIMATE"]


def test_synthetic_fixes_leave_no_trace():
    assert states([fix(0), fix(1, 60.0, synthetic=True), fix(2)]) == ["TRUSTED", "REJECTED", "TRUSTED"]


def test_an_impossible_place_is_never_reset():
    assert set(states([fix(0), *(fix(t, 60.0) for t in range(1, 200))])[1:]) == {"REJECTED"}


def test_gate_rejections_are_reset_by_a_long_consistent_stream():
    """A stream 6 km away after a pause: reachable, so only the gate rejects it; it is taken after 120 s, with a network fix after 15 s."""
    far = 50.0 + 6500 / 111_195
    stream = drive(140, 100, far)
    got = run([fix(0), *stream], hold_growth_mps=0.0, outage_s=1e9, agree_m=-1.0)
    first = next(i for i, r in enumerate(got) if r[2] == ["RESET_AFTER_CONSISTENT_STREAM"])
    assert first == 121 and {r[0] for r in got[1:first]} == {"REJECTED"} and all(r[2] == ["INNOVATION_GATE"] for r in got[1:first])
    net = fix(99, far, source="NETWORK", h_acc_m=800.0)
    got = run([fix(0), net, *stream], hold_growth_mps=0.0, outage_s=1e9, agree_m=-1.0)
    assert got[2 + 15][2] == ["RESET_AFTER_CONSISTENT_STREAM"]


def test_questioned_stream_is_taken_ten_seconds_after_an_outage():
    stream = drive(20, 100, 50.0 + 2000 / 111_195)
    got = run([fix(0), *stream], hold_growth_mps=0.0, agree_m=-1.0)
    assert [r[0] for r in got[1:13]] == ["QUESTIONABLE"] * 10 + ["TRUSTED"] * 2 and got[11][2] == ["RESET_AFTER_CONSISTENT_STREAM"]


def test_network_holds_satellites_to_account():
    net = fix(0, source="NETWORK", h_acc_m=100.0)
    assert run([net, fix(1, 50.5)])[1][2] == ["GEOGRAPHICALLY_IMPOSSIBLE"]
    assert run([net, fix(1, 50.01)])[1][2] == ["NETWORK_DISAGREEMENT"]


def test_replaced_providers_and_echoes():
    over, back = other(1, "provider", provider="gps", event="OVERRIDDEN"), other(10, "provider", provider="gps", event="RESTORED")
    got = run([over, fix(2), fix(2, source="FUSED"), back, fix(12), fix(12, source="FUSED"), fix(25, source="FUSED"), other(26, "provider", provider="network", event="RESTORED"), fix(27, source="FUSED")])
    assert [(r[0], r[2]) for r in got[:4]] == [("UNAVAILABLE", ["SOURCE_OVERRIDDEN"]), ("UNAVAILABLE", ["ECHO_OF_OUR_OUTPUT"]), ("TRUSTED", []), ("UNAVAILABLE", ["ECHO_OF_OUR_OUTPUT"])]
    assert [r[0] for r in got[4:]] == ["TRUSTED", "TRUSTED"]  # a restore of what was never overridden starts no echo


def test_car_speed_satellites_and_velocity():
    assert run([other(0, "vehicle_speed", speed_mps=20.0), fix(1)])[0][2] == ["SPEED_OBD_MISMATCH"]
    assert run([other(0, "vehicle_speed", speed_mps=20.0), fix(2)])[0][2] == []
    assert run([other(0, "gnss_status", used=3, spread_db=4.0), fix(1)])[0][2] == ["FEW_SATELLITES"]
    r = run([other(0, "gnss_status", used=8, spread_db=0.5), fix(1)])[0]
    assert r[0] == "TRUSTED" and r[2] == ["CN0_UNIFORM"] and r[1] == 0.8
    got = run([fix(t, 50.0) for t in range(12)])
    assert got[11][2] == ["VELOCITY_POSITION_MISMATCH"] and got[3][2] == []
    assert run([*drive(11)[:5], *(fix(t, 50.0 + t * STEP, speed_mps=None) for t in range(5, 12))])[11][2] == []


ROW = f"drive_id long, {EVENTS}"


def rows(n=400):
    rng = random.Random(1)
    out = []
    for i in range(n):
        d, t = rng.randrange(5), i * S // 4
        kind = rng.choice(("location",) * 5 + ("vehicle_speed", "gnss_status", "provider"))
        base = {"seq": i, "t_ns": t, "rank": {"location": 13, "vehicle_speed": 12, "gnss_status": 5, "provider": 2}[kind], "kind": kind}
        more = {
            "location": lambda: fix(0, source=rng.choice(("GNSS", "GNSS", "NETWORK", "FUSED")))._asdict() | {"lat": 50 + rng.random() / 50, "h_acc_m": rng.choice((5.0, 60.0, 300.0, None)), "speed_mps": rng.choice((None, 5.0, 30.0)), "synthetic": i % 17 == 0},
            "vehicle_speed": lambda: {"speed_mps": 7.0}, "gnss_status": lambda: {"used": rng.randrange(9), "spread_db": rng.random() * 3}, "provider": lambda: {"provider": rng.choice(("gps", "fused")), "event": rng.choice(("OVERRIDDEN", "RESTORED", "RESTORED"))},
        }[kind]()
        out.append((d, *Event(**(more | base))))
    return out


def plain(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_partitions_do_not_matter(spark):
    table = spark.createDataFrame(rows(), ROW)
    want = plain(trust_batch(table))
    assert plain(trust_batch(table.repartition(7).orderBy(F.rand(3)))) == want and len(want) == table.filter("kind = 'location'").count()
    assert trust_batch(table.filter("false")).count() == 0


@pytest.mark.parametrize("shift", [0, 1])
def test_late_events_across_micro_batches_are_put_in_order(spark, tmp_path, shift):
    """With shift, every third event comes one micro-batch later than the next ones of its drive, by less than the reorder time."""
    table = spark.createDataFrame(rows(240), ROW)
    want = plain(trust_batch(table))
    batch = F.floor((F.col("seq") + F.when((F.col("seq") % 3 == 0) & F.lit(bool(shift)), 1).otherwise(0)) / 60)
    for i in range(5):
        table.filter(batch == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    name = f"verdicts{shift}"
    q = trust_stream(stream, flush_ms=500).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    end = time.time() + 150
    while time.time() < end and spark.table(name).count() < len(want):
        time.sleep(1)
    q.stop()
    got = plain(spark.table(name))
    assert got == want and not any("True" in g.rsplit(",", 1)[1] for g in got)


def test_events_leave_out_rows_without_place(spark):
    loc = spark.createDataFrame([(1, 1, 5, "GNSS", "gps", 50.0, 30.0, None, None, None, False, 0.0), (1, 2, 6, "GNSS", "gps", None, 30.0, None, None, None, False, 0.0), (None, 3, 7, "GNSS", "gps", 50.0, 30.0, None, None, None, False, 0.0)],
                                "drive_id long, seq long, t_ns long, source string, provider string, lat double, lon double, h_acc_m double, speed_mps double, bearing_deg double, synthetic boolean, latency_s double")
    assert [r.seq for r in trust_fold.events_of(loc).collect()] == [1]


def test_runs_comparison_and_reports(spark, tmp_path):
    import glob

    from drivelake.plans.replay_catalog import replay_runs

    ticks, verdicts, summaries = replay_runs(spark, "/root/testdata/sf0.001", [("clean", "hold-last-fix"), ("gnss_jump_5km", "hold-last-fix")])
    assert summaries.count() == 30 and ticks.select("drive", "scenario").distinct().count() <= 30
    jump = summaries.filter("scenario = 'gnss_jump_5km'").agg(F.sum("perturbed_fixes").alias("p"), F.sum("missed_detections").alias("m")).first()
    assert jump.p > 0 and jump.m == 0  # a jump of 5 km is never trusted
    assert summaries.filter("scenario = 'clean'").agg(F.sum("perturbed_fixes")).first()[0] == 0
    table = replay.comparison(summaries, ["drive", "scenario", "variant"])
    lines = [r.value for r in replay.comparison_lines(table, ["drive", "scenario", "variant"]).orderBy("line").collect()]
    assert len(lines) == 31 and lines[0].startswith("drive,scenario,variant,rmse_m,p50_m")
    assert replay.comparison_lines(table, ["drive", "scenario", "variant"], markdown=True).filter("line = 2").first().value.count("---") == 18
    replay.write_reports(str(tmp_path), ticks, verdicts, summaries, ["drive", "scenario", "variant"])
    for name in ("ticks", "trust", "error_vs_time", "summaries", "comparison_csv", "comparison_md"):
        assert glob.glob(str(tmp_path / name / "*")), name


def test_a_dropped_source_takes_its_statuses_along(spark):
    """The first fix after an outage isn't judged by a status from within it."""
    from drivelake.operators import scenario

    statuses = spark.createDataFrame([(1, 0, t * S) for t in range(0, 300, 10)], "drive_id long, seq long, t_ns long")
    t0 = spark.createDataFrame([(1, 0)], "drive_id long, t0_ns long")
    left = scenario.apply_to_records(statuses, "gnss_status", scenario.SCENARIOS["gnss_drop_2min"], t0)
    assert {r.t_ns // S for r in left.collect()} == {*range(0, 120, 10), *range(240, 300, 10)}


def test_runs_of_the_filter_beside_the_held_fix(spark):
    from drivelake.plans.replay_catalog import replay_runs

    ticks, verdicts, summaries = replay_runs(spark, "/root/testdata/sf0.001", [("gnss_drop_2min", "hold-last-fix"), ("gnss_drop_2min", "gyro-only")])
    assert {r.variant: r.n for r in summaries.groupBy("variant").agg(F.count("*").alias("n")).collect()} == {"hold-last-fix": 15, "gyro-only": 15}
    assert ticks.filter("variant = 'gyro-only'").select("mode").distinct().count() >= 2
    assert verdicts.filter("variant = 'gyro-only' AND source <> 'GNSS'").count() == 0 and verdicts.filter("variant = 'gyro-only'").count() > 0
    outage = verdicts.join(summaries.select("drive", "scenario", "variant"), ["drive", "scenario", "variant"]).groupBy("drive", "variant").agg(F.count("*").alias("n"))
    assert outage.groupBy("drive").agg(F.countDistinct("n").alias("k")).filter("k <> 1").count() == 0  # both see the same fixes
