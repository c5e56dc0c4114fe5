"""Situations in miniature for the relational operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from drivelake.functions import geo
from drivelake.operators import matching, metrics, motion, roads, scenario, tables, throttle, tracks, trust
from drivelake.plans import registry
from drivelake.streaming.probe import Probe

S = 1_000_000_000
FIX = "drive_id long, seq long, t_ns long, source string, lat double, lon double, h_acc_m double, speed_mps double, bearing_deg double, is_mock boolean"


def fix(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], FIX)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_geodesy(spark):
    lit = F.lit
    assert 11.5e6 < one(spark, geo.haversine_m(lit(50.45), lit(30.52), lit(-12.05), lit(-77.04)))[0] < 12.5e6
    lat, lon = one(spark, *geo.destination(lit(50.0), lit(30.0), lit(1000.0), lit(90.0)))
    assert abs(one(spark, geo.haversine_m(lit(50.0), lit(30.0), lit(lat), lit(lon)))[0] - 1000) < 1e-3
    assert abs(one(spark, geo.bearing_deg(lit(50.0), lit(30.0), lit(lat), lit(lon)))[0] - 90) < 0.01
    assert one(spark, geo.wrap_deg(lit(540.0)), geo.wrap_deg(lit(-180.0)), geo.wrap_deg(lit(-190.0)))[:] == (180.0, 180.0, 170.0)
    e, n = one(spark, *geo.to_enu(lit(50.0), lit(179.999), *geo.offset_by(lit(50.0), lit(179.999), lit(300.0), lit(-40.0))))
    assert (round(e, 6), round(n, 6)) == (300.0, -40.0)
    assert one(spark, geo.speed_of_obd(lit("SEARCHING...\r41 0D 2A\r>")), geo.speed_of_obd(lit("NO DATA")))[:] == (42, None)


def test_noise_does_not_depend_on_partitions(spark):
    def mean_and_std(parts):
        return spark.range(20000).repartition(parts).select(geo.gaussian(F.lit(42), F.col("id")).alias("g")).agg(F.round(F.avg("g"), 9), F.round(F.stddev("g"), 9)).first()

    assert mean_and_std(1) == mean_and_std(7)
    assert abs(mean_and_std(3)[0]) < 0.03 and abs(mean_and_std(3)[1] - 1) < 0.03


def test_interpolation_needs_a_short_gap_but_not_for_exact_hits(spark):
    truth = fix(spark, (0, "GNSS", 50.0, 179.9, 5.0, 10.0, 350.0, False), (2 * S, "GNSS", 50.2, -179.9, 5.0, 20.0, 10.0, False), (9 * S, "GNSS", 51.0, 0.0, 5.0, 0.0, 0.0, False))
    ticks = spark.createDataFrame([(1, 0), (1, S), (1, 2 * S), (1, 5 * S), (1, 9 * S), (1, 10 * S), (2, S)], "drive_id long, t_ns long")
    got = {(r.drive_id, r.t_ns): r for r in tracks.interpolate(ticks, truth).collect()}
    assert len(got) == 7
    mid = got[1, S]
    assert (round(mid.truth_lat, 9), round(mid.truth_speed, 9)) == (50.1, 15.0)
    assert abs(abs(mid.truth_lon) - 180) < 1e-9 and round(mid.truth_bearing, 9) % 360 == 0
    assert got[1, 2 * S].truth_lat == 50.2 and got[1, 9 * S].truth_lat == 51.0
    assert got[1, 5 * S].truth_lat is None and got[1, 10 * S].truth_lat is None and got[2, S].truth_lat is None


def test_as_of_takes_the_row_before(spark):
    f = fix(spark, (0, "GNSS", 0.0, 0.0, 1.0, 0.0, 0.0, False), (S, "NETWORK", 1.0, 0.0, 1.0, 0.0, 0.0, False), (S, "GNSS", 2.0, 0.0, 1.0, 0.0, 0.0, False), (2 * S, "NETWORK", 3.0, 0.0, 1.0, 0.0, 0.0, False))
    out = tracks.with_last(f, F.col("source") == "NETWORK", {"net": F.col("seq")}).orderBy("seq").collect()
    assert [r.net for r in out] == [None, None, 1, 1]


def test_ticks_and_sessions(spark):
    f = fix(spark, *((t, "GNSS", 0.0, 0.0, 1.0, 0.0, 0.0, False) for t in (S // 2, 3 * S, 50 * S, 51 * S)))
    assert [r.t_ns // S for r in tracks.tick_grid(f).orderBy("t_ns").collect()] == list(range(1, 52))
    assert [(r.session, r.n) for r in tracks.gap_sessions(f, 30).orderBy("session").collect()] == [(0, 2), (1, 2)]


def test_trust_states(spark):
    rows = [(0, "GNSS", 0.0, 0.0, a, 0.0, 0.0, m) for a, m in ((5.0, False), (60.0, False), (500.0, False), (None, False), (5.0, True))]
    out = trust.stateless_trust(fix(spark, *rows), F.lit(0.1)).orderBy("seq").collect()
    assert [(r.state, r.reasons) for r in out] == [("TRUSTED", []), ("QUESTIONABLE", ["POOR_ACCURACY"]), ("REJECTED", ["POOR_ACCURACY"]), ("QUESTIONABLE", ["NO_ACCURACY"]), ("REJECTED", ["SYNTHETIC_INPUT"])]
    assert [round(r.confidence, 6) for r in out] == [1.0, 0.3, 0.05, 0.25, 0.0]


def test_steps_apply_in_order_and_labels_tell_the_offset(spark):
    f = fix(spark, *((t * S, "GNSS", 50.0, 30.0, 5.0, 10.0, 0.0, False) for t in (0, 10, 20, 30)))
    steps = [scenario.Step("offset", 10, 15, east_m=300), scenario.Step("offset", 20, None, east_m=-300), scenario.Step("drop_source", 30)]
    out = scenario.apply_steps(f, steps)
    got = [(r.t_ns // S, round(r.d, 2)) for r in out.select("t_ns", scenario.injected_offset(out).alias("d")).orderBy("t_ns").collect()]
    assert got[0] == (0, 0.0) and abs(got[1][1] - 300) < 1 and got[2][1] < 0.01 and len(got) == 3


@pytest.mark.parametrize("name", sorted(scenario.SCENARIOS))
def test_all_scenarios_keep_or_drop_rows_only_as_named(spark, name):
    f = fix(spark, *((t * S, s, 50.0, 30.0, 5.0, 10.0, 0.0, False) for t in range(0, 500, 10) for s in ("GNSS", "NETWORK")))
    out = scenario.apply_steps(f, scenario.SCENARIOS[name])
    assert out.filter("source = 'NETWORK' AND lat = 50.0").count() == 50
    assert scenario.apply_steps(f.filter("false"), scenario.SCENARIOS[name]).count() == 0
    assert (out.count() == 100) == ("drop" not in name and "absent" not in name)


def test_first_window_wins_and_recovery(spark):
    ticks = spark.createDataFrame([(1, t * S, t, float(e), 10.0) for t, e in ((0, 1), (5, 60), (9, 300), (12, 150), (15, 5))], "drive_id long, t_ns long, seq long, err_m double, r68 double")
    windows = spark.createDataFrame([(1, 0, "a", 4 * S, 10 * S), (1, 1, "b", 8 * S, 10 * S), (2, 0, "c", 0, 99 * S)], "drive_id long, step_idx int, kind string, start_ns long, end_ns long")
    got = {r.seq: r.kind for r in metrics.with_first_window(ticks, windows).collect()}
    assert got == {0: None, 5: "a", 9: "a", 12: None, 15: None}
    ends = spark.createDataFrame([(1, 15 * S)], "drive_id long, end_ns long")
    a = metrics.window_metrics(ticks, windows, ends).filter("kind = 'a'").first()
    assert (a.max_err_m, a.err_at_end_m, a.exceed_50m_s, a.exceed_250m_s, a.exceed_500m_s, a.recovery_s) == (300.0, 300.0, 1.0, 5.0, None, 5.0)


def test_percentiles_are_linear_and_empty_is_null(spark):
    t = spark.createDataFrame([(float(x), 2.0) for x in (1, 2, 3, 4)], "err_m double, r68 double")
    r = t.agg(*metrics.error_stats()).first()
    assert (r.n, r.p50_m, round(r.p95_m, 9), r.max_m, r.within68, r.within95) == (4, 2.5, 3.85, 4.0, 0.5, 0.75)
    assert t.filter("false").agg(*metrics.error_stats()).first().p95_m is None
    assert math.isclose(r.rmse_m, math.sqrt(7.5))


def test_ways_split_at_shared_nodes(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [5, 3, 6]), (3, [7, 8])], "way_id long, nodes array<long>")
    seg = tables.split_ways(ways)
    assert {(r.way_id, r.piece, r.start_node, r.end_node, r.n_nodes) for r in seg.collect()} == {(1, 0, 1, 3, 3), (1, 1, 3, 4, 2), (2, 0, 5, 3, 2), (2, 1, 3, 6, 2), (3, 0, 7, 8, 2)}
    assert {(r.from_way, r.to_way, r.to_piece) for r in tables.segment_edges(seg).collect()} == {(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1)}


def test_nesting_keeps_parents_without_children(spark):
    p = spark.createDataFrame([(1,), (2,)], "id long")
    c = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (9, 1, "x")], "pid long, pos int, v string")
    n = tables.nest_children(p, c, "id", "pid", ["v"], "pos")
    assert {r.id: [x.v for x in r["items"]] for r in n.collect()} == {1: ["a", "b"], 2: []}
    assert tables.unnest_children(n, ["id"]).count() == 2


def test_teleport_keeps_differences_in_degrees_and_moves_fused_too(spark):
    f = fix(spark, *((t * S, s, 50.0 + t / 1000, 30.0 + t / 1000, 5.0, 10.0, 0.0, False) for t, s in ((0, "GNSS"), (120, "GNSS"), (125, "FUSED"), (130, "NETWORK"), (420, "GNSS"))))
    out = scenario.apply_steps(f, scenario.SCENARIOS["gnss_teleport_country"]).orderBy("t_ns").collect()
    assert [(round(r.lat, 6), round(r.lon, 6)) for r in out] == [(50.0, 30.0), (-12.0464, -77.0428), (-12.0414, -77.0378), (50.13, 30.13), (50.42, 30.42)]
    moved = scenario.apply_steps(f, scenario.SCENARIOS["gnss_jump_5km"])
    assert {r.source for r in moved.filter("abs(lon - lon0) > 0.01").collect()} == {"GNSS", "FUSED"}


def test_honest_noise_counts_unknown_accuracy_as_zero(spark):
    f = fix(spark, (0, "GNSS", 50.0, 30.0, None, 10.0, 0.0, False))
    assert abs(scenario.apply_steps(f, [scenario.Step("inflate_noise", sigma_m=10, honest=True)]).first().h_acc_m - 15.096) < 1e-9


def test_windows_end_with_their_drive(spark):
    spans = spark.createDataFrame([(1, 7, 100 * S)], "drive_id long, t0_ns long, end_ns long")
    got = scenario.degraded_windows(spans, [scenario.Step("drop_source", 10), scenario.Step("drop_source", source="FUSED"), scenario.Step("drift", 90.5, 60, rate_mps=1)]).collect()
    assert [(r.step_idx, r.kind, r.start_ns, r.end_ns) for r in got] == [(0, "gnss_outage", 10 * S + 7, 100 * S), (2, "gnss_drift", 90 * S + S // 2 + 7, 100 * S)]
    assert scenario.degraded_windows(spans, []).count() == 0


def test_scenario_files_and_variants(tmp_path):
    (tmp_path / "b.json").write_text('{"name": "b", "seed": 7, "steps": [{"type": "offset", "startS": 1, "dEastM": 5, "dNorthM": 0, "sources": ["GNSS"], "new": 1}, {"type": "drop_sensor", "kind": "GYRO"}]}')
    (tmp_path / "a.json").write_text('{"name": "a"}')
    got = scenario.load_scenarios(str(tmp_path))
    assert list(got) == ["a", "b"] and got["a"] == ([], 42) and got["b"][1] == 7
    assert got["b"][0] == [scenario.Step("offset", 1.0, east_m=5.0, sources=frozenset({"GNSS"})), scenario.Step("drop_sensor", sensor="GYRO")]
    for bad in ({"type": "nothing"}, {"type": "offset", "startS": 1}):
        with pytest.raises(ValueError):
            scenario.step_of(bad)
    assert "phone+network+osm" not in scenario.load_variants() and len(scenario.load_variants(with_roads=True)) == 11
    with pytest.raises(ValueError):
        scenario.load_variants(names=["none"])


def test_ticks_are_exact_at_epoch_times(spark):
    t = 1_700_000_000 * S
    f = fix(spark, *((x, "GNSS", 0.0, 0.0, 1.0, 0.0, 0.0, False) for x in (t + 1, t + 2 * S)))
    assert [r.t_ns - t for r in tracks.tick_grid(f).orderBy("t_ns").collect()] == [S, 2 * S]


def test_unknown_speed_voids_a_velocity_window(spark):
    rows = [(t * S, "GNSS", 50.0, 30.0, 5.0, None if t == 5 else 0.5, None, False) for t in range(12)]
    out = tracks.velocity_consistency(fix(spark, *rows)).orderBy("t_ns").collect()
    assert out[11].mismatch is None
    rows = [(t * S, "GNSS", 50.0, 30.0, 5.0, 0.5, None, False) for t in range(12)]
    assert tracks.velocity_consistency(fix(spark, *rows)).orderBy("t_ns").collect()[11].mismatch is False


def test_null_places_have_no_distance(spark):
    lit = F.lit
    assert one(spark, geo.haversine_m(lit(50.0), lit(30.0), lit(None), lit(30.0)), geo.cov_sigma(lit(None), lit(1.0)))[:] == (None, None)
    assert one(spark, geo.speed_of_obd(lit("41\r0D2A")), geo.speed_of_obd(lit("41 0D GG\r41 0D 11")), geo.speed_of_obd(lit("410D\r41 0D 1F")))[:] == (None, None, 31)
    assert one(spark, geo.ceil_to(lit(-1500), 1000), geo.ceil_to(lit(-1000), 1000), geo.ceil_to(lit(1), 1000))[:] == (-1000, -1000, 1000)


def test_stops_and_departures(spark):
    speeds = [0.0] * 6 + [5.0] * 4 + [0.2] * 3 + [4.0] * 3
    own = [0.1] * 8 + [4.0] * 8
    ticks = spark.createDataFrame([(1, t * S, t, a, b) for t, (a, b) in enumerate(zip(speeds, own))], "drive_id long, t_ns long, seq long, truth double, speed double")
    r = motion.stop_score(ticks).first()
    assert (r.n, r.moving, r.false_stops, r.longest_false_stop, r.stops, r.missed_stops, r.sustained_stops) == (16, 7, 2, 2, 9, 3, 1)
    d = motion.departures(ticks).collect()
    assert [(x.end_ns // S, x.departure_ns // S, x.delay_s, x.stopped_before) for x in d] == [(5, 6, 2.0, True)]
    assert motion.stop_score(ticks.filter("false")).count() == 0


def test_circles(spark):
    p = [(g, 3 + 2 * math.cos(a), -1 + 2 * math.sin(a)) for g, n in ((1, 20), (2, 2)) for a in (2 * math.pi * k / n for k in range(n))] + [(3, float(x), 2.0 * x) for x in range(5)]
    got = {r.g: (r.a, r.b, r.radius) for r in motion.circle_fit(spark.createDataFrame(p, "g long, x double, y double"), ["g"]).collect()}
    assert all(abs(x - y) < 1e-9 for x, y in zip(got[1], (3, -1, 2))) and got[2] == got[3] == (None, None, None)


def test_roads_between_parallel_streets(spark):
    """An avenue 1-2-3, a one-way street 4-2-5, a bridge without a shared node."""
    ways = spark.createDataFrame(
        [(1, [1, 2, 3], [50.0, 50.0, 50.0], [30.0, 30.01, 30.02], "primary", False, 2, 0, "A"), (2, [4, 2, 5], [50.01, 50.0, 49.99], [30.01] * 3, "residential", True, 0, 0, "B"), (3, [6, 7], [50.01, 49.99], [30.015] * 2, "primary", False, 0, 1, "C"), (4, [8], [50.0], [30.0], "road", False, 0, 0, "")],
        "way_id long, node_ids array<long>, lats array<double>, lons array<double>, road_class string, oneway boolean, lanes int, layer int, name string",
    )
    seg = roads.segments(ways)
    assert {(r.way_id, r.piece, r.start_node, r.end_node) for r in seg.collect()} == {(1, 0, 1, 2), (1, 1, 2, 3), (2, 0, 4, 2), (2, 1, 2, 5), (3, 0, 6, 7)}
    go = {(r.way_id, r.piece, r.side, r.to_way, r.to_piece, r.forward) for r in roads.successors(seg).collect()}
    assert go == {(1, 0, "end", 1, 1, True), (1, 0, "end", 2, 1, True), (1, 1, "start", 1, 0, False), (1, 1, "start", 2, 1, True), (2, 0, "end", 1, 0, False), (2, 0, "end", 1, 1, True), (2, 0, "end", 2, 1, True)}
    edges = roads.edges_of_segments(seg, 50.0, 30.01)
    points = spark.createDataFrame([(1, 50.0001, 30.005), (2, 50.005, 30.0101)], "id long, lat double, lon double")
    near = {(r.id, r.way_id, r.piece): r for r in roads.project(points, edges, 20.0, 50.0, 30.01, ["id"]).collect()}
    assert set(near) == {(1, 1, 0), (2, 2, 0)} and abs(near[1, 1, 0].distance_m - 11.12) < 0.1 and near[1, 1, 0].cross_m < 0 and abs(near[1, 1, 0].bearing_deg - 90) < 0.01
    assert near[2, 2, 0].cross_m < 0  # driving south, the east lies to the left
    assert roads.segments(ways.filter("false")).count() == 0


def test_throttle_keeps_changes_and_one_a_period(spark):
    rows = [(1, t * S, t, p) for t, p in ((0, "a"), (1, "a"), (2, "b"), (3, "b"), (13, "b"), (14, "b"))] + [(2, 0, 9, "a"), (None, 0, 10, "a")]
    t = spark.createDataFrame(rows, "drive_id long, t_ns long, seq long, plug string")
    assert sorted(r.seq for r in throttle.at_most_every(t, ["plug"], 10.0).collect()) == [0, 2, 9, 13]


def test_near_pairs_of_any_cell_and_round_the_globe(spark):
    points = spark.createDataFrame([(1, 50.0, 179.9999), (2, 50.0, 30.0), (3, None, 1.0)], "id long, lat double, lon double")
    others = spark.createDataFrame([(7, 50.0, -179.9999), (8, 50.0009, 30.0), (9, 50.1, 30.0), (10, None, None)], "o_id long, o_lat double, o_lon double")
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"))
    for cell in (0.0005, 0.01, 1.0):
        got = sorted((r.id, r.o_id) for r in tables.near_pairs(points, others, d, 120.0, cell).collect())
        assert got == [(1, 7), (2, 8)]



def test_near_places_pairs_bundles_and_splits_dense_cells(spark, monkeypatch):
    here = [(i, 50.0 + i % 4 / 1e5, 30.0) for i in range(400)]  # a hundred rows at each of four places of one cell
    points = spark.createDataFrame(here + [(900, 50.1, 30.0)], "id long, lat double, lon double")
    others = spark.createDataFrame([(-i, lat, lon) for i, lat, lon in here] + [(7, None, 30.0)], "o_id long, o_lat double, o_lon double")
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"))
    near = tables.near_places(points, others, d, 2.0, 0.0005)
    assert near.count() == 10 * 2 * 2  # ten pairs of places up to a metre apart, two bundles at each
    want = sorted((i, -j) for i in range(400) for j in range(400) if abs(i % 4 - j % 4) <= 1)
    for limits in ({}, {"POINTS": 30, "OTHERS": 50, "BUNDLE": 7}, {"POINTS": 1000, "OTHERS": 100}, {"POINTS": 100, "OTHERS": 1000}):
        for name, limit in limits.items():
            monkeypatch.setattr(tables, name, limit)
        pairs = tables.near_pairs(points, others, d, 2.0, 0.0005)
        assert pairs.columns == ["id", "lat", "lon", "o_id", "o_lat", "o_lon", "distance_m"]
        assert sorted((r.id, r.o_id) for r in pairs.collect()) == want
        assert limits != {"POINTS": 30, "OTHERS": 50, "BUNDLE": 7} or pairs.select(F.spark_partition_id()).distinct().count() > 1  # one cell, several tasks


def test_probe_opens_recovers_and_passes_through():
    p = Probe()
    for t in range(12):
        p.on_status(t * S, True)
        action = p.step(t * S)
    assert p.phase == "WINDOW" and action == "NONE" and p.opened == 10 * S
    p.on_verdict(12 * S, "GNSS", "REJECTED", {"INNOVATION_GATE"})  # says nothing
    assert p.step(12 * S) == "NONE"
    p.on_verdict(13 * S, "GNSS", "TRUSTED", set())
    assert (p.step(13 * S), p.result, p.phase) == ("CLOSE", "RECOVERED", "IDLE")
    p.on_status(72 * S, True)
    assert p.step(72 * S) == "NONE"  # the pause lasts a minute
    p.on_status(73 * S, True)
    assert p.step(73 * S) == "OPEN"
    p.on_verdict(74 * S, "GNSS", "TRUSTED", set())
    assert (p.step(74 * S), p.phase) == ("HOLD", "PASSTHROUGH")
    assert p.step(78 * S) == "NONE" and (p.step(79 * S), p.result) == ("CLOSE", "LOST")
    q = Probe()
    for t in range(11):
        q.on_status(t * S, True)
    assert q.step(10 * S) == "OPEN" and q.step(21 * S) == "NONE" and (q.step(22 * S), q.result, q.pause_s) == ("CLOSE", "FAILED", 120.0)


def test_along_track_shift_of_a_bend(spark):
    back = np.arange(0, 300, 5.0)
    bend = lambda x: np.where(x < 110, 0.0, np.where(x < 150, (x - 110) / 40, 1.0))
    got = matching.shift_of((back, bend(back - 12) + 0.3), (back, bend(back)))
    assert got is not None and abs(got[0] - 12) <= 2 and got[2] < 2 and abs(got[3] - math.degrees(1.0)) < 1
    assert matching.shift_of((back, back * 0), (back, back * 0)) is None  # straight roads tell nothing
    assert matching.shift_of((back, np.sin(back / 4)), (back, bend(back))) is None
    rows = [(i, float(b), float(v)) for i, shape in ((1, bend(back - 12)), (2, back * 0)) for b, v in zip(back, shape)]
    road = [(i, float(b), float(v)) for i in (1, 2, 3) for b, v in zip(back, bend(back))]
    out = matching.along_track(spark.createDataFrame(rows, "id long, back_m double, bearing double"), spark.createDataFrame(road, "id long, back_m double, bearing double")).collect()
    assert [(r.id, abs(r.shift_m - 12) <= 2) for r in out] == [(1, True)]


def test_a_turn_just_inside_half_a_circle_stays(spark):
    a = [math.pi / 2, -math.pi / 2 + 5e-16, math.pi / 2, 0.0, 5 * math.pi]
    rows = fix(spark, *((i * S, "GNSS", 0.0, 0.0, 1.0, 1.0, x, False) for i, x in enumerate(a)))
    got = [r["u"] for r in motion.unwrapped(rows, "bearing_deg", "u").orderBy("seq").collect()]
    assert got == pytest.approx([math.pi / 2, -math.pi / 2, math.pi / 2, 0.0, math.pi])


def test_roads_moved_over_a_pole_keep_their_longitude(spark):
    way = "way_id long, node_ids array<long>, lats array<double>, lons array<double>, road_class string, oneway boolean, lanes int, layer int, name string"
    ways = spark.createDataFrame([(1, [1, 2], [89.99, 89.999], [30.0, 30.0], "road", False, 0, 0, "")], way)
    r = roads.to_ways(roads.segments(ways), 0.0, 700.0).first()
    assert r["lons"] == pytest.approx([30.0, 30.0]) and r["lats"] == pytest.approx([89.9963, 89.9947], abs=1e-4)


def test_values_next_to_a_tie_round_as_in_the_second_engine(spark):
    import duckdb

    for x, d in ((30.546537049999998, 7), (1.005, 2), (-2.675, 2), (0.1 + 0.2, 6), (1e300, 6), (-0.0, 3)):
        assert one(spark, registry._r(F.lit(x), d))[0] == duckdb.execute(f"SELECT round({x!r}::DOUBLE, {d})").fetchone()[0]
    assert one(spark, registry._r(F.lit(None).cast("double")))[0] is None and math.isnan(one(spark, registry._r(F.lit(float("nan"))))[0])


def test_segments_and_edges_are_made_inside_the_rows_of_their_ways(spark):
    way = "way_id long, node_ids array<long>, lats array<double>, lons array<double>, road_class string, oneway boolean, lanes int, layer int, name string"
    rows = [(1, [1, 2, 3, 2, 4], [50.0, 50.001, 50.002, 50.001, 50.003], [30.0] * 5, "road", False, 0, 0, ""), (2, [7], [50.0], [30.0], "road", False, 0, 0, ""), (3, [3, 5], [50.002, 50.1], [30.0, 30.1], "road", True, 0, 0, "")]
    seg = roads.segments(spark.createDataFrame(rows, way))
    got = {(r.way_id, r.piece): (r.start_node, r.end_node, len(r.points)) for r in seg.collect()}
    assert got == {(1, 0): (1, 2, 2), (1, 1): (2, 3, 2), (1, 2): (3, 2, 2), (1, 3): (2, 4, 2), (3, 0): (3, 5, 2)}
    e = roads.edges_of_segments(seg, 50.0, 30.0)
    assert e.count() == 5 and e.filter("along_m = 0 AND k = 0").count() == 5
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # nothing of the edges is sorted


def test_edges_far_from_all_points_go_before_the_join(spark):
    points = spark.createDataFrame([(1, 50.0, 30.0), (2, 50.001, 30.001)], "id long, lat double, lon double")
    edge = "way_id long, piece long, k int, x0 double, y0 double, x1 double, y1 double, along_m double, len_m double, bearing_deg double"
    edges = spark.createDataFrame([(1, 0, 0, -10.0, 5.0, 10.0, 5.0, 0.0, 20.0, 90.0), (2, 0, 0, 0.0, 9000.0, 10.0, 9000.0, 0.0, 10.0, 90.0)], edge)
    assert [r.way_id for r in roads.within_box(edges, points.selectExpr("0D AS x", "1D AS y"), F.col("x"), F.col("y"), 20.0).collect()] == [1]
    assert [(r.id, r.way_id) for r in roads.project(points, edges, 20.0, 50.0, 30.0, ["id"]).collect()] == [(1, 1)]
    assert roads.project(points.filter("false"), edges, 20.0, 50.0, 30.0, ["id"]).count() == 0


def test_steps_by_one_join_are_those_of_the_links(spark):
    way = "way_id long, node_ids array<long>, lats array<double>, lons array<double>, road_class string, oneway boolean, lanes int, layer int, name string"
    rows = [(i, n, [50.0 + x / 1e3 for x in n], [30.0] * len(n), "road", one, 0, 0, "") for i, n, one in ((1, [1, 2, 3], False), (2, [2, 4], True), (3, [4, 2], False), (4, [3, 5, 3], False), (5, [3, 6], True))]
    seg = roads.segments(spark.createDataFrame(rows, way))
    by_links, by_join = (sorted(map(tuple, s.collect())) for s in (roads.directed(seg, roads.successors(seg)), roads.directed_steps(seg)))
    assert len(by_links) > 10 and by_join == by_links


def test_networks_hold_the_near_segments_only_and_far_edges_go_first(spark):
    way = "way_id long, node_ids array<long>, lats array<double>, lons array<double>, road_class string, oneway boolean, lanes int, layer int, name string"
    seg = roads.segments(spark.createDataFrame([(i, [2 * i, 2 * i + 1], [lat, lat], [30.0, 30.001], "road", False, 0, 0, "") for i, lat in ((1, 50.0), (2, 50.0005), (3, 50.2), (4, 50.00533))], way))
    points = spark.createDataFrame([("a", 50.0, 30.0)], "net_id string, lat double, lon double")
    near = roads.networks_near(points, seg, roads.edges_of_segments(seg, 50.0, 30.0), 100.0, 50.0, 30.0, "net_id")
    assert {1, 2} <= {r.way_id for r in near.collect()} <= {1, 2, 4}
    assert "_minx" in near._jdf.queryExecution().optimizedPlan().toString()


def test_ways_near_the_points_are_cut_as_the_whole_network_cuts_them(spark):
    way = "way_id long, node_ids array<long>, lats array<double>, lons array<double>, road_class string, oneway boolean, lanes int, layer int, name string"
    rows = [(1, [1, 2, 3], [50.0, 50.001, 50.1], [30.0] * 3, "road", False, 0, 0, ""), (2, [4, 5, 6], [50.1, 50.09, 50.2], [30.0] * 3, "road", False, 0, 0, ""), (3, [2, 7, 8], [50.001] * 3, [30.0, 30.001, 30.002], "road", True, 0, 0, "")]
    # Way 4, far from all points, shares a node of way 3 by another place.
    ways = spark.createDataFrame([*rows, (4, [9, 7], [60.0, 60.1], [30.0] * 2, "road", False, 0, 0, "")], way)
    points = spark.createDataFrame([(50.0, 30.0), (50.0005, 30.0003)], "lat double, lon double")
    near = roads.ways_near(ways, points, 60.0, 50.0, 30.0)
    assert {r.way_id for r in near.collect()} == {1, 3}
    whole = roads.segments(ways).filter("way_id IN (1, 3)")
    assert sorted(roads.segments(near, ways).collect()) == sorted(whole.collect()) and whole.count() == 4


def test_pieces_are_cut_inside_the_rows_of_ways(spark):
    """No window or second aggregation holds the places of all ways of a task."""
    ways = [(1, [1, 2, 3]), (2, [2, 4, 2, 5]), (3, [None, 3, 6]), (4, [7]), (5, []), (6, None), (7, [8, 3, None]), (8, [3, 3])]
    out = tables.split_ways(spark.createDataFrame(ways, "way_id long, nodes array<long>"))
    got = sorted(tuple(r) for r in out.select("way_id", "piece", "start_node", "end_node", "n_nodes").collect())
    assert got == [(1, 0, 1, 2, 2), (1, 1, 2, 3, 2), (2, 0, 2, 2, 3), (2, 1, 2, 5, 2), (3, 0, 3, 3, 1), (3, 1, 3, 6, 2), (4, 0, 7, 7, 1), (7, 0, 8, 3, 2), (7, 1, 3, 3, 1), (8, 0, 3, 3, 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("min_by") == 0


def test_summary_reads_stored_errors(spark):
    """What a summary reads several times is made once: no distance is left to be computed in its plan."""
    from drivelake.plans.replay_catalog import replay_summaries

    plan = replay_summaries(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ASIN" not in plan.upper() and "has_truth" in plan
