"""Online matching on made networks, road axes, ways against a plain search, and the fold against steps."""

import heapq
import math
import random

import numpy as np
import pytest

from drivelake.streaming import road_matcher as rm
from drivelake.streaming.road_matcher import MatchRules, Matcher, Network, Step, axis_consensus, road_of

LAT, LON = 50.4, 30.5


def at(east, north):
    return LAT + north / 111_230, LON + east / (111_320 * math.cos(math.radians(LAT)))


def road(key, a, b, *points, oneway=False, road_class="primary", lanes=2, name=""):
    lats, lons = zip(*(at(*p) for p in points))
    return road_of((key, 0), a, b, oneway, road_class, lanes, name, list(lats), list(lons))


def town():
    """A street eastwards of three pieces with a parallel one 60 m north, joined by cross streets."""
    return Network([
        road(1, 10, 11, (0, 0), (300, 0), name="Main"), road(2, 11, 12, (300, 0), (600, 0), name="Main"), road(3, 12, 13, (600, 0), (900, 0), name="Main"),
        road(4, 20, 21, (0, 60), (300, 60), name="North"), road(5, 21, 22, (300, 60), (600, 60), name="North"), road(6, 22, 23, (600, 60), (900, 60), name="North"),
        road(7, 11, 21, (300, 0), (300, 60), name="First"), road(8, 12, 22, (600, 0), (600, 60), name="Second", oneway=True),
    ])


def drive(points, sigma=8.0, heading_std=0.1, seed=1, speed=10.0, known=True, every=10.0):
    """Steps each ten metres along straight pieces, with noise."""
    rng, out, last = random.Random(seed), [], None
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        n, heading = max(1, round(math.hypot(x1 - x0, y1 - y0) / every)), math.atan2(x1 - x0, y1 - y0) % (2 * math.pi)
        for i in range(n):
            x, y = x0 + (x1 - x0) * i / n + rng.gauss(0, sigma / 2), y0 + (y1 - y0) * i / n + rng.gauss(0, sigma / 2)
            turn = 0.0 if last is None else math.pi - (math.pi - (heading - last)) % (2 * math.pi)
            out.append(Step(*at(x, y), sigma**2, 0.0, sigma**2, heading if known else None, heading_std if known else None, every, turn, speed))
            last = heading
    return out


def run(network, steps, rules=MatchRules()):
    m = Matcher(network, rules)
    for s in steps:
        m.step(s)
        assert abs(sum(math.exp(h.log_p) for h in m.found) + m.off_road() - 1) < 1e-6 or len(m.found) == rules.hypotheses
        assert len(m.found) <= rules.hypotheses
    return m


def test_street_and_direction_are_found():
    m = run(town(), drive([(20, 0), (850, 0)]))
    h = m.best()
    assert h.key == (3, 0) and h.forward and m.probability(h) > 0.9 and m.off_road() < 0.1 and h.confident > 150 and abs(h.along - 240) < 25
    back = run(town(), drive([(850, 0), (20, 0)])).best()
    assert back.key == (1, 0) and not back.forward


def test_a_turn_tells_parallel_streets_apart():
    m = run(town(), drive([(20, 2), (300, 2), (300, 60), (560, 60)], sigma=25))
    assert m.network.roads[m.best().key].name == "North"
    m = run(town(), drive([(20, 2), (300, 2), (300, 60), (460, 60)], sigma=8))
    back, bearing = m.profile(m.best())
    assert (np.diff(back) > 0).all() and back[0] == 0 and math.degrees(bearing[0]) % 360 == pytest.approx(90, abs=1) and math.degrees(bearing.max() - bearing.min()) == pytest.approx(90, abs=2)


def test_off_road_wins_away_from_roads():
    m = run(town(), drive([(0, 0), (100, 0), (100, -400), (500, -420)], sigma=8))
    assert m.off_road() > 0.9 and m.best() is None
    m = run(Network([]), drive([(0, 0), (100, 0)]))
    assert m.best() is None and m.off_road() == pytest.approx(1)


def test_one_way_street_is_not_driven_backward():
    m = run(town(), drive([(600, 60), (600, 5)]))
    assert not [h for h in m.found if h.key == (8, 0) and not h.forward]
    assert m.network.reachable((5, 0), 250.0, True, 500).get(((8, 0), False)) is None


def test_ways_equal_a_plain_search():
    rng = random.Random(4)
    for _ in range(20):
        places = [(rng.uniform(0, 500), rng.uniform(0, 500)) for _ in range(12)]
        roads = []
        for k in range(25):
            a, b = rng.sample(range(12), 2)
            roads.append(road(k, a, b, places[a], places[b], oneway=rng.random() < 0.4))
        net = Network(roads)
        r = roads[0]
        # All walks over directed roads, shortest first, by nodes; a road isn't turned round on.
        want, queue = {}, [(r.length / 3, k, f) for k, f in net.at[r.end] if k != r.key]
        heapq.heapify(queue)
        while queue:
            d, k, f = heapq.heappop(queue)
            if d > 400 or (k, f) in want:
                continue
            want[k, f] = d
            node = net.roads[k].end if f else net.roads[k].start
            for q in net.roads.values():
                for forward, entry in ((True, q.start), *(() if q.oneway else ((False, q.end),))):
                    if entry == node and q.key != k:
                        heapq.heappush(queue, (d + net.roads[k].length, q.key, forward))
        got = net.reachable(r.key, r.length * 2 / 3, True, 400)
        assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_projection_equals_all_edges():
    rng = random.Random(2)
    net = Network([road(k, 2 * k, 2 * k + 1, *[(rng.uniform(-600, 600), rng.uniform(-600, 600)) for _ in range(rng.randrange(2, 6))]) for k in range(30)])
    for _ in range(50):
        x, y = rng.uniform(-500, 500), rng.uniform(-500, 500)
        got = {n.road.key: n for n in net.project(*at(x, y), 120)}
        plane = rm._Plane(*at(x, y))
        for r in net.roads.values():
            p = np.array([plane.at(a, b) for a, b in zip(r.lats, r.lons)])
            best = min(np.linalg.norm(p[i] + t * (p[i + 1] - p[i])) for i in range(len(p) - 1) for t in [min(1, max(0, float(-p[i] @ (p[i + 1] - p[i]) / max(1e-12, (p[i + 1] - p[i]) @ (p[i + 1] - p[i])))))])
            assert (r.key in got) == (best <= 120) and (best > 120 or abs(got[r.key].distance - best) < 1e-6)


def test_roads_agree_on_an_axis_or_not():
    pose = lambda x, y, heading, std=0.3: Step(*at(x, y), 100.0, 0.0, 100.0, math.radians(heading), std, 10.0, 0.0, 10.0)
    assert math.degrees(axis_consensus(town(), pose(150, 5, 70))) == pytest.approx(90, abs=0.5)
    assert math.degrees(axis_consensus(town(), pose(150, 5, 250))) == pytest.approx(270, abs=0.5)
    assert axis_consensus(town(), pose(300, 20, 45, 0.6)) is None  # two axes
    assert axis_consensus(town(), pose(150, -400, 90)) is None and axis_consensus(town(), pose(150, 5, 90)._replace(ee=4e4)) is None
    bent = Network([road(1, 1, 2, (0, 0), (100, 0), (120, 12), (200, 70))])
    assert axis_consensus(bent, pose(105, 2, 90)) is None and axis_consensus(bent, pose(105, 2, 90)._replace(heading=None)) is None


def test_fold_equals_steps(spark):
    net = town()
    roads = [(d, *r.key, r.start, r.end, r.oneway, r.road_class, r.lanes, r.name, [(float(a), float(b)) for a, b in zip(r.lats, r.lons)]) for d in (1, 2) for r in net.roads.values()]
    networks = spark.createDataFrame(roads, "drive_id long, way_id long, piece long, start_node long, end_node long, oneway boolean, road_class string, lanes int, name string, points array<struct<lat: double, lon: double>>")
    drives = {1: drive([(20, 0), (300, 0), (300, 60)]), 2: drive([(850, 60), (600, 60)], known=False), 3: drive([(0, 0), (50, 0)])}
    steps = spark.createDataFrame([(d, i * 10**9, i, *s) for d, ss in drives.items() for i, s in enumerate(ss)], f"drive_id long, t_ns long, seq long, {rm.STEP}")
    got = {}
    for r in sorted(rm.match_drives(steps, networks).collect()):
        got.setdefault(r.drive_id, []).append(r)
    for d, ss in drives.items():
        m = Matcher(town() if d < 3 else Network([]))
        for s, r in zip(ss, got[d]):
            m.step(s)
            h = m.best()
            assert (r.way_id, r.along_m) == ((h.key[0], h.along) if h else (None, None)) and r.off_road == pytest.approx(m.off_road()) and r.hypotheses == len(m.found)
    assert rm.match_drives(steps.limit(0), networks).count() == 0


def test_reachable_by_joins_equals_the_local_search(spark):
    from drivelake.operators import roads
    from drivelake.sources.scratch import scratch_folder, stored

    net = town()
    segs = spark.createDataFrame([(*r.key, r.start, r.end, r.oneway, r.length) for r in net.roads.values()], "way_id long, piece long, start_node long, end_node long, oneway boolean, length_m double")
    steps = roads.directed(segs, roads.successors(segs))
    starts = spark.createDataFrame([(i, *k, f, 100.0) for i, (k, f) in enumerate(((k, f) for k in net.roads for f in (True, False) if f or not net.roads[k].oneway))], "id long, way_id long, piece long, forward boolean, left_m double")
    work = scratch_folder(spark)
    out = roads.reachable(starts, steps, 700.0, lambda df, name: stored(df, work, name))
    got = {}
    for r in out.collect():
        got.setdefault(r.id, {})[(r.way_id, r.piece), r.forward] = r.way_m
    for r in starts.collect():
        n = net.roads[r.way_id, r.piece]
        want = net.reachable(n.key, n.length - 100 if r.forward else 100.0, r.forward, 700.0)
        assert set(want) == set(got.get(r.id, {})) and all(abs(want[k] - got[r.id][k]) < 1e-6 for k in want)


def test_points_projected_at_once_are_those_projected_one_by_one(monkeypatch):
    rng = random.Random(4)
    for pairs in (rm._PAIRS, 50):
        monkeypatch.setattr(rm, "_PAIRS", pairs)
        net = Network([road(k, 2 * k, 2 * k + 1, *[(rng.uniform(-900, 900), rng.uniform(-900, 900)) for _ in range(rng.randrange(2, 7))]) for k in range(60)])
        points = [(*at(rng.uniform(-1200, 1200), rng.uniform(-1200, 1200)), rng.choice([5.0, 30.0, 150.0, 400.0])) for _ in range(150)]
        points += [(net.order[k].lats[1], net.order[k].lons[1], 30.0) for k in range(60)]  # as near to two edges of a road
        assert net.near_many(*map(list, zip(*points))) == [net.project(*x) for x in points]
    assert Network([]).near_many([LAT], [LON], [50.0]) == [[]] and net.near_many([], [], []) == []


def test_parts_of_an_area_share_their_network():
    roads, net = [*town().roads.values()], rm.network_of([*town().roads.values()])
    first = rm.network_of(roads)
    assert first is not net and rm.network_of(roads[::-1]) is first and rm.network_of(roads[1:]) is not first


def test_networks_stay_dealt_to_all_partitions(spark):
    segs = spark.range(40).selectExpr("id AS net_id", "id AS way_id", "0L AS piece", "1L AS start_node", "2L AS end_node", "false AS oneway", "'' AS road_class", "0 AS lanes", "'' AS name", "array(struct(50.0D AS lat, 30.0D AS lon)) AS points")
    rows = spark.range(40).selectExpr("id AS drive_id", "id AS net_id", "0L AS t_ns")
    assert rm.with_networks(rows, segs, ["t_ns"], ["t_ns"]).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
