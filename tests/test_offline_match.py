"""The likeliest chain of places against all chains, one-way rules, limits, and places between."""

import itertools
import math
import random

import numpy as np
import pytest

from drivelake.streaming import offline_match as om
from drivelake.streaming.offline_match import Limits, OfflineRules, Row, best_chain, places_on_route
from drivelake.streaming.road_matcher import Network
from test_roads_matched import at, road, town

S = 10**9


def rows(points, sigma=10.0, seed=1, every=50.0, speed=10.0):
    rng, out, odo, t = random.Random(seed), [], 0.0, 0
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        n = max(1, round(math.hypot(x1 - x0, y1 - y0) / every))
        step = math.hypot(x1 - x0, y1 - y0) / n
        for i in range(n):
            x, y = x0 + (x1 - x0) * i / n + rng.gauss(0, sigma), y0 + (y1 - y0) * i / n + rng.gauss(0, sigma)
            out.append(Row(t, len(out), odo, *at(x, y)))
            odo, t = odo + step, t + round(step / speed * S)
    return out


def every_node_way(network, lawful):
    """Shortest ways between all nodes, by relaxation."""
    nodes = sorted({n for r in network.roads.values() for n in (r.start, r.end)})
    d = {(a, b): 0.0 if a == b else math.inf for a in nodes for b in nodes}
    for r in network.roads.values():
        d[r.start, r.end] = min(d[r.start, r.end], r.length)
        if not (lawful and r.oneway):
            d[r.end, r.start] = min(d[r.end, r.start], r.length)
    for k, a, b in itertools.product(nodes, repeat=3):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return d


def plain_best(seen, network, rules):
    """The best score over all chains of candidates."""
    cands = [network.project(x.lat, x.lon, rules.radius_m)[: rules.candidates] for x in seen]
    node = {lawful: every_node_way(network, lawful) for lawful in (True, False)}

    def way(a, b, lawful):
        both = lambda r: not lawful or not r.oneway
        ways = [abs(b.along - a.along)] if a.road.key == b.road.key and (b.along >= a.along or both(a.road)) else []
        exits = [(a.road.end, a.road.length - a.along)] + [(a.road.start, a.along)] * both(a.road)
        entries = [(b.road.start, b.along)] + [(b.road.end, b.road.length - b.along)] * both(b.road)
        return min([*ways, *(l + node[lawful][x, y] + m for x, l in exits for y, m in entries)], default=math.inf)  # noqa: E741

    best = -math.inf
    for chain in itertools.product(*cands):
        s = -0.5 * (chain[0].distance / rules.sigma_m) ** 2
        for k in range(1, len(chain)):
            driven = seen[k].odo_m - seen[k - 1].odo_m
            s += max(-abs(way(chain[k - 1], chain[k], lawful) - driven) / rules.beta_m - (0 if lawful else rules.wrong_way) for lawful in (True, False)) - 0.5 * (chain[k].distance / rules.sigma_m) ** 2
        best = max(best, s)
    return best


def score_of(matches, rules):
    s = 0.0
    for k, m in enumerate(matches):
        s -= 0.5 * (m.near.distance / rules.sigma_m) ** 2
        if k:
            s -= abs(m.link.way - (m.row.odo_m - matches[k - 1].row.odo_m)) / rules.beta_m + (0 if m.link.lawful else rules.wrong_way)
    return s


@pytest.mark.parametrize("seed", range(6))
def test_chain_is_the_best_of_all(seed):
    rng = random.Random(seed)
    places = [(rng.uniform(0, 400), rng.uniform(0, 400)) for _ in range(8)]
    roads = []
    for k in range(14):
        a, b = rng.sample(range(8), 2)
        roads.append(road(k, a, b, places[a], places[b], oneway=rng.random() < 0.4))
    net, rules = Network(roads), OfflineRules(candidates=4, most_more_m=1e6)
    points = [Row(i * 6 * S, i, i * 70.0, *at(rng.uniform(50, 350), rng.uniform(50, 350))) for i in range(5)]
    seen = [x for x in points if net.project(x.lat, x.lon, rules.radius_m)]
    got = best_chain(points, net, rules)
    assert [m.row for m in got] == seen and score_of(got, rules) == pytest.approx(plain_best(seen, net, rules))


def test_a_drive_through_the_town_and_places_between():
    net, rules = town(), OfflineRules(sigma_m=15.0)
    drive = rows([(20, 0), (300, 0), (300, 60), (560, 60)], sigma=12)
    got = best_chain(drive, net, rules)
    names = [net.roads[m.near.road.key].name for m in got]
    assert names[:3] == ["Main"] * 3 and "Main" not in names[4:] and got[-1].near.road.name == "North" and all(m.link for m in got[1:])
    asked = sorted([*drive, *(Row(x.t_ns + 2 * S, 1000 + x.seq, x.odo_m + 20.0, None, None) for x in drive[:-1])])
    out = places_on_route(asked, got, net)
    assert len(out) == len(asked) and all(x[-1] for x in out)
    for t, _, lat, lon, bearing, _ in out:
        odo = t / S * 10
        x, y = (20 + odo, 0) if odo < 280 else (300, odo - 280) if odo < 340 else (odo - 40, 60)
        assert math.hypot((lat - at(x, y)[0]) * 111_195, (lon - at(x, y)[1]) * 111_195 * math.cos(math.radians(lat))) < 45
    # At corners noise may lead a little back.
    assert sum(min(abs(x[4] - b) for b in (0, 90, 360)) < 3 for x in out) >= 0.85 * len(out)


def test_one_way_rules_limits_and_breaks():
    net = Network([road(1, 1, 2, (0, 0), (600, 0), oneway=True), road(2, 3, 4, (0, 90), (600, 90), name="Back street", road_class="service")])
    against = rows([(580, 10), (20, 10)], sigma=3)
    got = best_chain(against, net, OfflineRules(candidates=1))
    assert all(not m.link.lawful for m in got[1:])
    assert {m.near.road.key[0] for m in best_chain(against, net)} == {2}  # a lawful road a little farther away
    held = OfflineRules(limits=(Limits(0, 1e9, without_names=("Back",)),))
    assert {m.near.road.key[0] for m in best_chain(against, net, held)} == {1}
    assert {m.near.road.key[0] for m in best_chain(against, net, OfflineRules(limits=(Limits(0, 1e9, classes=("service",)),)))} == {2}
    far = [Row(0, 0, 0.0, *at(100, 0)), Row(10 * S, 1, 100.0, *at(200, 0)), Row(20 * S, 2, 200.0, *at(100, 5000)), Row(30 * S, 3, 300.0, *at(200, 5000))]
    apart = Network([road(1, 1, 2, (0, 0), (600, 0)), road(2, 3, 4, (0, 5000), (600, 5000))])
    got = best_chain(far, apart)
    assert [m.link is None for m in got] == [True, False, True, False]
    assert [x[-1] for x in places_on_route(far, got, apart)] == [True, False, False, True]
    assert best_chain([], net) == [] and best_chain(far, Network([])) == [] and places_on_route(far, got[:1], apart) == []


def test_fold_equals_the_chain(spark):
    net = town()
    roads = [(d, *r.key, r.start, r.end, r.oneway, r.road_class, r.lanes, r.name, [(float(a), float(b)) for a, b in zip(r.lats, r.lons)]) for d in (1, 2) for r in net.roads.values()]
    networks = spark.createDataFrame(roads, "drive_id long, way_id long, piece long, start_node long, end_node long, oneway boolean, road_class string, lanes int, name string, points array<struct<lat: double, lon: double>>")
    drives = {1: rows([(20, 0), (300, 0), (300, 60)]), 2: rows([(850, 60), (100, 60)]), 3: rows([(0, 0), (90, 0)])}
    df = spark.createDataFrame([(d, *x) for d, xs in drives.items() for x in xs], "drive_id long, t_ns long, seq long, odo_m double, lat double, lon double")
    got = {}
    for r in sorted(om.match_whole_drives(df, networks).collect()):
        got.setdefault(r.drive_id, []).append(r)
    assert set(got) == {1, 2}
    for d in (1, 2):
        chain = best_chain(drives[d], town())
        assert [(r.way_id, r.piece) for r in got[d] if r.matched] == [m.near.road.key for m in chain]
        assert np.allclose([(r.lat, r.lon, r.bearing_deg) for r in got[d]], [x[2:5] for x in places_on_route(drives[d], chain, town())])
    assert om.match_whole_drives(df.limit(0), networks).count() == 0


def test_drives_on_one_network_share_their_searches(monkeypatch):
    network, drive = town(), rows([(0, 0), (300, 0), (300, 200)])
    first = best_chain(drive, network)
    assert [(m.near.road.key, m.near.along, m.link) for m in first] == [(m.near.road.key, m.near.along, m.link) for m in best_chain(drive, town())]
    monkeypatch.setattr(om.heapq, "heappush", lambda *_: pytest.fail("searched again"))
    assert best_chain(drive, network) == first


def test_searches_that_do_not_fit_are_made_again(monkeypatch):
    drive = rows([(0, 0), (300, 0), (300, 200)])
    first = places_on_route(drive, best_chain(drive, network := town()), network)
    monkeypatch.setattr(om, "KEPT", 10)
    small = town()
    assert places_on_route(drive, best_chain(drive, small), small) == first and small.searched <= max(10, *map(len, small.searches.values()))


def _streets(rng, n=7, inconsistent=False):
    """Streets of 90 m between the places of a grid, some one-way; a node may lie a little off in some of them."""
    roads, off = [], 20 if inconsistent else 0
    for k, (i, j, i1, j1) in enumerate((i, j, i + a, j + b) for i in range(n) for j in range(n) for a, b in ((1, 0), (0, 1))):
        shift = rng.choice([0, 0, off])
        roads.append(road(k, 100 * i + j, 100 * i1 + j1, (90 * i + shift, 90 * j), (90 * i1, 90 * j1), oneway=rng.random() < 0.3))
    return roads


def test_chains_are_the_same_by_tables_and_by_searches_and_where_nothing_can_lead_on_at_once(monkeypatch):
    rng = random.Random(6)
    for inconsistent in (False, True):
        roads = _streets(rng, inconsistent=inconsistent)
        points = [(rng.uniform(0, 630), rng.uniform(0, 630)) for _ in range(25)]
        drive = [Row(i * 6_000_000_000, i, 40.0 * i, *at(*p)) for i, p in enumerate(points)]
        limits = (Limits(30, 80, without_classes=("service",)), Limits(60, 100, without_names=("Back",)))
        for rules in (OfflineRules(), OfflineRules(radius_m=60.0, candidates=5, most_more_m=30.0), OfflineRules(radius_m=80.0, limits=limits)):
            first = best_chain(drive, network := Network(roads), rules)
            assert network.one_place != inconsistent and any(m.link for m in first)
            with monkeypatch.context() as m:
                m.setattr(om, "TABLE", 0)
                m.setattr(om, "LINKS", 1)
                m.setattr(om, "_apart", lambda seen, *_: [False] * len(seen))
                assert best_chain(drive, again := Network(roads), rules) == first and not again.tables
                assert places_on_route(drive, first, again, rules) == places_on_route(drive, first, network, rules)


def test_searches_do_not_grow_with_the_different_ways_between_positions():
    network = Network(_streets(random.Random(2)))
    for step in range(10, 90, 5):
        best_chain([Row(i * 6_000_000_000, i, float(step * i), *at(step * i / 2, step * i / 3)) for i in range(12)], network)
    assert len(network.searches) <= 2 * len({n for r in network.order for n in (r.start, r.end)})


def test_the_query_matches_by_the_fixed_rules(spark, monkeypatch):
    from drivelake.plans import road_catalog

    asked, place = [], "drive_id long, seq long, lat double, lon double, bearing_deg double, reliable boolean, matched boolean, way_id long, piece long, along_m double, begins boolean"
    monkeypatch.setattr(road_catalog, "_networks", lambda spark, sf_dir, reach: (asked.append(reach), (spark.createDataFrame([], "drive_id long, net_id string, t_ns long, seq long, lat double, lon double"), None))[1])
    monkeypatch.setattr(om, "match_whole_drives", lambda rows, networks, rules=OfflineRules(): (asked.append(rules), spark.createDataFrame([], place))[1])
    assert road_catalog.offline_matches(spark, "none").count() == 0
    reach, rules = asked
    assert rules == OfflineRules() and reach >= rules.radius_m + rules.most_more_m / 2
