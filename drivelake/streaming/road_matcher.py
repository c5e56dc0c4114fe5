"""Which road a drive is on, step by step: a hidden Markov model over directed road segments with an off-road state.

A drive's own piece of the network (roads.networks_near) comes in front of its steps, so a task holds one piece at a time and steps stream through.
Also the axis that all roads round a pose agree on, and the bearing profile of the road behind a hypothesis.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivelake.streaming.batches import rows_of
from drivelake.streaming.estimators import _half_turn, _Plane

#: Width of a lane, lanes where a road doesn't tell.
LANE_M = 3.5
LANES = {"motorway": 4, "trunk": 4, "primary": 4, "secondary": 2, "tertiary": 2, "unclassified": 2, "residential": 2, "road": 2}
_MINOR = {"residential", "living_street", "unclassified", "road"}
#: Sides of a cell of the local index, in degrees of latitude and longitude; of a cell whose points share a list of edges, and metres that its radius is rounded up to.
_CELL = 0.002, 0.003
_SHARED, _ROUND_M = (0.0005, 0.00075), 25.0
#: Edges of all such lists together that a network keeps; pairs of points and edges that are measured at once.
_EDGES, _PAIRS = 4_000_000, 200_000


@dataclass(frozen=True)
class MatchRules:
    """Fixed values of the matcher."""

    candidates: int = 12
    hypotheses: int = 24
    radius_sigmas: float = 3.0
    least_m: float = 30.0
    most_m: float = 200.0
    geometry_m: float = 4.0
    heading_deg: float = 10.0
    turn_deg: float = 15.0
    turn_share: float = 0.15
    route_m: float = 8.0
    route_share: float = 0.15
    off_sigmas: float = 2.0
    off_penalty: float = 1.0
    leave: float = 0.02
    leave_slow: float = 0.1
    slow_mps: float = 4.2
    enter: float = 0.05
    minor_penalty: float = 0.3
    service_penalty: float = 0.0
    confident: float = 0.9
    trail: int = 40


Key = tuple[int, int]


class Road(NamedTuple):
    key: Key
    start: int
    end: int
    oneway: bool
    road_class: str
    lanes: int
    name: str
    lats: np.ndarray
    lons: np.ndarray
    ends: np.ndarray  # metres along the road at its points
    bearings: np.ndarray  # of its edges, in degrees

    @property
    def length(self) -> float:
        return float(self.ends[-1])

    @property
    def half_width(self) -> float:
        return (self.lanes if self.lanes > 0 else LANES.get(self.road_class, 1)) * LANE_M / 2

    def bearing_at(self, along: float) -> float:
        return float(self.bearings[min(max(int(np.searchsorted(self.ends, along, side="left")) - 1, 0), len(self.bearings) - 1)])

    def place(self, along: float) -> tuple[float, float]:
        d = min(max(along, 0.0), self.length)
        return float(np.interp(d, self.ends, self.lats)), float(np.interp(d, self.ends, self.lons))

    def most_turned(self, low: float, high: float, reference: float) -> float:
        """The largest deviation in bearing of the edges that a span meets."""
        met = (self.ends[1:] > low) & (self.ends[:-1] < high) & (np.diff(self.ends) > 0)
        return float(np.abs((self.bearings[met] - reference + 180) % 360 - 180).max(initial=0.0))


def road_of(key: Key, start: int, end: int, oneway: bool, road_class: str, lanes: int, name: str, lats: list[float], lons: list[float]) -> Road:
    la, lo = np.array(lats, float), np.array(lons, float)
    plane = _Plane(float(la.mean()), float(lo.mean()))
    x, y = (lo - lo[0]) * plane.per_lon, (la - la[0]) * plane.per_lat
    dx, dy = np.diff(x), np.diff(y)
    return Road(key, start, end, oneway, road_class or "", lanes or 0, name or "", la, lo, np.concatenate([[0.0], np.cumsum(np.hypot(dx, dy))]), np.degrees(np.arctan2(dx, dy)) % 360)


class Near(NamedTuple):
    """The nearest place of a road to a point; cross is positive to the right of the road's own direction."""

    road: Road
    distance: float
    along: float
    cross: float
    bearing: float
    east: float
    north: float


class Hits(NamedTuple):
    """The nearest place of each road near some points, as columns: by point, distance and key. road: its place in Network.order."""

    point: np.ndarray
    road: np.ndarray
    distance: np.ndarray
    along: np.ndarray
    cross: np.ndarray
    bearing: np.ndarray
    east: np.ndarray
    north: np.ndarray


class Network:
    """Some roads, with a grid over their edges. Ways that were asked for are kept."""

    def __init__(self, roads: list[Road]):
        self.roads = {r.key: r for r in roads}
        self.at: dict[int, list[tuple[Key, bool]]] = defaultdict(list)  # node -> what can be driven from it
        every = sorted(self.roads.values(), key=lambda r: r.key)
        for r in every:
            self.at[r.start].append((r.key, True))
            if not r.oneway:
                self.at[r.end].append((r.key, False))
        sizes = [len(r.bearings) for r in every]
        join = lambda xs: np.concatenate([np.empty(0), *xs])
        self.order = every
        self.road = np.repeat(np.arange(len(every)), sizes)
        self.edge = np.concatenate([np.empty(0, int), *(np.arange(n) for n in sizes)])
        self.ends = np.column_stack([join([x[i : len(x) - 1 + i] for x in xs]) for i in (0, 1) for xs in ([r.lons for r in every], [r.lats for r in every])])
        # Each edge lies in the cells of its box; edges are short.
        low = np.floor(np.minimum(self.ends[:, 1::-1], self.ends[:, 3:1:-1]) / _CELL).astype(int)
        high = np.floor(np.maximum(self.ends[:, 1::-1], self.ends[:, 3:1:-1]) / _CELL).astype(int)
        cells: dict[tuple[int, int], list[int]] = defaultdict(list)
        for e, ((i0, j0), (i1, j1)) in enumerate(zip(low.tolist(), high.tolist())):
            for i in range(i0, i1 + 1):
                for j in range(j0, j1 + 1):
                    cells[i, j].append(e)
        self.grid = {c: np.array(x) for c, x in cells.items()}
        self.low, self.high = np.minimum(self.ends[:, :2], self.ends[:, 2:]), np.maximum(self.ends[:, :2], self.ends[:, 2:])
        self.from_m, self.to_m, self.bearing = join([r.ends[:-1] for r in every]), join([r.ends[1:] for r in every]), join([r.bearings for r in every])
        self.lists: dict[tuple[int, int, int], np.ndarray] = {}
        self.listed = 0
        self.widest = max((r.half_width for r in every), default=0.0)
        self.ways: dict[tuple[Key, bool], tuple[float, dict[tuple[Key, bool], float]]] = {}
        # Made and used by offline_match: places of the roads' nodes and of the roads, their traits, whether each node has one place, ways onward, searches and tables of ways.
        self.ends_at: np.ndarray | None = None
        self.road_place: dict[Key, int] = {}
        self.lengths = self.one_way = np.empty(0)
        self.one_place = False
        self.onwards: dict[tuple, list] = {}
        self.tables: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self.searches: dict[tuple, tuple] = {}
        self.searched = 0

    def project(self, lat: float, lon: float, radius: float) -> list[Near]:
        """The nearest place of each road within a radius, nearest first, then by key."""
        plane = _Plane(lat, lon)
        dy, dx = radius / plane.per_lat, radius / plane.per_lon
        span = lambda c, d, side: range(math.floor((c - d) / side), math.floor((c + d) / side) + 1)
        here = [self.grid[c] for i in span(lat, dy, _CELL[0]) for j in span(lon, dx, _CELL[1]) if (c := (i, j)) in self.grid]
        if not here:
            return []
        edges = here[0] if len(here) == 1 else np.unique(np.concatenate(here))
        x0, y0, x1, y1 = ((self.ends[edges] - [lon, lat, lon, lat]) * [plane.per_lon, plane.per_lat, plane.per_lon, plane.per_lat]).T
        ux, uy = x1 - x0, y1 - y0
        length = np.hypot(ux, uy)
        t = np.where(length > 0, np.clip(-(x0 * ux + y0 * uy) / np.maximum(length * length, 1e-12), 0, 1), 0.0)
        px, py = x0 + t * ux, y0 + t * uy
        d = np.hypot(px, py)
        found: dict[int, tuple] = {}
        for i in np.flatnonzero(d <= radius).tolist():
            r, k = int(self.road[edges[i]]), int(self.edge[edges[i]])
            if r not in found or d[i] < found[r][0] - 1e-9:
                road = self.order[r]
                side = (ux[i] * py[i] - uy[i] * px[i]) / length[i] if length[i] > 0 else 0.0
                found[r] = (float(d[i]), float(road.ends[k] + t[i] * (road.ends[k + 1] - road.ends[k])), float(side), float(road.bearings[k]), float(px[i]), float(py[i]))
        return sorted((Near(self.order[r], *v) for r, v in found.items()), key=lambda n: (n.distance, n.road.key))

    def _edges_near(self, lat: float, lon: float, radius: float) -> np.ndarray:
        """Edges in rising order, among them all within a radius of a point; found once for a small cell."""
        (a, b), k = _SHARED, math.ceil(radius / _ROUND_M)
        at = math.floor(lat / a), math.floor(lon / b), k
        if (out := self.lists.get(at)) is None:
            south, west = at[0] * a, at[1] * b
            plane = _Plane(min(max(abs(south), abs(south + a)), 90.0), west)  # a degree of longitude is shortest there
            dy, dx = 1.02 * k * _ROUND_M / plane.per_lat, 1.02 * k * _ROUND_M / max(plane.per_lon, 1e-6)
            rows, columns = ((math.floor((c - d) / side), math.floor((c + width + d) / side)) for c, d, width, side in ((south, dy, a, _CELL[0]), (west, dx, b, _CELL[1])))
            if (rows[1] - rows[0] + 1) * (columns[1] - columns[0] + 1) > len(self.grid):
                here = [x for (i, j), x in self.grid.items() if rows[0] <= i <= rows[1] and columns[0] <= j <= columns[1]]
            else:
                here = [self.grid[c] for i in range(rows[0], rows[1] + 1) for j in range(columns[0], columns[1] + 1) if (c := (i, j)) in self.grid]
            out = np.unique(np.concatenate([np.empty(0, int), *here]))
            met = (self.low[out] <= [west + b + dx, south + a + dy]) & (self.high[out] >= [west - dx, south - dy])
            out = out[met.all(axis=1)]
            if self.listed > _EDGES:
                self.lists.clear()
                self.listed = 0
            self.lists[at] = out
            self.listed += len(out)
        return out

    def project_many(self, lats: list[float], lons: list[float], radii: list[float]) -> Hits:
        """As project of each point, all at once."""
        found, begin, size, near = [], 0, 0, [self._edges_near(*x) for x in zip(lats, lons, radii)]
        for k, x in enumerate(near):
            size += len(x)
            if size > _PAIRS or k == len(near) - 1:
                found.append(self._project(lats[begin : k + 1], lons[begin : k + 1], radii[begin : k + 1], near[begin : k + 1], begin))
                begin, size = k + 1, 0
        return Hits(*map(np.concatenate, zip(*found))) if found else Hits(*np.empty((2, 0), int), *np.empty((6, 0)))

    def _project(self, lats: list[float], lons: list[float], radii: list[float], near: list[np.ndarray], begin: int) -> Hits:
        planes = [_Plane(*x) for x in zip(lats, lons)]
        point, edges = np.repeat(np.arange(len(lats)), [len(x) for x in near]), np.concatenate(near)
        lat, lon, radius, per_lat, per_lon = (np.array(c)[point] for c in (lats, lons, radii, [p.per_lat for p in planes], [p.per_lon for p in planes]))
        lon0, lat0, lon1, lat1 = self.ends[edges].T
        x0, y0, x1, y1 = (lon0 - lon) * per_lon, (lat0 - lat) * per_lat, (lon1 - lon) * per_lon, (lat1 - lat) * per_lat
        ux, uy = x1 - x0, y1 - y0
        length = np.hypot(ux, uy)
        t = np.where(length > 0, np.clip(-(x0 * ux + y0 * uy) / np.maximum(length * length, 1e-12), 0, 1), 0.0)
        px, py = x0 + t * ux, y0 + t * uy
        d = np.hypot(px, py)
        ok = np.flatnonzero(d <= radius)
        point, edges, d = point[ok], edges[ok], d[ok]
        road = self.road[edges]
        # Of a road the first edge, unless a later one is nearer.
        starts = np.flatnonzero(np.concatenate([[True], (point[1:] != point[:-1]) | (road[1:] != road[:-1])])) if len(ok) else ok
        sizes, best = np.diff(np.append(starts, len(ok))), starts.copy()
        for k in range(1, int(sizes.max(initial=1))):
            g = np.flatnonzero(sizes > k)
            at = starts[g] + k
            nearer = d[at] < d[best[g]] - 1e-9
            best[g[nearer]] = at[nearer]
        best = best[np.lexsort((road[best], d[best], point[best]))]
        i, e = ok[best], edges[best]
        side = np.divide(ux[i] * py[i] - uy[i] * px[i], length[i], out=np.zeros(len(i)), where=length[i] > 0)
        return Hits(point[best] + begin, road[best], d[best], self.from_m[e] + t[i] * (self.to_m[e] - self.from_m[e]), side, self.bearing[e], px[i], py[i])

    def near_many(self, lats: list[float], lons: list[float], radii: list[float]) -> list[list[Near]]:
        """What project gives for each point."""
        hits = self.project_many(lats, lons, radii)
        every = [Near(self.order[r], *v) for r, *v in zip(*(c.tolist() for c in hits[1:]))]
        at = np.searchsorted(hits.point, np.arange(len(lats) + 1)).tolist()
        return [every[i:j] for i, j in zip(at, at[1:])]

    def onward(self, key: Key, forward: bool) -> Iterator[tuple[Key, bool]]:
        """What a directed road leads to: other roads at the node where it ends."""
        r = self.roads[key]
        yield from ((k, f) for k, f in self.at[r.end if forward else r.start] if k != key)

    def from_end(self, key: Key, forward: bool, limit: float) -> dict[tuple[Key, bool], float]:
        """Way from the end of a directed road to the entry of each one within a limit at least (shortest first); found once."""
        known = self.ways.get((key, forward))
        if known is not None and known[0] >= limit:
            return known[1]
        out: dict[tuple[Key, bool], float] = {}
        queue = [(0.0, *to) for to in self.onward(key, forward)]
        heapq.heapify(queue)
        limit = 25 * math.ceil(limit / 25)
        while queue:
            d, k, f = heapq.heappop(queue)
            if d > limit:
                break
            if (k, f) not in out:
                out[k, f] = d
                for to in self.onward(k, f):
                    heapq.heappush(queue, (d + self.roads[k].length, *to))
        if len(self.ways) > 20_000:
            self.ways.clear()
        self.ways[key, forward] = limit, out
        return out

    def reachable(self, key: Key, along: float, forward: bool, limit: float) -> dict[tuple[Key, bool], float]:
        """Way from a place to the entry of each directed road within a limit."""
        left = self.roads[key].length - along if forward else along
        return {k: left + d for k, d in self.from_end(key, forward, limit - left).items() if left + d <= limit} if left <= limit else {}


class Step(NamedTuple):
    """A pose after some way: covariance in the plane, heading and its error where they are known, turn by the gyroscope since the step before."""

    lat: float
    lon: float
    ee: float
    en: float
    nn: float
    heading: float | None
    heading_std: float | None
    way: float
    turn: float
    speed: float


class Hypothesis(NamedTuple):
    key: Key
    along: float
    forward: bool
    bearing: float
    log_p: float
    confident: float
    trail: tuple[tuple[Key, bool, float], ...]


def _widest(ee: float, en: float, nn: float) -> float:
    return math.sqrt(max(0.0, (ee + nn) / 2 + math.sqrt(((ee - nn) / 2) ** 2 + en * en)))


def _log_add(values: list[float]) -> float:
    top = max(values, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def radius_of(s: Step, rules: MatchRules) -> float:
    """How far from a pose roads are looked for."""
    return min(max(rules.radius_sigmas * _widest(s.ee, s.en, s.nn), rules.least_m), rules.most_m)


def axis_radius_of(s: Step, network: Network, rules: MatchRules) -> float:
    """How far from a pose axis_consensus looks for roads."""
    return max(rules.least_m, 3 * math.sqrt(_widest(s.ee, s.en, s.nn) ** 2 + network.widest**2 / 3 + rules.geometry_m**2))


class Matcher:
    """The state of one drive."""

    def __init__(self, network: Network, rules: MatchRules = MatchRules()):
        self.network, self.rules = network, rules
        self.found: list[Hypothesis] | None = None
        self.log_off = math.log(0.5)

    def _score(self, n: Near, forward: bool, s: Step) -> tuple[float, float]:
        """Travelled bearing and log likelihood of the pose on a directed road."""
        r, b = self.rules, math.radians(n.bearing)
        across = math.cos(b) ** 2 * s.ee - 2 * math.cos(b) * math.sin(b) * s.en + math.sin(b) ** 2 * s.nn
        var = across + n.road.half_width**2 / 3 + r.geometry_m**2
        bearing = n.bearing if forward else (n.bearing + 180) % 360
        score = -0.5 * n.distance**2 / var - 0.5 * math.log(2 * math.pi * var)
        if s.heading is not None and s.heading_std is not None:
            spread = s.heading_std**2 + math.radians(r.heading_deg) ** 2
            score -= 0.5 * _half_turn(s.heading - math.radians(bearing)) ** 2 / spread + 0.5 * math.log(2 * math.pi * spread)
        return bearing, score - (r.service_penalty if n.road.road_class == "service" else r.minor_penalty if n.road.road_class in _MINOR else 0.0)

    def _way(self, h: Hypothesis, left: float, ends: dict, key: Key, forward: bool, along: float, limit: float) -> float | None:
        """Way from a hypothesis, `left` metres before its road's end, to a place; None beyond the limit. A little backward on one road is noise."""
        if h.key == key and h.forward == forward and (d := along - h.along if forward else h.along - along) >= -20:
            return d
        entry = ends.get((key, forward))
        return None if entry is None or left + entry > limit else left + entry + (along if forward else self.network.roads[key].length - along)

    def step(self, s: Step, near: list[Near] | None = None) -> None:
        """near: the places of network.project within radius_of(s, rules), if they are known."""
        r = self.rules
        wide = _widest(s.ee, s.en, s.nn)
        near = (self.network.project(s.lat, s.lon, radius_of(s, r)) if near is None else near)[: r.candidates]
        states = [(n, f, *self._score(n, f, s)) for n in near for f in ((True,) if n.road.oneway else (True, False))]
        off = -0.5 * r.off_sigmas**2 - 0.5 * math.log(2 * math.pi * (wide**2 + r.geometry_m**2))
        if s.heading is not None and s.heading_std is not None:
            off -= math.log(2 * math.pi)
        share = math.log(max(len(states), 1))
        new: list[Hypothesis] = []
        if self.found is None:
            for n, f, bearing, score in states:
                new.append(Hypothesis(n.road.key, n.along, f, bearing, math.log(0.5) - share + score, 0.0, ((n.road.key, f, n.along),)))
            log_off = math.log(0.5) + off
        else:
            leave = r.leave_slow if s.speed < r.slow_mps else r.leave
            beta, turn_std = r.route_m + r.route_share * s.way, math.radians(r.turn_deg) + r.turn_share * abs(s.turn)
            peak = -math.log(2 * beta) - 0.5 * math.log(2 * math.pi * turn_std**2)
            limit = 2 * s.way + 60
            left = [self.network.roads[h.key].length - h.along if h.forward else h.along for h in self.found]
            reach = [(h, x, self.network.from_end(h.key, h.forward, limit - x) if x <= limit else {}) for h, x in zip(self.found, left)]
            from_off = self.log_off + math.log(r.enter) - share
            for n, f, bearing, score in states:
                ways = []
                for h, x, ends in reach:
                    if (d := self._way(h, x, ends, n.road.key, f, n.along, limit)) is not None:
                        bend = _half_turn(s.turn - math.radians(bearing - h.bearing))
                        ways.append((h.log_p + math.log(1 - leave) + peak - abs(d - s.way) / beta - 0.5 * (bend / turn_std) ** 2, h))
                best = max(ways, key=lambda w: w[0], default=None)
                before = best[1] if best is not None and best[0] >= from_off else None
                trail = (*(before.trail if before else ()), (n.road.key, f, n.along))[-r.trail :]
                new.append(Hypothesis(n.road.key, n.along, f, bearing, _log_add([from_off, *(w for w, _ in ways)]) + score, before.confident if before else 0.0, trail))
            on = _log_add([h.log_p for h in self.found])
            log_off = _log_add([self.log_off + math.log(1 - r.enter), on + math.log(leave)]) + peak - r.off_penalty + off
        total = _log_add([log_off, *(h.log_p for h in new)])
        self.log_off = log_off - total
        # The best stay, ties by segment, backward first; a road's share over a limit keeps its confident way.
        kept = sorted((h._replace(log_p=h.log_p - total) for h in new), key=lambda h: (-h.log_p, h.key, h.forward))[: r.hypotheses]
        self.found = kept
        # One street's share is the same for all of its pieces that point the same way.
        shares = self._shares(kept, kept)
        self.found = [h._replace(confident=h.confident + s.way if p >= r.confident else 0.0) for h, p in zip(kept, shares)]

    def off_road(self) -> float:
        return math.exp(self.log_off)

    def best(self) -> Hypothesis | None:
        return max(self.found or (), key=lambda h: h.log_p, default=None)

    def probability(self, h: Hypothesis) -> float:
        """Of the whole street in the hypothesis' direction: pieces of one street share it."""
        return self._shares(self.found, [h])[0]

    def _shares(self, found: list[Hypothesis], of: list[Hypothesis]) -> list[float]:
        """probability of each of some hypotheses among those found."""
        def street(x: Hypothesis) -> tuple:
            name = self.network.roads[x.key].name
            return ("name", name) if name else ("way", x.key[0])

        every = [(street(x), x.bearing, math.exp(x.log_p)) for x in found]
        return [sum([p for at, b, p in every if at == own and abs((b - h.bearing + 180) % 360 - 180) < 45]) for h, own in ((h, street(h)) for h in of)]

    def profile(self, h: Hypothesis, step: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
        """The road behind a hypothesis along its trail: metres back (rising) and travelled bearing (rad, unwrapped); empty arrays below two places."""
        back, bearings, way = [], [], 0.0
        for (a, fa, da), (b, fb, db) in zip(h.trail, h.trail[1:]):
            length = lambda k: self.network.roads[k].length
            spans = [(a, fa, da, db)] if (a, fa) == (b, fb) else [(a, fa, da, length(a) if fa else 0.0), (b, fb, 0.0 if fb else length(b), db)]
            for key, forward, start, end in spans:
                n = max(1, int(abs(end - start) / step))
                for i in range(n + 1):
                    d = start + (end - start) * i / n
                    back.append(way + abs(end - start) * i / n)
                    bearings.append(math.radians(self.network.roads[key].bearing_at(d) + (0 if forward else 180)))
                way += abs(end - start)
        where, first = np.unique(np.round(way - np.array(back[::-1]), 9), return_index=True)
        return where, np.unwrap(bearings)[::-1][first] if back else np.array([])


def axis_consensus(network: Network, s: Step, rules: MatchRules = MatchRules(), most_sigma_m: float = 150.0, window_m: float = 40.0, straight_deg: float = 5.0, spread_deg: float = 10.0, support: float = 0.9, off_score: float = 0.05, near: list[Near] | None = None) -> float | None:
    """The bearing (rad) on which all roads round a pose agree, in the direction that the heading is nearer to; None where they don't, or bend.

    Roads within three sigmas of the pose and of the heading form axes of at most spread_deg; each axis counts by its best road, so parallel roads
    are no more evidence than one. The best axis must hold `support` of all scores, off-road included, and be straight over window_m.
    near: the places of network.project within axis_radius_of(s, network, rules), if they are known.
    """
    wide = _widest(s.ee, s.en, s.nn)
    if wide > most_sigma_m or s.heading is None or s.heading_std is None:
        return None
    spread = s.heading_std**2 + math.radians(rules.heading_deg) ** 2
    found: list[tuple[float, float, Near]] = []  # off the heading, score
    for n in network.project(s.lat, s.lon, axis_radius_of(s, network, rules)) if near is None else near:
        off = _half_turn(math.radians(n.bearing) - s.heading)
        off = off if abs(off) <= math.pi / 2 else _half_turn(off + math.pi)
        extra = n.road.half_width**2 / 3 + rules.geometry_m**2
        ee, nn = s.ee + extra, s.nn + extra
        nis = (nn * n.east**2 - 2 * s.en * n.east * n.north + ee * n.north**2) / (ee * nn - s.en**2)
        if nis <= 9 and off * off <= 9 * spread:
            found.append((off, math.exp(-0.5 * (nis + off * off / spread)), n))
    axes: list[list[tuple[float, float, Near]]] = []
    for x in sorted(found, key=lambda x: x[:2]):
        if axes and x[0] - axes[-1][0][0] <= math.radians(spread_deg):
            axes[-1].append(x)
        else:
            axes.append([x])
    best = max(axes, key=lambda a: max(x[1] for x in a), default=None)
    if best is None:
        return None
    top = max(x[1] for x in best)
    bent = lambda n: n.road.most_turned(max(0.0, n.along - window_m), min(n.road.length, n.along + window_m), n.bearing) > straight_deg
    if top < support * (sum(max(x[1] for x in a) for a in axes) + off_score) or any(score >= 0.1 * top and bent(n) for _, score, n in best):
        return None
    angle = math.atan2(sum(w * math.sin(s.heading + o) for o, w, _ in best), sum(w * math.cos(s.heading + o) for o, w, _ in best))
    return angle % (2 * math.pi)


#: Columns of steps behind drive_id, t_ns, seq; and what the matcher makes of each.
STEP = "lat double, lon double, cov_ee double, cov_en double, cov_nn double, heading_rad double, heading_std_rad double, way_m double, turn_rad double, speed_mps double"
MATCH = "t_ns long, seq long, way_id long, piece long, forward boolean, along_m double, bearing_deg double, probability double, off_road double, confident_m double, name string, lat_on double, lon_on double, axis_rad double, hypotheses int"
_ROAD = ("way_id", "piece", "start_node", "end_node", "oneway", "road_class", "lanes", "name", "points")


def with_networks(rows: DataFrame, networks: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """drive_id, net_id, road and columns: the roads of a network (roads.segments' columns) in front of the rows of all drives that use it; `road` is null in rows.

    networks and rows share net_id (roads.networks_of_drives), or networks have drive_id, one for each drive. One shuffle; nothing is multiplied.
    """
    road = F.struct(*(F.col(c) for c in _ROAD))
    shared = "net_id" in networks.columns
    net = F.col("net_id" if shared else "drive_id").alias("net_id")
    both = networks.select(net, road.alias("road")).withColumn("first", F.lit(0)).unionByName(rows.select("drive_id", net, *columns).withColumn("first", F.lit(1)), allowMissingColumns=True)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a count that is told stays: the work of a partition is its steps, not its bytes
    return both.repartition(n, "net_id").sortWithinPartitions("net_id", "first", "drive_id", *order).select("drive_id", "net_id", "road", *columns)


class Networks:
    """Reads rows of with_networks: tells for each row whether it begins another drive, and gives its network."""

    def __init__(self) -> None:
        self.net = self.drive = None
        self.begun = False
        self.roads: list[Road] = []
        self.network: Network | None = None

    def takes(self, drive: object, net: object, road: dict | None) -> tuple[bool, bool]:
        """(a row of a drive, the first one of it)."""
        if not self.begun or net != self.net:
            self.net, self.roads, self.network, self.drive, self.begun, fresh = net, [], None, None, True, True
        else:
            fresh = self.network is None
        if road is not None:
            self.roads.append(road_from(road))
            return False, False
        if self.network is None:
            self.network = network_of(self.roads)
        first = fresh or drive != self.drive
        self.drive = drive
        return True, first


_last: Network | None = None


def network_of(roads: list[Road]) -> Network:
    """The network of some roads; the last one, with what it has found, if its roads are the same objects. Parts of one area have the same roads, as a rule."""
    global _last
    if _last is None or len(roads) != len(_last.roads) or any(_last.roads.get(r.key) is not r for r in roads):
        _last = Network(roads)
    return _last


_known: dict[tuple, Road] = {}


def road_from(x: dict) -> Road:
    """A road of a networks row; drives of one task share the roads of one area."""
    name = (x["way_id"], x["piece"], x["start_node"], x["end_node"], x["oneway"], x["road_class"], x["lanes"], x["name"], len(x["points"]), x["points"][0]["lat"], x["points"][-1]["lon"])
    if (road := _known.get(name)) is None:
        if len(_known) > 200_000:
            _known.clear()
        road = _known[name] = _road_from(x)
    return road


def _road_from(x: dict) -> Road:
    return road_of((x["way_id"], x["piece"]), x["start_node"], x["end_node"], bool(x["oneway"]), x["road_class"], x["lanes"], x["name"], [p["lat"] for p in x["points"]], [p["lon"] for p in x["points"]])


def match_drives(steps: DataFrame, networks: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:
    """drive_id and MATCH for each step (drive_id, t_ns, seq and STEP): the likeliest road position after it, null where no road is near.

    probability is that of the whole street in this direction, off_road that of no road, confident_m the way over which one street was nearly certain;
    axis_rad is axis_consensus at the step. Steps go in the order (t_ns, seq). A drive without roads has rows with off_road only. Steps without place or
    covariance are left out; a null turn, way or speed is 0.
    """
    names = [c.split(" ")[0] for c in STEP.split(", ")]
    usable = steps.filter("lat IS NOT NULL AND lon IS NOT NULL AND cov_ee IS NOT NULL AND cov_nn IS NOT NULL").fillna(0.0, ["cov_en", "way_m", "turn_rad", "speed_mps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, matcher, out = Networks(), None, []
        held: list[tuple] = []  # steps on one network: key, t, seq, whether a drive begins, Step

        def go(network: Network) -> None:
            nonlocal matcher
            steps = [x[4] for x in held]
            reach = [radius_of(s, rules) for s in steps]
            wider = [max(d, axis_radius_of(s, network, rules)) if _widest(s.ee, s.en, s.nn) <= 150.0 else d for s, d in zip(steps, reach)]
            for (key, t, seq, first, s), d, near in zip(held, reach, network.near_many([s.lat for s in steps], [s.lon for s in steps], wider)):
                if first:
                    matcher = Matcher(network, rules)
                matcher.step(s, [n for n in near[: rules.candidates] if n.distance <= d])
                wide = axis_radius_of(s, network, rules)
                h, axis, n = matcher.best(), axis_consensus(network, s, rules, near=[n for n in near if n.distance <= wide]), len(matcher.found)
                told = (None,) * 6 if h is None else (*h.key, h.forward, h.along, h.bearing, matcher.probability(h))
                r = None if h is None else network.roads[h.key]
                out.append((key, t, seq, *told, matcher.off_road(), h and h.confident, r and r.name, *(r.place(h.along) if r else (None, None)), axis, n))
            held.clear()

        for b in batches:
            for key, net, road, t, seq, *values in rows_of(b):
                before = at.network
                row, first = at.takes(key, net, road)
                if held and (not row or at.network is not before):
                    go(before)
                if row:
                    held.append((key, t, seq, first, Step(*values)))
            if held:
                go(at.network)
            kinds = [b.schema.field(0).type, *({"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[c.split(" ")[1]] for c in MATCH.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], ["drive_id", *(c.split(" ")[0] for c in MATCH.split(", "))])
            out.clear()

    kind = steps.schema["drive_id"].dataType.simpleString()
    return with_networks(usable, networks, ["t_ns", "seq", *names], ["t_ns", "seq"]).mapInArrow(run, f"drive_id {kind}, {MATCH}")
