"""A whole drive on the road network at once: the likeliest sequence of road places for positions and an odometer, and where the car was between them.

A drive's own piece of the network comes in front of its rows (road_matcher.with_networks). Positions of a drive are held together, as the search needs
its end; each has `candidates` places at most.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from drivelake.streaming.batches import rows_of
from drivelake.streaming.road_matcher import Hits, Near, Network, Networks, Road, with_networks


@dataclass(frozen=True)
class Limits:
    """What roads a stretch of a drive may be on: seconds since its first row; names are parts of names. Empty means any."""

    from_s: float
    until_s: float
    names: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    without_names: tuple[str, ...] = ()
    without_classes: tuple[str, ...] = ()

    def allows(self, r: Road) -> bool:
        return (not self.names or any(n in r.name for n in self.names)) and (not self.classes or r.road_class in self.classes) and r.road_class not in self.without_classes and not any(n in r.name for n in self.without_names)


@dataclass(frozen=True)
class OfflineRules:
    """Seconds and metres between positions, spread of positions, radius, scale of the difference between route and odometer, what a way against one-way rules costs."""

    step_s: float = 5.0
    least_m: float = 5.0
    sigma_m: float = 50.0
    radius_m: float = 150.0
    candidates: int = 40
    beta_m: float = 25.0
    wrong_way: float = 6.0
    most_share: float = 2.0
    most_more_m: float = 300.0
    unreliable_m: float = 40.0
    unreliable_share: float = 0.3
    limits: tuple[Limits, ...] = ()


#: Nodes of all searches together that a network keeps (about 80 MB); nodes of a network whose ways are kept as a table (two of 63 MB at most).
KEPT, TABLE = 5_000_000, 2_800
#: Metres that the limit of a search is rounded up to; links of places that are valued at once.
ROUND_M, LINKS = 100.0, 100_000


class Row(NamedTuple):
    """A time of a drive: its odometer, and a position where there is one."""

    t_ns: int
    seq: int
    odo_m: float
    lat: float | None
    lon: float | None


class Tree(NamedTuple):
    """Shortest ways from a node: places of nodes (rising), metres, and the directed road that led there (2 * place of the road + 1 if along it; -1: none)."""

    limit: float
    nodes: np.ndarray
    metres: np.ndarray
    by: np.ndarray


class Ways:
    """Shortest ways between nodes of a network, kept for all drives on it. Nodes and roads go by their places, in the order of their keys."""

    def __init__(self, network: Network):
        self.network = network
        if network.ends_at is None:
            nodes = sorted({n for r in network.order for n in (r.start, r.end)})
            place = {n: i for i, n in enumerate(nodes)}
            network.ends_at = np.array([(place[r.start], place[r.end]) for r in network.order], int).reshape(-1, 2)
            network.road_place = {r.key: i for i, r in enumerate(network.order)}
            network.lengths, network.one_way = np.array([r.length for r in network.order]), np.array([r.oneway for r in network.order], bool)
            where: dict[int, tuple] = {}
            network.one_place = all(where.setdefault(n, p) == p for r in network.order for n, p in ((r.start, (r.lats[0], r.lons[0])), (r.end, (r.lats[-1], r.lons[-1]))))
        self.n = int(network.ends_at.max(initial=-1)) + 1

    def _onward(self, lawful: bool, banned: tuple[str, ...]) -> list[list[tuple[float, int, int]]]:
        """For each node: length, node and directed road of what can be driven from it."""
        at = self.network
        if (out := at.onwards.get((lawful, banned))) is None:
            out = at.onwards[lawful, banned] = [[] for _ in range(self.n)]
            for i, (r, (a, b)) in enumerate(zip(at.order, at.ends_at.tolist())):
                if not any(x in r.name for x in banned):
                    out[a].append((r.length, b, 2 * i + 1))
                    if not lawful or not r.oneway:
                        out[b].append((r.length, a, 2 * i))
        return out

    def search(self, node: int, limit: float, lawful: bool, banned: tuple[str, ...] = ()) -> Tree:
        """All nodes within a limit at least. Found once, if no longer limit comes; searches of KEPT nodes stay."""
        at, asked = self.network, (node, lawful, banned)
        if (out := at.searches.get(asked)) is None or out.limit < limit:
            at.searched -= 0 if out is None else len(out.nodes)
            out = self._search(node, ROUND_M * math.ceil(limit / ROUND_M), self._onward(lawful, banned))
            if at.searched + len(out.nodes) > KEPT:
                at.searches.clear()
                at.searched = 0
            at.searches[asked] = out
            at.searched += len(out.nodes)
        return out

    def _search(self, node: int, limit: float, onward: list) -> Tree:
        out: dict[int, tuple[float, int]] = {}
        queue = [(0.0, node, -1, -1)]
        while queue:
            d, at, _, by = heapq.heappop(queue)
            if at in out:
                continue
            out[at] = d, by
            for length, to, road in onward[at]:
                if to not in out and d + length <= limit:
                    heapq.heappush(queue, (d + length, to, at, road))
        nodes = np.fromiter(out, np.int32, len(out))
        order = np.argsort(nodes)
        metres, by = zip(*out.values())
        return Tree(limit, nodes[order], np.array(metres)[order], np.array(by, np.int32)[order])

    def between(self, sources: np.ndarray, entries: np.ndarray, limit: float, lawful: bool, banned: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Metres from sources to entries (rising places of nodes; more than the limit is more or infinite), and the places of rows and columns. None: all nodes."""
        if self.n > TABLE:
            out = np.full((len(sources), len(entries)), np.inf)
            for i, x in enumerate(sources.tolist()):
                tree = self.search(x, limit, lawful, banned)
                at = np.minimum(np.searchsorted(tree.nodes, entries), len(tree.nodes) - 1)
                met = tree.nodes[at] == entries
                out[i, met] = tree.metres[at[met]]
            return out, sources, entries
        tables = self.network.tables
        if (lawful, banned) not in tables:
            if len(tables) >= 2 and banned:
                for x in [x for x in tables if x[1]]:
                    del tables[x]
            tables[lawful, banned] = np.full((self.n, self.n), np.inf), np.full(self.n, -1.0)
        table, known = tables[lawful, banned]
        for x in sources[known[sources] < limit].tolist():
            tree = self.search(x, limit, lawful, banned)
            table[x, tree.nodes] = tree.metres
            known[x] = tree.limit
        return table, None, None

    def metres(self, node: int, to: int, limit: float, lawful: bool, banned: tuple[str, ...]) -> float:
        """The way between two nodes; infinite beyond the limit."""
        tree = self.search(node, limit, lawful, banned)
        i = int(np.searchsorted(tree.nodes, to))
        return float(tree.metres[i]) if i < len(tree.nodes) and tree.nodes[i] == to and tree.metres[i] <= limit else math.inf

    def path(self, node: int, to: int, limit: float, lawful: bool) -> list[tuple[Road, bool]]:
        """The directed roads from a node to another one that its search has found."""
        tree, out = self.search(node, limit, lawful), []
        while (by := int(tree.by[np.searchsorted(tree.nodes, to)])) >= 0:
            out.append((self.network.order[by // 2], by % 2 == 1))
            to = int(self.network.ends_at[by // 2, 1 - by % 2])
        return out[::-1]


class Link(NamedTuple):
    """How one place leads to the next: way, and the nodes that lie between, where a's road is left and b's is entered; None: on one road."""

    way: float
    lawful: bool
    ends: tuple[int, int] | None


def link(a: Near, b: Near, ways: Ways, limit: float, lawful: bool, banned: tuple[str, ...] = ()) -> Link | None:
    """The shortest way from place a to place b."""
    free, places = not lawful, ways.network.road_place
    best = None
    if a.road.key == b.road.key and (b.along >= a.along or not a.road.oneway or free):
        best = Link(abs(b.along - a.along), lawful, None)
    exits = [(1, a.road.end, a.road.length - a.along), *([(0, a.road.start, a.along)] if free or not a.road.oneway else [])]
    entries = [(0, b.road.start, b.along), *([(1, b.road.end, b.road.length - b.along)] if free or not b.road.oneway else [])]
    for i, out, left in exits:
        for j, into, more in entries:
            hit = ways.metres(int(ways.network.ends_at[places[a.road.key], i]), int(ways.network.ends_at[places[b.road.key], j]), limit, lawful, banned)
            if hit < math.inf and (best is None or left + hit + more < best.way):
                best = Link(left + hit + more, lawful, (out, into))
    return best


class Match(NamedTuple):
    """The chosen place of a position, and the link that led to it (None: the chain begins anew)."""

    row: Row
    near: Near
    link: Link | None


def _candidates(rows: list[Row], since: list[float], network: Network, rules: OfflineRules) -> tuple[Hits, list[np.ndarray]]:
    """Places of roads near positions, and for each position those of them that take part, nearest first."""
    lats, lons = [x.lat for x in rows], [x.lon for x in rows]
    bounds = lambda hits: np.searchsorted(hits.point, np.arange(len(rows) + 1))
    if not rules.limits:
        # Half the radius will do where it holds enough roads.
        hits = network.project_many(lats, lons, [rules.radius_m / 2] * len(rows))
        few = np.flatnonzero(np.diff(bounds(hits)) < rules.candidates)
        if len(few):
            more = network.project_many([lats[i] for i in few], [lons[i] for i in few], [rules.radius_m] * len(few))
            kept = ~np.isin(hits.point, few)
            both = [np.concatenate([a[kept], b]) for a, b in zip(hits, more._replace(point=few[more.point]))]
            order = np.argsort(both[0], kind="stable")
            hits = Hits(*(c[order] for c in both))
        at = bounds(hits).tolist()
        return hits, [np.arange(i, min(j, i + rules.candidates)) for i, j in zip(at, at[1:])]
    hits, out = network.project_many(lats, lons, [2 * rules.radius_m] * len(rows)), []
    at = bounds(hits).tolist()
    for s, i, j in zip(since, at, at[1:]):
        now = [c for c in rules.limits if c.from_s <= s <= c.until_s]
        near = [k for k in range(i, j) if all(c.allows(network.order[hits.road[k]]) for c in now)]
        near = near or [k for k in range(i, j) if hits.distance[k] <= rules.radius_m]
        out.append(np.array(near[: rules.candidates], int))
    return hits, out


def best_chain(rows: list[Row], network: Network, rules: OfflineRules = OfflineRules()) -> list[Match]:
    """The likeliest places of the positions among rows: those of step_s and least_m apart at least that have a road near."""
    used: list[Row] = []
    for x in rows:
        if x.lat is not None and x.lon is not None and not (used and ((x.t_ns - used[-1].t_ns) / 1e9 < rules.step_s or x.odo_m - used[-1].odo_m < rules.least_m)):
            used.append(x)
    if not used:
        return []
    start = rows[0].t_ns
    hits, near = _candidates(used, [(x.t_ns - start) / 1e9 for x in used], network, rules)
    seen, near = [x for x, c in zip(used, near) if len(c)], [c for c in near if len(c)]
    if not seen:
        return []
    ways, since = Ways(network), [(x.t_ns - start) / 1e9 for x in seen]
    driven = [0.0, *(b.odo_m - a.odo_m for a, b in zip(seen, seen[1:]))]
    limits = [rules.most_share * d + rules.most_more_m for d in driven]
    banned = [()] + [tuple(n for c in rules.limits if c.from_s <= until and at <= c.until_s for n in c.without_names) for at, until in zip(since, since[1:])]
    # Candidates of all positions as tables of one width; what is missing is infinitely far.
    width = max(map(len, near))
    some = np.arange(width) < np.array([len(c) for c in near])[:, None]
    at = np.zeros((len(seen), width), int)
    at[some] = np.concatenate(near)
    fits = np.where(some, -0.5 * (hits.distance[at] / rules.sigma_m) ** 2, -np.inf)
    cands = _Candidates(hits.road[at], *(network.ends_at[hits.road[at], i] for i in (0, 1)), network.one_way[hits.road[at]], hits.along[at], network.lengths[hits.road[at]] - hits.along[at], some)
    score, back, scores = fits[0], [np.full(width, -1)], [fits[0]]
    apart = _apart(seen, cands, np.where(some, hits.distance[at], 0.0).max(axis=1), limits, network)
    most, costs, k = max(1, LINKS // width**2), {}, 1
    for k in range(1, len(seen)):
        if not apart[k] and k not in costs:
            steps = [i for i in range(k, len(seen)) if not apart[i] and banned[i] == banned[k]][:most]
            costs = dict(zip(steps, _costs(cands, steps, driven, limits, ways, banned[k], rules)))
        by = np.full(width, -1)
        if not apart[k]:
            values = (score[:, None] + costs[k]) + fits[k]
            by = values.argmax(axis=0)
            score = values[by, np.arange(width)]
            by[score == -np.inf] = -1
        if (by < 0).all():  # nothing leads on: the chain begins anew
            score = fits[k]
        scores.append(score)
        back.append(by)
    place = lambda k, j: Near(network.order[hits.road[at[k, j]]], *(float(c[at[k, j]]) for c in hits[2:]))
    out: list[Match] = []
    j = int(np.argmax(score))
    b = place(len(seen) - 1, j)
    for k in range(len(seen) - 1, -1, -1):
        i, how = int(back[k][j]), None
        if k:
            j = i if i >= 0 else int(np.argmax(scores[k - 1]))
            a = place(k - 1, j)
            if i >= 0:
                options = [(-abs(x.way - driven[k]) / rules.beta_m - (0 if x.lawful else rules.wrong_way), x) for lawful in (True, False) if (x := link(a, b, ways, limits[k], lawful, banned[k])) is not None]
                how = max(options, key=lambda o: o[0])[1]
        out.append(Match(seen[k], b, how))
        if k:
            b = a
    return out[::-1]


class _Candidates(NamedTuple):
    """Places of roads for each position, as tables: road, its start and end, whether it is one-way, metres from its start and to its end; some: there is one."""

    road: np.ndarray
    start: np.ndarray
    end: np.ndarray
    oneway: np.ndarray
    along: np.ndarray
    left: np.ndarray
    some: np.ndarray


def _apart(seen: list[Row], cands: _Candidates, widest: np.ndarray, limits: list[float], network: Network) -> list[bool]:
    """For each position whether no place of the one before can lead to it: they have no road in common, and even in a straight line they are too far apart.

    Never so where roads hold one node at different places: ways may be shorter than the line there.
    """
    if not network.one_place:
        return [False] * len(seen)
    lat, lon = np.array([x.lat for x in seen]), np.array([x.lon for x in seen])
    north, east = np.diff(lat), (np.diff(lon) + 180) % 360 - 180
    scale = np.cos(np.radians(np.minimum(np.maximum(np.abs(lat[1:]), np.abs(lat[:-1])), 90.0)))
    line = 110_500 * np.hypot(north, east * scale)  # a degree is longer everywhere
    widest = widest + np.where(cands.some, np.maximum(cands.along, cands.left), 0.0).max(axis=1)  # on the roads themselves no limit holds
    far = line > 1.02 * (np.array(limits[1:]) + widest[1:] + widest[:-1]) + 10
    for k in np.flatnonzero(far).tolist():
        a, b = (cands.road[i][cands.some[i]] for i in (k, k + 1))
        far[k] = not (a[:, None] == b).any()
    return [False, *far.tolist()]


def _costs(cands: _Candidates, steps: list[int], driven: list[float], limits: list[float], ways: Ways, banned: tuple[str, ...], rules: OfflineRules) -> np.ndarray:
    """For some positions: how well each place of the one before leads to each of its own. Minus infinity: it doesn't."""
    here = np.array(steps)
    a = _Candidates(*(c[here - 1][:, :, None] for c in cands))
    b = _Candidates(*(c[here][:, None, :] for c in cands))
    limits = [limits[i] for i in steps]
    far, limit = np.array([driven[i] for i in steps])[:, None, None], np.array(limits)[:, None, None]
    sources, entries = (np.unique(np.concatenate([x.start[x.some], x.end[x.some]])) for x in (a, b))
    same, best = a.road == b.road, None
    for lawful in (True, False):
        table, rows, columns = ways.between(sources, entries, max(limits), lawful, banned)
        row = lambda x: x if rows is None else np.minimum(np.searchsorted(rows, x), len(rows) - 1)  # noqa: B023, E731
        column = lambda x: x if columns is None else np.minimum(np.searchsorted(columns, x), len(columns) - 1)  # noqa: B023, E731
        two_a, two_b = (x.some & ~(x.oneway & lawful) for x in (a, b))
        exits = [(row(a.end), np.where(a.some, a.left, np.inf)), (row(a.start), np.where(two_a, a.along, np.inf))]
        ins = [(column(b.start), np.where(b.some, b.along, np.inf)), (column(b.end), np.where(two_b, b.left, np.inf))]
        way = np.where(same & a.some & b.some & ((b.along >= a.along) | two_a), np.abs(b.along - a.along), np.inf)
        flat = table.ravel()
        for out, left in exits:
            for into, more in ins:
                hit = flat.take(out * table.shape[1] + into)
                hit[hit > limit] = np.inf
                hit += left
                hit += more
                np.minimum(way, hit, out=way)
        cost = -np.abs(way - far) / rules.beta_m - (0 if lawful else rules.wrong_way)
        best = cost if best is None else np.maximum(best, cost)
    return best


def _route(matches: list[Match], network: Network, rules: OfflineRules) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Places (lat, lon) along the whole route, metres up to each, and which of them are the matches."""
    ways, places, anchors = Ways(network), [], []

    def part(r: Road, start: float, end: float) -> None:
        inner = [d for d in r.ends.tolist() if min(start, end) < d < max(start, end)]
        places.extend(r.place(d) for d in [start, *(inner if end >= start else inner[::-1]), end])

    for k, m in enumerate(matches):
        if k and m.link is not None:
            a = matches[k - 1].near
            if m.link.ends is None:
                part(m.near.road, a.along, m.near.along)
            else:
                out, into = m.link.ends
                leaves, enters = network.ends_at[network.road_place[a.road.key]], network.ends_at[network.road_place[m.near.road.key]]
                roads = ways.path(int(leaves[0 if a.road.start == out else 1]), int(enters[0 if m.near.road.start == into else 1]), m.link.way + 1, m.link.lawful)
                forward = a.road.end == out and not (a.road.start == out and a.along < a.road.length - a.along)
                part(a.road, a.along, a.road.length if forward else 0.0)
                for r, f in roads:
                    part(r, 0.0 if f else r.length, r.length if f else 0.0)
                begins = m.near.road.start == into and not (m.near.road.end == into and m.near.road.length - m.near.along < m.near.along)
                part(m.near.road, 0.0 if begins else m.near.road.length, m.near.along)
        places.append(m.near.road.place(m.near.along))
        anchors.append(len(places) - 1)
    p = np.array(places)
    east = np.diff(p[:, 1]) * np.cos(np.radians((p[1:, 0] + p[:-1, 0]) / 2))
    return p, np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(p[:, 0]), east) * 111_195)]), anchors


def places_on_route(rows: list[Row], matches: list[Match], network: Network, rules: OfflineRules = OfflineRules()) -> list[tuple]:
    """(t_ns, seq, lat, lon, bearing_deg, reliable) of the rows from the first to the last match: between two matches by the odometer's share of the way.

    Not reliable where route and odometer differ by more than 40 m and three tenths between the matches around.
    """
    if len(matches) < 2:
        return []
    p, way, at = _route(matches, network, rules)
    times, odo = np.array([m.row.t_ns for m in matches]), np.array([m.row.odo_m for m in matches])
    on = way[at]
    moved, driven = np.diff(on), np.diff(odo)
    poor = np.abs(moved - driven) > np.maximum(rules.unreliable_m, rules.unreliable_share * driven)
    out = []
    for x in rows:
        if not times[0] <= x.t_ns <= times[-1]:
            continue
        i = min(max(int(np.searchsorted(times, x.t_ns, side="left")) - 1, 0), len(driven) - 1)
        share = 0.0 if driven[i] < 1e-6 else min(max((x.odo_m - odo[i]) / driven[i], 0.0), 1.0)
        d = on[i] + share * moved[i]
        k = min(max(int(np.searchsorted(way, d, side="right")) - 1, 0), len(way) - 2)
        u = (d - way[k]) / (way[k + 1] - way[k]) if way[k + 1] > way[k] else 0.0
        lat, lon = p[k] + u * (p[k + 1] - p[k])
        step = next((s for s in (*range(k, len(p) - 1), *range(k, -1, -1)) if way[s + 1] > way[s]), k)
        north, east = p[step + 1, 0] - p[step, 0], (p[step + 1, 1] - p[step, 1]) * math.cos(math.radians(lat))
        touched = [bool(poor[j]) for j in (i, i + 1) if j < len(poor) and times[j] <= x.t_ns <= times[j + 1]]
        out.append((x.t_ns, x.seq, float(lat), float(lon), math.degrees(math.atan2(east, north)) % 360, not any(touched)))
    return out


#: Rows behind drive_id; matched are the positions that were chosen, with their road.
OUT = "t_ns long, seq long, lat double, lon double, bearing_deg double, reliable boolean, matched boolean, way_id long, piece long, along_m double, distance_m double, begins boolean"


def match_whole_drives(rows: DataFrame, networks: DataFrame, rules: OfflineRules = OfflineRules()) -> DataFrame:
    """drive_id and OUT: where each row (drive_id, t_ns, seq, odo_m, lat, lon; place null: only asked for) was on the likeliest route of its drive.

    matched rows are the positions that took part, with their road place; begins where nothing led on from the one before. Rows before the first or
    behind the last matched one, and drives with fewer than two, have no place and are left out. Rows without an odometer are left out. Order: (t_ns, seq).
    """
    names = [c.split(" ")[0] for c in OUT.split(", ")]

    def flush(key, network, held) -> list[tuple]:
        chain = best_chain(held, network, rules)
        by = {(m.row.t_ns, m.row.seq): (m, k) for k, m in enumerate(chain)}
        out = []
        for t, seq, *place in places_on_route(held, chain, network, rules):
            m, k = by.get((t, seq), (None, 0))
            out.append((key, t, seq, *place, m is not None, *((*m.near.road.key, m.near.along, m.near.distance, k > 0 and m.link is None) if m else (None,) * 5)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, drive, network, held, kind = Networks(), None, None, [], None
        types = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

        def table(out: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, *(types[c.split(" ")[1]] for c in OUT.split(", "))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], ["drive_id", *names])

        for b in batches:
            kind = b.schema.field(0).type
            for key, net, road, *values in rows_of(b):
                row, first = at.takes(key, net, road)
                if (first or not row) and held:
                    yield table(flush(drive, network, held))
                    held = []
                if row:
                    drive, network = key, at.network
                    held.append(Row(*values))
        if held:
            yield table(flush(drive, network, held))

    kind = rows.schema["drive_id"].dataType.simpleString()
    ordered = with_networks(rows.filter("odo_m IS NOT NULL"), networks, ["t_ns", "seq", "odo_m", "lat", "lon"], ["t_ns", "seq"])
    return ordered.mapInArrow(run, f"drive_id {kind}, {OUT}")
