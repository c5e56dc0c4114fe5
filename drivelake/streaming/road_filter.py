"""The filter held to the road: soft, gated corrections by the matched road's bearing, its line, its shape, and the axis that all roads near agree on.

The matcher follows a second filter that no road ever corrects, so a road can't confirm itself; that one's covariance is also what an estimate claims at least.
"""

from __future__ import annotations

import copy
import math
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from drivelake.operators.matching import shift_of
from drivelake.streaming.estimators import E, N, PSI, V, Estimate, Filter, FilterRules, _half_turn
from drivelake.streaming.road_matcher import Hypothesis, Matcher, MatchRules, Network, Road, Step, axis_consensus
from drivelake.streaming.tracker import Motion
from drivelake.streaming.trust_fold import Event


@dataclass(frozen=True)
class RoadRules:
    """When a road may correct, how often and how strongly."""

    step_m: float = 10.0
    probability: float = 0.9
    confident_m: float = 150.0
    off_road: float = 0.1
    sigma_m: float = 50.0
    least_mps: float = 4.2
    speed_std: float = 1.5
    every_m: float = 40.0
    heading_deg: float = 3.0
    straight_deg: float = 5.0
    straight_m: float = 40.0
    turn_deg: float = 3.0
    turn_steps: int = 4
    gate_nis: float = 9.0
    rejects: int = 2
    along_every_m: float = 150.0
    end_m: float = 15.0
    axis_deg: float = 6.0
    axis_every_s: float = 10.0
    axis_quiet_s: float = 3.0
    axis_fix_s: float = 45.0


class RoadFilter:
    """Two filters of one drive: `main` is corrected by roads, `free` isn't and leads the matcher."""

    def __init__(self, network: Network, rules: FilterRules = FilterRules(), match: MatchRules = MatchRules(), road: RoadRules = RoadRules()):
        self.main, self.free = Filter(rules), Filter(rules)
        self.matcher, self.road = Matcher(network, match), road
        self.since = self.turn = self.turned = 0.0
        self.turns: deque[float] = deque(maxlen=road.turn_steps)
        self.course: deque[tuple[float, float]] = deque(maxlen=match.trail)  # way and turn so far at each step
        self.last = dict.fromkeys(("heading", "line", "shape"), -math.inf)
        self.axis_t: int | None = None
        self.quiet: deque[tuple[int, float, float, float]] = deque()
        self.rejected = 0
        #: Corrections taken and refused, by kind.
        self.counts: dict[str, list[int]] = {k: [0, 0] for k in ("heading", "line", "shape", "axis")}

    def on_event(self, x: Event, state: str | None) -> None:
        self.free.on_event(x, state)
        self.main.on_event(x, state)

    def on_motion(self, m: Motion) -> None:
        self.free.on_motion(m)
        self.main.on_motion(m)
        turn = -(m.yaw_rate - self.free.x[4]) * m.dt_s
        self.turn += turn
        if m.dt_s > 1.5:
            self.quiet.clear()
        self.quiet.append((m.t_ns, m.dt_s, turn, m.tilt_rms))
        while self.quiet[0][0] <= m.t_ns - self.road.axis_quiet_s * 1e9:
            self.quiet.popleft()
        if not (self.free.known and self.free.plane is not None):
            return
        self._by_axis(m.t_ns)
        if self.free.way - self.since >= self.road.step_m:
            self.matcher.step(self._pose(self.free.way - self.since, self.turn))
            self.turned += self.turn
            self.turns.append(self.turn)
            self.course.append((self.free.way, self.turned))
            self.since, self.turn = self.free.way, 0.0
            if self.main.known and self.main.plane is not None:
                self._by_road()

    def _pose(self, way: float, turn: float) -> Step:
        f = self.free
        return Step(*map(float, f.plane.place(*f.x[:2])), float(f.p[E, E]), float(f.p[E, N]), float(f.p[N, N]), float(f.x[PSI]) % (2 * math.pi), math.sqrt(f.p[PSI, PSI]), float(way), float(turn), abs(float(f.x[V])))

    def _try(self, kind: str, h: np.ndarray, miss: float, noise: float, only: tuple[int, ...] | None = None) -> bool:
        """A correction, unless it is too far off. One road is one piece of evidence: it never makes the state surer than itself."""
        prior = float(h @ self.main.p @ h)
        if prior <= noise:
            return True
        fits = miss * miss / (prior + noise) <= self.road.gate_nis
        if fits:
            self.main._update(h, miss, noise, only)
        self.counts[kind][not fits] += 1
        return fits

    def _moving(self, f: Filter) -> bool:
        return abs(f.x[V]) >= self.road.least_mps

    def _by_axis(self, t: int) -> None:
        """Without a sure speed only the axis on which all roads near agree, and only where the phone is quiet and a fix is recent."""
        r, f, main = self.road, self.free, self.main
        if f.still or not main.known or not self._moving(f) or math.sqrt(f.p[V, V]) <= r.speed_std or f._since(t, f.obd_t) <= f.rules.accel_obd_s or f._since(t, f.satellite_t) <= f.rules.tracking_s or f._since(t, f.fix_t) > r.axis_fix_s:
            return
        if self.axis_t is not None and (t - self.axis_t) / 1e9 < r.axis_every_s or main.p[PSI, PSI] <= math.radians(r.axis_deg) ** 2:
            return
        span = sum(dt for _, dt, _, _ in self.quiet)
        turns = [turn for _, _, turn, _ in self.quiet]
        if span < 0.95 * r.axis_quiet_s or math.degrees(abs(sum(turns))) > r.turn_deg or math.degrees(sum(map(abs, turns))) > 3 * r.turn_deg or sum(tilt * dt for _, dt, _, tilt in self.quiet) / span > f.rules.hand_floor:
            return
        self.axis_t = t
        if (axis := axis_consensus(self.matcher.network, self._pose(0.0, 0.0), self.matcher.rules)) is not None:
            self._try("axis", np.eye(7)[PSI], _half_turn(axis - main.x[PSI]), math.radians(r.axis_deg) ** 2, (PSI,))

    def _by_road(self) -> None:
        r, main, h = self.road, self.main, self.matcher.best()
        if h is None or self.matcher.probability(h) < r.probability or h.confident < r.confident_m or self.matcher.off_road() > r.off_road:
            return
        wide = math.sqrt(max(main.p[E, E], main.p[N, N]) + abs(main.p[E, N]))
        if wide > r.sigma_m or not self._moving(main) or math.sqrt(main.p[V, V]) > r.speed_std:
            return
        road = self.matcher.network.roads[h.key]
        travel = math.radians(h.bearing)
        due = lambda kind, every: main.way - self.last[kind] >= every
        if due("heading", r.every_m) and self._straight(road, h):
            self._try("heading", np.eye(7)[PSI], _half_turn(travel - main.x[PSI]), math.radians(r.heading_deg) ** 2)
            self.last["heading"] = main.way
        if due("shape", r.along_every_m) and len(self.course) >= 3:
            self._by_shape(road, h, travel)
        if due("line", r.every_m) and r.end_m + wide <= h.along <= road.length - r.end_m - wide:
            self.last["line"] = main.way
            right = np.zeros(7)
            b = math.radians(road.bearing_at(h.along))
            right[E], right[N] = math.cos(b), -math.sin(b)
            noise = road.half_width**2 / 3 + self.matcher.rules.geometry_m**2
            if self._try("line", right, float(right[:2] @ (main.plane.at(*road.place(h.along)) - main.x[:2])), noise):
                self.rejected = 0
            elif (rejected := self.rejected + 1) >= r.rejects:
                # The matcher has gone to another road, or this one has drifted off: as the free one again.
                self.main, self.rejected = copy.deepcopy(self.free), 0
                self.last = dict.fromkeys(self.last, -math.inf)
            else:
                self.rejected = rejected

    def _straight(self, road: Road, h: Hypothesis) -> bool:
        """Road and drive both go straight on."""
        r = self.road
        here = road.bearing_at(h.along)
        bends = [abs((road.bearing_at(min(max(d, 0.0), road.length)) - here + 180) % 360 - 180) for d in (h.along - r.straight_m, h.along + r.straight_m)]
        turns = [math.degrees(abs(x)) for x in self.turns]
        return road.length >= r.straight_m and max(bends) < r.straight_deg and len(turns) == r.turn_steps and max(turns) < r.turn_deg and math.degrees(abs(sum(self.turns))) < r.turn_deg

    def _by_shape(self, road: Road, h: Hypothesis, travel: float) -> None:
        """Along the road, by the shape of the bends behind."""
        main, free = self.main, self.free
        way, turned = np.array(self.course).T
        found = shift_of(((self.free.way - way)[::-1], turned[::-1]), self.matcher.profile(h))
        if found is None:
            return
        self.last["shape"] = main.way
        on = np.zeros(7)
        on[E], on[N] = math.sin(travel), math.cos(travel)
        # Lines of roads in other directions have made the state surer along this one without telling anything of it.
        lacking = float(on @ free.p @ on - on @ main.p @ on)
        if lacking > 0:
            main.p = main.p + lacking * np.outer(on, on)
        miss = float(on[:2] @ (main.plane.at(*road.place(h.along)) - main.x[:2])) + found[0]
        self._try("shape", on, miss, found[1] ** 2 + self.matcher.rules.geometry_m**2)

    def estimate(self, t_ns: int) -> Estimate | None:
        """The corrected place; its covariance is that of the free filter where that is wider."""
        e, free = self.main.estimate(t_ns), self.free.estimate(t_ns)
        return e if e is None or free is None or free.r68 < e.r68 else e._replace(ee=free.ee, en=free.en, nn=free.nn)


def road_filter_of(rules: FilterRules = FilterRules(), match: MatchRules = MatchRules(), road: RoadRules = RoadRules()) -> Callable[[Network], RoadFilter]:
    """A maker of filters that need a network."""
    return lambda network: RoadFilter(network, rules, match, road)
