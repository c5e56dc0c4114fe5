"""Estimators of a drive's position, registered by name: the last trusted fix held, and an extended Kalman filter with a bank of headings.

Each takes motions (tracker.Motion) and events with their verdicts, and gives its estimate at a time without changing. Angles are clockwise
from north; east and north are metres in a plane around an anchor that moves with the car.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import NamedTuple, Protocol

import numpy as np

from drivelake.functions.geo import R68_PER_SIGMA, WGS84_A, WGS84_E2
from drivelake.operators.replay import GROWTH_MPS, HOLD_ACC_M, TRACKING_S
from drivelake.streaming.compass import Compass, CompassRules, Reading
from drivelake.streaming.tracker import Motion
from drivelake.streaming.trust_fold import Event

GRAVITY = 9.80665
#: A plane further than this from its anchor is anchored anew.
REANCHOR_M = 20_000.0


class Estimate(NamedTuple):
    t_ns: int
    lat: float
    lon: float
    ee: float
    en: float
    nn: float
    heading_rad: float | None
    heading_std_rad: float | None
    speed_mps: float | None
    speed_std_mps: float | None
    mode: str

    @property
    def r68(self) -> float:
        """Radius that holds 68 of 100, by the mean of both axes."""
        return R68_PER_SIGMA * math.sqrt(max(0.0, (self.ee + self.nn) / 2))


class Estimator(Protocol):
    def on_motion(self, m: Motion) -> None: ...

    def on_event(self, x: Event, state: str | None) -> None:
        """state: the verdict on a fix, None for other events."""

    def estimate(self, t_ns: int) -> Estimate | None: ...


class HoldLastFix:
    """The last trusted satellite fix, with a radius that grows."""

    def __init__(self) -> None:
        self.fix: Event | None = None

    def on_motion(self, m: Motion) -> None:
        pass

    def on_event(self, x: Event, state: str | None) -> None:
        if x.kind == "location" and x.source == "GNSS" and state == "TRUSTED" and not x.synthetic:
            self.fix = x

    def estimate(self, t_ns: int) -> Estimate | None:
        if (f := self.fix) is None:
            return None
        age = (t_ns - f.t_ns) / 1e9
        spread = (((HOLD_ACC_M if f.h_acc_m is None else f.h_acc_m) + GROWTH_MPS * max(0.0, age)) / R68_PER_SIGMA) ** 2
        heading = None if f.bearing_deg is None else math.radians(f.bearing_deg)
        return Estimate(t_ns, f.lat, f.lon, spread, 0.0, spread, heading, None, f.speed_mps, None, "GNSS_TRACKING" if age <= TRACKING_S else "COARSE_ONLY")


class _Plane:
    """East and north metres around an anchor."""

    def __init__(self, lat: float, lon: float):
        self.lat, self.lon = lat, lon
        s = math.sin(math.radians(lat))
        curve = WGS84_A / math.sqrt(1 - WGS84_E2 * s * s)
        self.per_lat, self.per_lon = math.radians(curve * (1 - WGS84_E2) / (1 - WGS84_E2 * s * s)), math.radians(curve * math.cos(math.radians(lat)))

    def at(self, lat: float, lon: float) -> np.ndarray:
        return np.array([((lon - self.lon + 180) % 360 - 180) * self.per_lon, (lat - self.lat) * self.per_lat])

    def place(self, east: float, north: float) -> tuple[float, float]:
        return self.lat + north / self.per_lat, (self.lon + east / self.per_lon + 180) % 360 - 180


_EYE = np.eye(7)


def _twin(x):
    """As copy.copy of a plain object, without the ways round that take most of its time."""
    out = object.__new__(type(x))
    out.__dict__.update(x.__dict__)
    return out


def _half_turn(rad: float) -> float:
    return math.pi - (math.pi - rad) % (2 * math.pi)


@dataclass(frozen=True)
class BankRules:
    """Fixed values of the bank of headings."""

    enabled: bool = True
    headings: int = 12
    converged_deg: float = 15.0
    least_m: float = 300.0
    least_fixes: int = 4
    least_weight: float = 1e-4
    heading_walk: float = 0.01
    gyro_scale: float = 0.02
    place_walk: float = 0.5
    along_error: float = 0.03
    handover_scale: float = 2.0


class HeadingBank:
    """A sum of Gaussians over the unknown heading. Each starts with another one, dead-reckons, and coarse fixes weigh it by how near its path comes.

    Arrays hold all of them: means (k, 3) of east, north and heading, covariances (k, 3, 3), logarithms of weights (k,).
    """

    def __init__(self, rules: BankRules = BankRules()):
        self.rules = rules
        self.clear()

    def clear(self) -> None:
        self.plane: _Plane | None = None
        self.way = self.drift = 0.0
        self.fixes = 0

    def clone(self) -> HeadingBank:
        out = _twin(self)
        if self.plane is not None:
            out.means, out.covs, out.logs = self.means.copy(), self.covs.copy(), self.logs.copy()
        return out

    def move(self, dt: float, yaw_rate: float, speed: float, speed_var: float) -> None:
        """yaw_rate counter-clockwise, free of bias. Speed errors last, so the error along the way grows with its square."""
        if self.plane is None or dt <= 0:
            return
        r, step = self.rules, speed * dt
        self.way += abs(step)
        before = self.drift
        self.drift += (math.sqrt(max(speed_var, 0.0)) + r.along_error * abs(speed)) * dt
        toward = np.stack([np.sin(self.means[:, 2]), np.cos(self.means[:, 2])], axis=1)
        lever = np.tile(np.eye(3), (r.headings, 1, 1))
        lever[:, 0, 2], lever[:, 1, 2] = step * toward[:, 1], -step * toward[:, 0]
        self.means[:, :2] += step * toward
        self.means[:, 2] -= yaw_rate * dt
        self.covs = lever @ self.covs @ lever.transpose(0, 2, 1)
        self.covs[:, :2, :2] += (self.drift**2 - before**2) * toward[:, :, None] * toward[:, None, :] + r.place_walk**2 * dt * np.eye(2)
        self.covs[:, 2, 2] += r.heading_walk**2 * dt + (yaw_rate * dt * r.gyro_scale) ** 2

    def fix(self, lat: float, lon: float, spread: float) -> None:
        """A coarse fix with its variance an axis. The first one starts the bank."""
        r = self.rules
        if self.plane is None:
            self.clear()
            self.plane, self.fixes = _Plane(lat, lon), 1
            self.means = np.zeros((r.headings, 3))
            self.means[:, 2] = 2 * np.pi * np.arange(r.headings) / r.headings
            self.covs = np.tile(np.diag([spread, spread, (np.pi / r.headings) ** 2]), (r.headings, 1, 1))
            self.logs = np.zeros(r.headings)
            return
        miss = self.plane.at(lat, lon) - self.means[:, :2]
        both = self.covs[:, :2, :2] + spread * np.eye(2)
        inverse = np.linalg.inv(both)
        self.logs -= 0.5 * np.einsum("ki,kij,kj->k", miss, inverse, miss) + 0.5 * np.log(np.linalg.det(both))
        gain = self.covs[:, :, :2] @ inverse
        self.means += np.einsum("kij,kj->ki", gain, miss)
        keep = np.tile(np.eye(3), (r.headings, 1, 1))
        keep[:, :, :2] -= gain
        self.covs = keep @ self.covs @ keep.transpose(0, 2, 1) + spread * gain @ gain.transpose(0, 2, 1)
        self.logs = np.maximum(self.logs, self.logs.max() + math.log(r.least_weight)) - self.logs.max()
        self.fixes += 1
        self.drift = 0.0

    def mixture(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Mean and covariance of east, north and heading over all."""
        if self.plane is None:
            return None
        w = np.exp(self.logs)
        w /= w.sum()
        mean = w @ self.means
        mean[2] = math.atan2(w @ np.sin(self.means[:, 2]), w @ np.cos(self.means[:, 2]))
        off = self.means - mean
        off[:, 2] = np.pi - (np.pi - off[:, 2]) % (2 * np.pi)
        return mean, np.einsum("k,kij->ij", w, self.covs + off[:, :, None] * off[:, None, :])

    def converged(self) -> bool:
        if self.fixes < self.rules.least_fixes or self.way < self.rules.least_m:
            return False
        return math.degrees(math.sqrt(self.mixture()[1][2, 2])) <= self.rules.converged_deg


@dataclass(frozen=True)
class FilterRules:
    """Fixed values of the filter."""

    course_mps: float = 5.0
    speed_walk: float = 0.7
    #: Without any satellite fix for a while.
    speed_walk_alone: float | None = 1.5
    alone_s: float = 5.0
    pull_away_mps: float = 8.0
    place_walk: float = 0.3
    heading_walk: float = 0.01
    gyro_scale: float = 0.02
    bias_walk: float = 2e-4
    bias_std: float = 0.01
    reset_nis: float = 25.0
    coarse_inflation: float = 1.5
    coarse_useful: float = 0.5
    coarse_s: float = 15.0
    coarse_m: float = 150.0
    coarse_reset_nis: float = 50.0
    robust_nis: float | None = 9.21
    stream_fixes: int = 3
    stream_s: float = 20.0
    stream_k: float = 3.0
    coarse_heading_gain: float = 1.0
    hand_noise: float = 0.5
    hand_floor: float = 0.2
    satellites_recent_s: float = 60.0
    questionable_scale: float | None = None
    use_fused: bool = False
    tracking_s: float = 3.0
    known_speed_std: float = 3.0
    unknown_speed_std: float = 10.0
    scale_std: float = 0.03
    scale_walk: float = 2e-5
    speed_latency_s: float = 0.0
    speed_slope_s: float = 1.5
    # Speed by the accelerometer while the car doesn't tell it.
    accel: bool = True
    accel_obd_s: float = 2.0
    accel_noise: float = 0.8
    accel_bias_std: float = 0.5
    accel_bias_max: float = 0.3
    accel_bias_walk: float = 0.05
    stop_loose: bool = True
    stop_mps: float = 1.5
    stop_no_satellite_s: float = 5.0
    stop_accel: float = 0.3
    rest_s: float = 2.0
    rest_accel: float = 0.5
    rest_std: float = 0.2
    anchor_s: float = 30.0
    anchor_acc_m: float = 200.0
    centripetal: bool = True
    centripetal_s: float = 1.0
    centripetal_rate: float = 0.07
    centripetal_share: float = 0.1
    centripetal_std: float = 0.5
    unsteady_rate: float | None = 0.07
    unsteady_s: float = 60.0
    unsteady_max: float = 4.0
    unsteady_deg: float = 2.0
    bank: BankRules = BankRules()
    #: None: no compass.
    compass: CompassRules | None = CompassRules()


#: Places in the state: east, north, heading, speed, gyroscope bias, speedometer scale, accelerometer bias.
E, N, PSI, V, BIAS, SCALE, ABIAS = range(7)


class _Stray(NamedTuple):
    """A coarse fix far from the prediction, and where the dead-reckoned path was then."""

    t_ns: int
    plane: _Plane
    spread: float
    east: float
    north: float
    way: float


class Filter:
    """An extended Kalman filter over east, north, heading, speed, gyroscope bias, speedometer scale and accelerometer bias.

    The speed acts along the heading only. While the heading is unknown the place isn't moved, but its variance grows by the way that
    might have been driven, and a bank of headings is held against coarse fixes.
    """

    def __init__(self, rules: FilterRules = FilterRules()):
        r = self.rules = rules
        self.x = np.zeros(7)
        self.p = np.diag([1.0, 1.0, math.pi**2, r.unknown_speed_std**2, r.bias_std**2, r.scale_std**2, r.accel_bias_std**2])
        self.plane: _Plane | None = None
        self.known = False  # the heading is
        self.t: int | None = None
        self.yaw = self.shaking = 0.0
        self.along: float | None = None
        self.obd: list[tuple[int, float]] = []
        self.obd_t = self.satellite_t = self.satellite_seen = self.fix_t = None
        self.still, self.still_t = False, None
        self.unsteady: float | None = None
        self.arc = [0.0, 0.0, None]  # integrals of lateral force and yaw rate, and since when
        self.blind = 0.0
        self.way = self.rel_east = self.rel_north = 0.0
        self.coarse: tuple[int, float] | None = None
        self.strays: tuple[_Stray, ...] = ()
        self.bank = HeadingBank(r.bank)
        self.compass = None if r.compass is None else Compass(r.compass)
        self.read_t: int | None = None

    def _since(self, t: int, then: int | None) -> float:
        return math.inf if then is None else (t - then) / 1e9

    # Motion.

    def _accel_ready(self, t: int) -> bool:
        """The car doesn't tell its speed, the forward axis is known, and fixes still bound the speed."""
        r = self.rules
        return r.accel and self.along is not None and self._since(t, self.obd_t) > r.accel_obd_s and self._since(t, self.fix_t) <= r.anchor_s

    def _accel_drives(self, t: int) -> bool:
        return self._accel_ready(t) and (math.sqrt(self.p[ABIAS, ABIAS]) <= self.rules.accel_bias_max or self._since(t, self.satellite_t) <= 2)

    def _unsteady(self) -> float:
        r = self.rules
        return 1.0 if r.unsteady_rate is None or self.unsteady is None else min(max(self.unsteady / r.unsteady_rate, 1.0), r.unsteady_max)

    def _advance(self, t: int) -> None:
        """Moves the state to a time with the last yaw rate and force."""
        dt = 0.0 if self.t is None else (t - self.t) / 1e9
        if self.t is None or dt > 0:
            before, self.t = self.t, t
            if before is not None:
                self._move(dt, before)

    def _move(self, dt: float, t: int) -> None:
        r, x = self.rules, self.x
        _, _, psi, v, bias, _, abias = x.tolist()
        rate = self.yaw - bias
        s, c = math.sin(psi), math.cos(psi)
        self.way += abs(v) * dt
        self.rel_east, self.rel_north = self.rel_east + v * s * dt, self.rel_north + v * c * dt
        f, q = _EYE.copy(), [0.0] * 7
        x[PSI] = _half_turn(psi - rate * dt)
        f[PSI, BIAS] = dt
        hand = r.hand_noise * max(0.0, self.shaking - r.hand_floor)
        q[PSI] = (r.heading_walk**2 + hand**2) * dt + (rate * dt * r.gyro_scale) ** 2
        if self.along is not None and self._accel_drives(t):
            x[V] = v + (self.along - abias) * dt
            f[V, ABIAS] = -dt
            q[V], q[ABIAS] = r.accel_noise**2 * dt, (r.accel_bias_walk * self._unsteady()) ** 2 * dt
        else:
            alone = r.speed_walk_alone is not None and self._since(t, self.satellite_seen) > r.alone_s
            q[V] = (r.speed_walk_alone if alone else r.speed_walk) ** 2 * dt
        q[BIAS], q[SCALE] = r.bias_walk**2 * dt, r.scale_walk**2 * dt
        if self.plane is not None and self.known:
            x[E], x[N] = x[E] + v * s * dt, x[N] + v * c * dt
            f[E, PSI], f[E, V], f[N, PSI], f[N, V] = v * c * dt, s * dt, -v * s * dt, c * dt
            q[E] = q[N] = r.place_walk**2 * dt
        p = f @ self.p @ f.T
        p.ravel()[::8] += q
        self.p = (p + p.T) / 2
        if x[V] < 0 and self.along is not None:
            x[V] = 0.0
        if self.plane is not None and not self.known:
            self.bank.move(dt, self.yaw - x[BIAS], v, self.p[V, V])
            # Any direction: the variance of a disc as wide as the way may have been.
            before = self.blind
            self.blind += (abs(v) + 2 * math.sqrt(self.p[V, V])) * dt
            more = (self.blind**2 - before**2) / 2
            self.p[E, E] += more
            self.p[N, N] += more
        if self.known and self.p[PSI, PSI] > math.pi**2:
            self.known = False
            self.bank.clear()

    def _update(self, h: np.ndarray, miss: np.ndarray | float, noise: float, only: tuple[int, ...] | None = None, damp: dict[int, float] | None = None) -> None:
        """One measurement with rows h. only: the states that it may move; damp: shares of the gain. The form of the covariance holds for any gain, so it stays consistent."""
        h, miss = np.atleast_2d(h), np.atleast_1d(miss)
        if len(h) == 1:
            gain = self.p @ h.T * (1 / (h @ self.p @ h.T + noise))
        else:
            gain = self.p @ h.T @ np.linalg.inv(h @ self.p @ h.T + noise * np.eye(len(h)))
        if only is not None:
            gain[[i for i in range(7) if i not in only]] = 0.0
        for i, share in (damp or {}).items():
            gain[i] *= share
        self.x = self.x + gain @ miss
        self.x[PSI] = _half_turn(self.x[PSI])
        keep = _EYE - gain @ h
        p = keep @ self.p @ keep.T + noise * gain @ gain.T
        self.p = (p + p.T) / 2

    def _scalar(self, i: int, value: float, noise: float, local: bool = False) -> None:
        miss = value - self.x[i]
        self._update(_EYE[i], _half_turn(miss) if i == PSI else miss, noise, (i,) if local else None)

    def _forget(self, i: int, var: float) -> None:
        """State i gets a variance of its own."""
        self.p[i, :] = self.p[:, i] = 0.0
        self.p[i, i] = var

    def on_motion(self, m: Motion) -> None:
        r, t = self.rules, m.t_ns
        self._advance(t)
        self.yaw, self.along, self.shaking = m.yaw_rate, m.along_accel, m.tilt_rms
        if not self.still and not m.still_loose:
            self.unsteady = m.tilt_rms if self.unsteady is None else self.unsteady + (m.tilt_rms - self.unsteady) * min(m.dt_s / r.unsteady_s, 1.0)
        ready, v = self._accel_ready(t), self.x[V]
        may_stop = v - 2 * math.sqrt(self.p[V, V]) < r.stop_mps and v < 2 * r.stop_mps and self._since(t, self.satellite_t) > r.stop_no_satellite_s
        quiet = m.along_accel is None or abs(m.along_accel - self.x[ABIAS]) < r.stop_accel
        still = m.still or ready and r.stop_loose and m.still_loose and may_stop and quiet
        if self.still and not still and not ready:
            # At rest the speed was pinned to 0; without a source it is unknown now.
            self._forget(V, r.unknown_speed_std**2)
            self.x[V] = r.pull_away_mps
        self.still_t = (self.still_t if self.still and self.still_t is not None else t) if still else None
        self.still = still
        if still and ready and (t - self.still_t) / 1e9 >= r.rest_s and m.along_accel is not None and abs(m.along_accel) < r.rest_accel:
            self._scalar(ABIAS, m.along_accel, r.rest_std**2, local=True)
        self._arc(m, ready)
        if still:
            # Only these two move: over long outages their covariances with the place are levers that noise must not pull.
            self._scalar(V, 0.0, 0.05**2, local=True)
            self._scalar(BIAS, m.yaw_rate, 0.003**2, local=True)
        if self.compass is not None:
            self.compass.motion(m, self.x[BIAS])
            if self.read_t is None or t >= self.read_t:
                self.read_t = t + self.compass.rules.period_ns
                if (now := self.compass.reading(t)) is not None:
                    self._steer(now)

    def _steer(self, now: Reading) -> None:
        """A compass reading begins an unknown heading; a known one it moves only if it is worth more, as its errors last for minutes."""
        noise = now.sigma_rad**2
        if not self.known:
            self.x[PSI] = _half_turn(now.bearing_rad)
            self._forget(PSI, noise)
            self.known, self.blind = True, 0.0
            self.bank.clear()
        elif math.sqrt(self.p[PSI, PSI]) >= self.compass.rules.useful * now.sigma_rad and _half_turn(now.bearing_rad - self.x[PSI]) ** 2 / (self.p[PSI, PSI] + noise) <= self.compass.rules.gate_nis:
            self._scalar(PSI, now.bearing_rad, noise)

    def _arc(self, m: Motion, ready: bool) -> None:
        """In turns the lateral force over the yaw rate is a speed."""
        r = self.rules
        if m.left_accel is None:
            return
        if self.arc[2] is None:
            self.arc[2] = m.t_ns
        force, turn, since = self.arc[0] + m.left_accel * m.dt_s, self.arc[1] + m.yaw_rate * m.dt_s, self.arc[2]
        span = (m.t_ns - since) / 1e9
        if span < r.centripetal_s:
            self.arc = [force, turn, since]
            return
        self.arc = [0.0, 0.0, m.t_ns]
        rate = turn / span
        if not r.centripetal or not ready or self.still or self.plane is None or abs(rate) < r.centripetal_rate:
            return
        speed = force / span / rate
        if 1 <= speed <= 40:
            tilt = GRAVITY * math.radians(r.unsteady_deg * (self._unsteady() - 1)) / abs(rate)
            noise = (r.centripetal_share * speed + r.centripetal_std + tilt) ** 2
            if (speed - self.x[V]) ** 2 / (self.p[V, V] + noise) <= 9:
                self._scalar(V, speed, noise)

    # Events.

    def on_event(self, x: Event, state: str | None) -> None:
        if x.kind == "location" and state is not None:
            self._locate(x, state)
        elif self.compass is not None and x.kind == "imu" and None not in (x.x, x.y, x.z):
            self.compass.magnetic(x.event, x.t_ns, (x.x, x.y, x.z))
        elif self.compass is not None and x.kind == "geomag":
            self.compass.reference(x.x, x.y, x.z)
        elif self.compass is not None and x.kind == "power":
            self.compass.power(x.event, bool(x.w))
        elif x.kind == "vehicle_speed" and x.speed_mps is not None:
            r = self.rules
            self._advance(x.t_ns)
            self.obd_t = x.t_ns
            self.obd = [o for o in [*self.obd, (x.t_ns, x.speed_mps)] if (x.t_ns - o[0]) / 1e9 <= r.speed_slope_s]
            value, h = x.speed_mps + r.speed_latency_s * self._slope(), np.zeros(7)
            h[V], h[SCALE] = 1 + self.x[SCALE], self.x[V]
            self._update(h, value - self.x[V] * (1 + self.x[SCALE]), max(x.speed_acc_mps or 0.0, 0.05) ** 2)
            self.x[V] = max(self.x[V], 0.0)

    def _slope(self) -> float:
        """Change of the car's speed, by least squares over its last values."""
        if not self.rules.speed_latency_s or len(self.obd) < 3:
            return 0.0
        t, v = np.array([(a - self.obd[0][0]) / 1e9 for a, _ in self.obd]), np.array([b for _, b in self.obd])
        t -= t.mean()
        return float(t @ (v - v.mean()) / (t @ t)) if t @ t > 1e-6 else 0.0

    def _locate(self, x: Event, state: str) -> None:
        r, t = self.rules, x.t_ns
        if x.source == "GNSS" and state != "UNAVAILABLE" and not x.synthetic:
            self.satellite_seen = t
        if x.synthetic or x.source not in ("GNSS", "NETWORK", *(("FUSED",) if r.use_fused else ())):
            return
        self._advance(t)
        coarse = x.source == "NETWORK"
        scale = 1.0 if state == "TRUSTED" or state == "QUESTIONABLE" and coarse else r.questionable_scale if state == "QUESTIONABLE" else None
        if scale is None or x.h_acc_m is None:
            return
        if x.h_acc_m <= r.anchor_acc_m:
            self.fix_t = t
        spread = (x.h_acc_m / R68_PER_SIGMA * (r.coarse_inflation if coarse else 1.0)) ** 2 * scale
        if self.plane is None:
            self._place(x.lat, x.lon, spread)
            if not coarse:
                self._velocity(x, scale)
                self.satellite_t = t
            return
        if coarse and not self.known and r.bank.enabled:
            self.bank.fix(x.lat, x.lon, spread)
            if self.bank.converged():
                self._take_bank()
                return
        z = self.plane.at(x.lat, x.lon)
        miss = z - self.x[:2]
        nis = float(miss @ np.linalg.inv(self.p[:2, :2] + spread * np.eye(2)) @ miss)
        if not coarse:
            if nis > r.reset_nis and state == "TRUSTED":
                self._place(x.lat, x.lon, spread)
            else:
                self._fuse(miss, spread)
            self._velocity(x, scale)
            self.satellite_t = t
        else:
            spaced = self.coarse is None or (t - self.coarse[0]) / 1e9 >= r.coarse_s and self.way - self.coarse[1] >= r.coarse_m
            if math.sqrt((self.p[E, E] + self.p[N, N]) / 2) < r.coarse_useful * math.sqrt(spread) and not spaced:
                return
            self.coarse = t, self.way
            if r.robust_nis is None:
                self._place(x.lat, x.lon, spread) if nis > r.coarse_reset_nis else self._fuse(miss, spread)
            elif nis <= r.robust_nis:
                self.strays = ()
                self._fuse(miss, spread, coarse=True)
            else:
                self._stray(x, miss, spread, nis)
        self._reanchor()

    def _place(self, lat: float, lon: float, spread: float) -> None:
        self.plane = _Plane(lat, lon)
        self.x[:2] = 0.0
        self._forget(E, spread)
        self._forget(N, spread)
        self.blind = 0.0

    def _fuse(self, miss: np.ndarray, spread: float, coarse: bool = False) -> None:
        damp = {PSI: self.rules.coarse_heading_gain, BIAS: self.rules.coarse_heading_gain} if coarse else None
        self._update(_EYE[:2], miss, spread, damp=damp)
        self.blind = 0.0

    def _velocity(self, x: Event, scale: float) -> None:
        """A satellite fix's speed, and its course above a walking pace; a course far off starts the heading anew."""
        if x.speed_mps is None:
            return
        self._scalar(V, x.speed_mps, max(0.5 if x.speed_acc_mps is None else x.speed_acc_mps, 0.2) ** 2 * scale)
        self.x[V] = max(self.x[V], 0.0)
        if x.bearing_deg is None or x.speed_mps < self.rules.course_mps:
            return
        course = math.radians(x.bearing_deg)
        if scale == 1.0 and self.compass is not None:
            self.compass.calibrate(x.t_ns, course, x.speed_mps, self.yaw)
        noise = math.radians(max(3.0 if x.bearing_acc_deg is None else x.bearing_acc_deg, 1.0)) ** 2 * scale
        if self.known and abs(_half_turn(course - self.x[PSI])) <= math.radians(60):
            self._scalar(PSI, course, noise)
            return
        self.x[PSI] = course
        self._forget(PSI, noise)
        self.known, self.blind = True, 0.0
        self.bank.clear()

    def _take_bank(self) -> None:
        """The bank's heading and place, with their covariance; its places are too sure of themselves, as coarse fixes err alike."""
        mean, cov = self.bank.mixture()
        self.x[:2], self.x[PSI] = self.plane.at(*self.bank.plane.place(*mean[:2])), mean[2]
        for i in (E, N, PSI):
            self._forget(i, 0.0)
        k = np.array([self.rules.bank.handover_scale, self.rules.bank.handover_scale, 1.0])
        self.p[:3, :3] = cov * k[:, None] * k
        self.known, self.blind = True, 0.0
        self.bank.clear()

    def _stray(self, x: Event, miss: np.ndarray, spread: float, nis: float) -> None:
        """One stray fix barely counts; several that lie as far apart as the car drove mean that the estimate is wrong."""
        r = self.rules
        new = _Stray(x.t_ns, _Plane(x.lat, x.lon), spread, self.rel_east, self.rel_north, self.way)
        if self.strays and not self._follows(self.strays[-1], new):
            self.strays = ()
        self.strays = (*self.strays, new)
        if len(self.strays) < r.stream_fixes or (x.t_ns - self.strays[0].t_ns) / 1e9 < r.stream_s:
            self._fuse(miss, spread * nis / r.robust_nis, coarse=True)
            return
        self.strays = ()
        self._place(x.lat, x.lon, spread)
        if r.bank.enabled and self._since(x.t_ns, self.satellite_t) > r.satellites_recent_s:
            self.known = False
            self._forget(PSI, math.pi**2)
            self.bank.clear()
            self.bank.fix(x.lat, x.lon, spread)

    def _follows(self, a: _Stray, b: _Stray) -> bool:
        apart = math.hypot(*a.plane.at(b.plane.lat, b.plane.lon))
        chord = math.hypot(b.east - a.east, b.north - a.north)
        return abs(apart - chord) <= self.rules.stream_k * math.sqrt(a.spread + b.spread) + 0.05 * (b.way - a.way) + 10

    def _reanchor(self) -> None:
        if self.plane is not None and math.hypot(*self.x[:2]) >= REANCHOR_M:
            self.plane = _Plane(*self.plane.place(*self.x[:2]))
            self.x[:2] = 0.0

    def estimate(self, t_ns: int) -> Estimate | None:
        if self.plane is None:
            return None
        then = self
        if self.t is None or t_ns > self.t:
            then = _twin(self)
            then.x, then.p, then.bank = self.x.copy(), self.p.copy(), self.bank.clone()
            then._advance(t_ns)
        r, x, p = self.rules, then.x, then.p
        std = math.sqrt(p[V, V])
        if self._since(t_ns, self.satellite_t) <= r.tracking_s:
            mode = "GNSS_TRACKING"
        else:
            mode = "STATIONARY" if self.still else "DEAD_RECKONING" if then.known and std < r.known_speed_std else "COARSE_ONLY"
        heading = (float(x[PSI]) % (2 * math.pi), math.sqrt(p[PSI, PSI])) if then.known else (None, None)
        return Estimate(t_ns, *map(float, then.plane.place(x[E], x[N])), float(p[E, E]), float(p[E, N]), float(p[N, N]), *heading, float(x[V]), std, mode)


#: Makers of estimators by name; `register` adds more.
ESTIMATORS: dict[str, Callable[[], Estimator]] = {"passthrough": HoldLastFix, "baseline": Filter, "baseline-no-compass": lambda: Filter(FilterRules(compass=None))}


def register(name: str, make: Callable[[], Estimator]) -> None:
    """An estimator for drive_fold by name. make is called once a drive, in the task that folds it."""
    ESTIMATORS[name] = make


def filter_of(**changes: object) -> Callable[[], Estimator]:
    """A maker of filters with other rules."""
    rules = replace(FilterRules(), **changes)
    return lambda: Filter(rules)
