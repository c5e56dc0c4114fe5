"""A compass for a phone fixed in a car, whose own magnetism is far stronger than the field: what turns with the car is the field, what stays is the car.

Horizontal field points are binned by the gyroscope's bearing. A circle or an ellipse through the bins tells the car's part; alignment with
satellite courses, or the car's forward axis and the declination, tells which way is north. Gates and a verdict on the mount keep bad readings out.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivelake.streaming.batches import rows_of
from drivelake.streaming.tracker import Motion, Tracker, Vec, _cross, _dot, _flat, _norm, _toward, _unit

BINS, BIN_MOST, ALIGN_MOST, LEAST_IN_BIN = 36, 400.0, 300, 10


@dataclass(frozen=True)
class CompassRules:
    """Time constants, tolerances, and what each weakness adds to the error of a reading (degrees)."""

    smooth_s: float = 0.2
    fresh_ns: int = 300_000_000
    radius_share: float = 0.1
    vertical_ut: float = 3.0
    vertical_rows: int = 50
    vertical_step: float = 0.02
    holdoff_s: float = 3.0
    magnitude_share: float = 0.3
    turn_deg: float = 10.0
    turn_s: float = 2.0
    circle_octants: int = 4
    ellipse_octants: int = 6
    align_mps: float = 7.0
    align_rate: float = 0.05
    align_least: int = 10
    least_deg: float = 5.0
    circle_deg: float = 5.0
    beyond_deg: float = 5.0
    forward_deg: float = 15.0
    uncorrected_deg: float = 35.0
    no_declination_deg: float = 10.0
    useful: float = 1.0
    four_octants_deg: float = 25.0
    five_octants_deg: float = 10.0
    gate_nis: float = 9.0
    period_ns: int = 1_000_000_000
    tilt_rms: float = 0.15
    tilt_rms_steady: float = 1.2
    horizontal_accel: float = 1.0
    marginal_deg: float = 10.0
    moving_s: float = 60.0
    saturated_ut: float = 200.0
    saturated_rows: int = 20
    centre_ns: int = 10_000_000_000
    centres_ns: int = 300_000_000_000
    axes_ratio: float = 2.0


class Iron(NamedTuple):
    """The car's part: centre, and the symmetric matrix that makes the ellipse a circle of `radius` around it."""

    centre: np.ndarray
    shape: np.ndarray
    radius: float
    ellipse: bool

    def corrected(self, points: np.ndarray) -> np.ndarray:
        return (points - self.centre) @ self.shape


def fit_circle(points: np.ndarray) -> Iron | None:
    """Least squares of x^2 + y^2 = 2 a x + 2 b y + c; None below three points or on a line."""
    if len(points) < 3:
        return None
    middle = points.mean(0)
    p = points - middle
    rows = np.column_stack([2 * p, np.ones(len(p))])
    (a, b, c), _, rank, _ = np.linalg.lstsq(rows, (p * p).sum(1), rcond=1e-9)
    square = c + a * a + b * b
    return Iron(middle + [a, b], np.eye(2), math.sqrt(square), False) if rank == 3 and square > 0 else None


def fit_ellipse(points: np.ndarray, ratio: float = CompassRules.axes_ratio) -> Iron | None:
    """Least squares of A x^2 + B x y + C y^2 + D x + E y = 1 around the mean. None if that is no ellipse, or one of axes beyond a ratio, which tells of bad data."""
    if len(points) < 6:
        return None
    middle = points.mean(0)
    x, y = (points - middle).T
    (a, b, c, d, e), _, rank, _ = np.linalg.lstsq(np.column_stack([x * x, x * y, y * y, x, y]), np.ones(len(x)), rcond=1e-12)
    det = 4 * a * c - b * b
    if rank < 5 or a <= 0 or c <= 0 or det <= 0:
        return None
    centre = np.array([b * e - 2 * c * d, b * d - 2 * a * e]) / det
    form = np.array([[a, b / 2], [b / 2, c]])
    level = 1 + centre @ form @ centre
    if level <= 0:
        return None
    values, axes = np.linalg.eigh(form / level)
    if values[0] <= 0 or math.sqrt(values[1] / values[0]) > ratio:
        return None
    radius = float(np.prod(values)) ** -0.25
    return Iron(middle + centre, axes @ np.diag(np.sqrt(values)) @ axes.T * radius, radius, True)


class Reading(NamedTuple):
    bearing_rad: float
    sigma_rad: float
    mode: str


class Quality(NamedTuple):
    """verdict UNKNOWN, USABLE, MARGINAL or UNUSABLE, with its reasons; what isn't known is None."""

    verdict: str
    reasons: tuple[str, ...]
    fit: str
    octants: int
    radius_ratio: float | None
    scatter_deg: float | None
    drift_ratio: float | None
    hard_iron_ut: float | None
    dirty: float | None
    shaky: float | None
    tilt_rms: float | None
    align_rms_deg: float | None
    saturated: bool
    wireless: bool
    mount: int


class _Field:
    """One magnetic sensor: its smoothed vector, and the running signed median of its vertical part."""

    def __init__(self) -> None:
        self.t: int | None = None
        self.now: Vec | None = None
        self.median, self.n = 0.0, 0

    def take(self, t: int, v: Vec, smooth_s: float) -> None:
        self.now = v if self.now is None else _toward(self.now, v, 1 - math.exp(-min(max((t - self.t) / 1e9, 0.0), 1.0) / smooth_s))
        self.t = t

    def off(self, up: Vec, rules: CompassRules) -> bool:
        """Whether the vertical part jumps. The first rows make a mean, from which later ones move the median by small steps."""
        v = _dot(self.now, up)
        self.n += 1
        if self.n <= rules.vertical_rows:
            self.median += (v - self.median) / self.n
            return False
        jumps = abs(v - self.median) > rules.vertical_ut
        self.median += rules.vertical_step * ((v > self.median) - (v < self.median))
        return jumps


#: Trait, limits of MARGINAL and UNUSABLE, and the reason's code.
_LIMITS = (("scatter_deg", 8, 20, "NOISY_FIT"), ("drift_ratio", 0.2, 0.5, "UNSTABLE_DISTORTION"), ("hard_iron_ut", 200, math.inf, "LARGE_HARD_IRON"), ("dirty", 0.3, 0.6, "OFTEN_DISTURBED"), ("shaky", 0.3, 0.7, "SHAKY_MOUNT"), ("align_rms_deg", 10, 25, "GNSS_DISAGREES"))


class Compass:
    """The state of one drive."""

    def __init__(self, rules: CompassRules = CompassRules()):
        self.rules = rules
        self.raw, self.mild = _Field(), _Field()  # uncalibrated, and with the phone's own correction
        self.declination = self.inclination = self.field = None
        self.up: Vec | None = None
        self.same = [0, 0, 0]
        self.before: Vec = (0.0, 0.0, 0.0)
        self.saturated = self.wireless = False
        self.mount = -1
        self.bearing = 0.0
        self.align_rms: float | None = None
        self.t = 0
        self._start(-1)

    def _start(self, mount: int) -> None:
        """A new mount: nothing learned holds any more."""
        self.mount, self.axis, self.forward, self.uses_raw, self.jumped = mount, None, None, None, None
        self.moving = self.dirty = self.shaken = 0
        self.tilts, self.shaky = 0.0, False
        self.raw.n = self.mild.n = 0
        self.raw.median = self.mild.median = 0.0
        self.centres: deque[tuple[int, float, float]] = deque()
        self.bins, self.counts = np.zeros((BINS, 2)), np.zeros(BINS)
        self.iron: Iron | None = None
        self.stale = False
        self.aligned: deque[tuple[float, float, float]] = deque(maxlen=ALIGN_MOST)
        self.align_rms = None
        self.recent: deque[tuple[int, float, float]] = deque()

    # Input.

    def magnetic(self, kind: str, t: int, v: Vec) -> None:
        if kind == "MAG_UNCAL":
            # A clipped axis gives the very same large value again and again.
            self.same = [n + 1 if abs(a) > self.rules.saturated_ut and a == b else 0 for n, a, b in zip(self.same, v, self.before)]
            self.before = v
            self.saturated |= max(self.same) >= self.rules.saturated_rows
            self.raw.take(t, v, self.rules.smooth_s)
        elif kind == "MAG":
            self.mild.take(t, v, self.rules.smooth_s)

    def reference(self, declination_deg: float | None, inclination_deg: float | None, field_ut: float | None) -> None:
        self.declination, self.inclination, self.field = declination_deg, inclination_deg, field_ut

    def power(self, plug: str | None, charging: bool) -> None:
        self.wireless |= plug == "WIRELESS" and charging

    def _stream(self, t: int) -> _Field | None:
        """The sensor in use: the uncalibrated one if there is one when a mount begins."""
        fresh = lambda s: s.t is not None and t - s.t <= self.rules.fresh_ns
        if self.uses_raw is None:
            if not fresh(self.raw) and not fresh(self.mild):
                return None
            self.uses_raw = fresh(self.raw)
        s = self.raw if self.uses_raw else self.mild
        return s if fresh(s) else None

    def _clean(self, t: int, s: _Field | None) -> bool:
        return s is not None and s.n >= self.rules.vertical_rows and (self.jumped is None or t - self.jumped > self.rules.holdoff_s * 1e9)

    def _flat_point(self, s: _Field) -> np.ndarray | None:
        """The horizontal field in two axes that are fixed in the phone."""
        if self.up is None:
            return None
        if self.axis is None:
            self.axis = _unit(_flat((1.0, 0.0, 0.0) if abs(self.up[0]) < 0.9 else (0.0, 1.0, 0.0), self.up))
        flat = _flat(s.now, self.up)
        return np.array([_dot(flat, self.axis), _dot(flat, _cross(self.up, self.axis))])

    def motion(self, m: Motion, bias: float = 0.0) -> None:
        r, t = self.rules, m.t_ns
        if m.mount != self.mount:
            self._start(m.mount)
        self.up, self.forward, self.t = m.up or self.up, m.forward, t
        self.bearing -= (m.yaw_rate - bias) * m.dt_s
        self.shaky = m.tilt_rms > (r.tilt_rms_steady if m.steady_up else r.tilt_rms) or not m.steady_up and m.horizontal_accel > r.horizontal_accel
        s = self._stream(t)
        if s is not None and self.up is not None and s.off(self.up, r):
            self.jumped = t
        clean = self._clean(t, s)
        if not m.still:
            self.moving, self.tilts = self.moving + 1, self.tilts + m.tilt_rms
            self.shaken += self.shaky
            self.dirty += s is not None and not clean
        if clean and not self.shaky and (p := self._flat_point(s)) is not None:
            b = min(int(self.bearing % (2 * math.pi) / (2 * math.pi) * BINS), BINS - 1)
            if self.counts[b] >= BIN_MOST:
                self.bins[b] *= (BIN_MOST - 1) / BIN_MOST
                self.counts[b] *= (BIN_MOST - 1) / BIN_MOST
            self.bins[b] += p
            self.counts[b] += 1
            self.stale = True
        if (now := self._candidate(t)) is not None:
            self.recent.append((t, now.bearing_rad, self.bearing))
        while self.recent and self.recent[0][0] < t - (r.turn_s + 1) * 1e9:
            self.recent.popleft()

    def calibrate(self, t: int, course_rad: float, speed_mps: float, yaw_rate: float) -> None:
        """A trusted course while driving straight on."""
        s = self._stream(t)
        if speed_mps < self.rules.align_mps or abs(yaw_rate) > self.rules.align_rate or self.shaky or not self._clean(t, s) or (p := self._flat_point(s)) is None:
            return
        if self.iron is None or self._fits(p):
            self.aligned.append((*p.tolist(), course_rad))

    # Output.

    def _points(self) -> np.ndarray:
        full = self.counts >= LEAST_IN_BIN
        return self.bins[full] / self.counts[full, None]

    def octants(self) -> int:
        return len(set((np.flatnonzero(self.counts >= LEAST_IN_BIN) * 8 // BINS).tolist()))

    def _fits(self, p: np.ndarray) -> bool:
        return abs(math.hypot(*self.iron.corrected(p)) - self.iron.radius) <= self.rules.radius_share * self.iron.radius

    def _refit(self) -> None:
        if not self.stale:
            return
        self.stale, r, n, points = False, self.rules, self.octants(), self._points()
        self.iron = fit_circle(points) if n >= r.circle_octants else None
        if self.iron is not None and n >= r.ellipse_octants:
            spread = {min(int((math.atan2(y, x) + math.pi) / (2 * math.pi) * 8), 7) for x, y in points - self.iron.centre}
            if len(spread) >= r.ellipse_octants:
                self.iron = fit_ellipse(points, r.axes_ratio) or self.iron
        if self.iron is not None and n >= 5 and (not self.centres or self.t - self.centres[-1][0] >= r.centre_ns):
            self.centres.append((self.t, *self.iron.centre.tolist()))
            while self.centres[0][0] < self.t - r.centres_ns:
                self.centres.popleft()

    def quality(self) -> Quality:
        self._refit()
        f, enough = self.iron, self.moving * 0.05 >= self.rules.moving_s
        expected = None if None in (self.field, self.inclination) else self.field * math.cos(math.radians(self.inclination))
        seen: dict[str, float | None] = dict.fromkeys(("radius_ratio", "scatter_deg", "drift_ratio", "hard_iron_ut", "dirty", "shaky", "tilt_rms", "align_rms_deg"))
        if f is not None:
            seen["radius_ratio"] = f.radius / expected if expected and expected > 0 else None
            off = np.hypot(*f.corrected(self._points()).T) - f.radius
            seen["scatter_deg"] = math.degrees(math.sqrt(float(np.mean(off * off))) / f.radius) if len(off) >= 3 else None
            seen["hard_iron_ut"] = math.hypot(*f.centre)
            if len(self.centres) >= 3:
                c = np.array([x[1:] for x in self.centres])
                seen["drift_ratio"] = float(np.hypot(*(c[:, None] - c[None]).transpose(2, 0, 1)).max()) / f.radius
        if self.moving:
            seen |= {"dirty": self.dirty / self.moving if enough else None, "shaky": self.shaken / self.moving if enough else None, "tilt_rms": self.tilts / self.moving}
        seen["align_rms_deg"] = None if self.align_rms is None else math.degrees(self.align_rms)
        reasons = ["SATURATED"] if self.saturated else []
        worst = 2 if self.saturated else 0
        if (ratio := seen["radius_ratio"]) is not None and not 0.6 <= ratio <= 1.7:
            reasons.append("WEAK_FIELD" if ratio < 1 else "STRONG_FIELD")
            worst = max(worst, 1 if 0.3 <= ratio <= 3 else 2)
        for name, marginal, bad, code in _LIMITS:
            if code == "GNSS_DISAGREES" and self.wireless:
                reasons.append("WIRELESS_CHARGING")
                worst = max(worst, 1)
            if seen[name] is not None and seen[name] > marginal:
                reasons.append(code)
                worst = max(worst, 2 if seen[name] > bad else 1)
        verdict = "UNUSABLE" if worst == 2 else "UNKNOWN" if f is None else "MARGINAL" if worst else "USABLE"
        return Quality(verdict, tuple(reasons), "none" if f is None else "ellipse" if f.ellipse else "circle", self.octants(), *seen.values(), self.saturated, self.wireless, self.mount)

    def _candidate(self, t: int) -> Reading | None:
        """The heading without the gates of turns and quality."""
        self._refit()
        r, s, fit = self.rules, self._stream(t), self.iron
        if fit is None or s is None or self.up is None:
            # Nothing fitted: the phone's own correction, if its field is as strong as it should be.
            now = self.mild.now if self.mild.t is not None and t - self.mild.t <= r.fresh_ns else None
            if now is None or self.forward is None or self.up is None or self.field is None or abs(_norm(now) - self.field) > r.magnitude_share * self.field:
                return None
            return self._by_forward(_unit(_flat(now, self.up)), r.uncorrected_deg, "UNCORRECTED")
        p = self._flat_point(s)
        if not self._fits(p):
            return None
        q, n = fit.corrected(p), self.octants()
        if len(self.aligned) < r.align_least:
            if self.forward is None:
                return None
            across = _cross(self.up, self.axis)
            north = _unit(tuple(a * q[0] + b * q[1] for a, b in zip(self.axis, across)))
            weak = (0 if fit.ellipse else r.circle_deg) + (r.four_octants_deg if n <= 4 else r.five_octants_deg if n == 5 else 0)
            return self._by_forward(north, r.forward_deg + weak, "FORWARD_ALIGNED")
        known = np.array(self.aligned)
        c = fit.corrected(known[:, :2])
        gaps = known[:, 2] - np.arctan2(c[:, 1], c[:, 0])
        turn = math.atan2(np.sin(gaps).sum(), np.cos(gaps).sum())
        half = lambda a: np.pi - (np.pi - a) % (2 * np.pi)
        self.align_rms = math.sqrt(float(np.mean(half(gaps - turn) ** 2)))
        heading = math.atan2(q[1], q[0]) + turn
        sigma = max(r.least_deg, 1.5 * math.degrees(self.align_rms)) + (0 if fit.ellipse else r.circle_deg) + (r.five_octants_deg if n <= 4 else 0)
        if not (np.abs(half(known[:, 2] - heading)) < math.pi / 4).any():
            sigma += r.beyond_deg
        return Reading(heading % (2 * math.pi), math.radians(sigma), "GNSS_ALIGNED")

    def _by_forward(self, north: Vec | None, sigma_deg: float, mode: str) -> Reading | None:
        if north is None:
            return None
        bearing = math.atan2(_dot(self.forward, _cross(north, self.up)), _dot(self.forward, north)) + math.radians(self.declination or 0.0)
        return Reading(bearing % (2 * math.pi), math.radians(sigma_deg + (self.rules.no_declination_deg if self.declination is None else 0)), mode)

    def _turns_with_car(self) -> bool:
        """Whether the compass has lately turned as the gyroscope has."""
        r = self.rules
        if len(self.recent) < 2:
            return False
        end = self.recent[-1]
        start = next((x for x in self.recent if x[0] >= end[0] - r.turn_s * 1e9), end)
        turned = (end[1] - start[1]) - (end[2] - start[2])
        return end[0] - start[0] >= 0.7 * r.turn_s * 1e9 and abs(math.pi - (math.pi - turned) % (2 * math.pi)) <= math.radians(r.turn_deg)

    def reading(self, t: int) -> Reading | None:
        """The heading now, or None where it can't be relied on."""
        s = self._stream(t)
        if self.shaky or not self._turns_with_car() or s is not None and not self._clean(t, s):
            return None
        q = self.quality()
        now = None if q.verdict == "UNUSABLE" else self._candidate(t)
        return now._replace(sigma_rad=now.sigma_rad + math.radians(self.rules.marginal_deg)) if now is not None and q.verdict == "MARGINAL" else now


#: A row a second of a drive's compass; verdict and the traits behind it are those at that time.
REPORT = (
    "t_ns long, t_s double, moving boolean, later_half boolean, verdict string, reasons string, fit string, mode string, bearing_deg double, sigma_deg double, course_deg double, err_deg double, tilt_rms double, "
    "horizontal_accel double, raw_ut double, plug string, mount long, octants int, radius_ratio double, scatter_deg double, drift_ratio double, hard_iron_ut double, dirty double, shaky double, align_rms_deg double, saturated boolean, wireless boolean"
)
_REPORT = [c.split(" ") for c in REPORT.split(", ")]


def compass_rows(imu: DataFrame, truth: DataFrame, geomag: DataFrame | None = None, power: DataFrame | None = None, rules: CompassRules = CompassRules(), max_gap_s: float = 3.0) -> DataFrame:
    """How well the compass of each drive would do: drive_id and REPORT, a row a second.

    imu has all sensors; truth (drive_id, t_ns, bearing_deg, speed_mps) is used for alignment in the first half of a drive only, so errors in the second
    are of a compass that hasn't seen their truth. Samples stream through a task; of a drive its truth is held. Drives without motion have no rows; nulls in
    truth make it unknown there.
    """
    blank = F.lit(None)
    wanted = {"what": "string", "rank": "int", "sub": "string", "a": "double", "b": "double", "c": "double"}

    def rows(df: DataFrame, **values) -> DataFrame:
        return df.filter("drive_id IS NOT NULL AND t_ns IS NOT NULL").select("drive_id", "t_ns", *(values.get(n, blank).cast(t).alias(n) for n, t in wanted.items()))

    spans = imu.groupBy("drive_id").agg(F.min("t_ns").alias("t_ns"), F.max("t_ns").alias("end"))
    every = rows(spans, what=F.lit("span"), rank=F.lit(-2), a=F.col("end") - F.col("t_ns"))
    every = every.unionByName(rows(truth, what=F.lit("truth"), rank=F.lit(-1), a=F.col("bearing_deg"), b=F.col("speed_mps")))
    every = every.unionByName(rows(imu, what=F.lit("imu"), rank=F.lit(3), sub=F.col("kind"), a=F.col("x"), b=F.col("y"), c=F.col("z")))
    if geomag is not None:
        every = every.unionByName(rows(geomag, what=F.lit("geomag"), rank=F.lit(10), a=F.col("declination_deg"), b=F.col("inclination_deg"), c=F.col("field_ut")))
    if power is not None:
        every = every.unionByName(rows(power, what=F.lit("power"), rank=F.lit(11), sub=F.col("plug"), a=F.col("charging").cast("double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drive, report = None, None
        for batch in batches:
            out = []
            for key, t, what, sub, a, b, c in rows_of(batch):
                if report is None or key != drive:
                    drive, report = key, _Report(rules, max_gap_s)
                if (row := report.take(t, what, sub, a, b, c)) is not None:
                    out.append((key, *row))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * (len(_REPORT) + 1), [batch.schema.field(0).type, *(_ARROW[k] for _, k in _REPORT)])], ["drive_id", *(n for n, _ in _REPORT)])

    kind = imu.schema["drive_id"].dataType.simpleString()
    held = every.withColumn("first", F.greatest("rank", F.lit(0)) > 0)
    ordered = held.repartition("drive_id").sortWithinPartitions("drive_id", "first", F.when(F.col("first"), 0).otherwise(F.col("rank")), "t_ns", "rank", "sub", "a", "b", "c")
    return ordered.select("drive_id", "t_ns", "what", "sub", "a", "b", "c").mapInArrow(run, f"drive_id {kind}, {REPORT}")


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


class _Report:
    """One drive's compass against its truth."""

    def __init__(self, rules: CompassRules, max_gap_s: float):
        self.compass, self.tracker, self.gap = Compass(rules), Tracker(), max_gap_s
        self.truth: list[tuple[int, float, float]] = []
        self.start = self.half = self.next = 0
        self.rest, self.rests = 0.0, 0
        self.raw = self.plug = None
        self.raw_kind = ""

    def _course(self, t: int) -> tuple[float, float] | None:
        """Bearing (degrees) and speed of the truth at a time, between its samples."""
        i = bisect_right(self.truth, (t, math.inf)) - 1
        if i < 0:
            return None
        t0, b0, v0 = self.truth[i]
        if t0 == t:
            return b0, v0
        if i + 1 == len(self.truth) or self.truth[i + 1][0] - t0 > self.gap * 1e9:
            return None
        t1, b1, v1 = self.truth[i + 1]
        u = (t - t0) / (t1 - t0)
        return (b0 + u * ((b1 - b0 + 180) % 360 - 180)) % 360, v0 + u * (v1 - v0)

    def take(self, t: int, what: str, sub: str | None, a: float | None, b: float | None, c: float | None) -> tuple | None:
        if what == "span":
            self.start, self.half, self.next = t, t + int(a) // 2, t
        elif what == "truth":
            if None not in (a, b) and (not self.truth or self.truth[-1][0] < t):
                self.truth.append((t, a, b))
        elif what == "geomag":
            self.compass.reference(a, b, c)
        elif what == "power":
            self.compass.power(sub, bool(a))
            self.plug = sub
        elif None not in (a, b, c):
            self.compass.magnetic(sub, t, (a, b, c))
            if sub == "MAG_UNCAL" or sub == "MAG" and self.raw_kind != "MAG_UNCAL":
                self.raw, self.raw_kind = math.sqrt(a * a + b * b + c * c), sub
            if (m := self.tracker.take("imu", t, sub, a, b, c)) is not None:
                return self._moved(m)
        return None

    def _moved(self, m: Motion) -> tuple | None:
        if m.still:
            self.rest, self.rests = self.rest + m.yaw_rate, self.rests + 1
        self.compass.motion(m, self.rest / self.rests if self.rests else 0.0)
        told = self._course(m.t_ns)
        course = told[0] if told is not None and told[1] > 3 else None
        if m.t_ns < self.half and course is not None and told[1] > self.compass.rules.align_mps:
            self.compass.calibrate(m.t_ns, math.radians(course), told[1], m.yaw_rate)
        if m.t_ns < self.next:
            return None
        self.next = m.t_ns + 1_000_000_000
        now, q = self.compass.reading(m.t_ns), self.compass.quality()
        bearing = None if now is None else math.degrees(now.bearing_rad)
        err = None if now is None or course is None else abs((bearing - course + 180) % 360 - 180)
        return (
            m.t_ns, (m.t_ns - self.start) / 1e9, not m.still, m.t_ns >= self.half, q.verdict, "|".join(q.reasons), q.fit, now and now.mode, bearing, now and math.degrees(now.sigma_rad), course, err, m.tilt_rms, m.horizontal_accel,
            self.raw, self.plug, m.mount, q.octants, q.radius_ratio, q.scatter_deg, q.drift_ratio, q.hard_iron_ut, q.dirty, q.shaky, q.align_rms_deg, q.saturated, q.wireless,
        )


def compass_summary(rows: DataFrame) -> DataFrame:
    """One row a drive of compass_rows: the last verdict, reasons and fit, mounts, the share of moving seconds of the second half that have a reading, and their errors."""
    counted = F.col("later_half") & F.col("moving") & F.col("course_deg").isNotNull()
    err = F.when(F.col("later_half"), F.col("err_deg"))
    last = F.max_by(F.struct("verdict", "reasons", "fit", "octants", "saturated", "wireless"), "t_ns")
    return rows.groupBy("drive_id").agg(
        last.alias("q"), (F.max("mount") + 1).alias("mounts"), (F.count_if(counted & F.col("mode").isNotNull()) / F.nullif(F.count_if(counted), F.lit(0))).alias("availability"), F.count(err).alias("n_errors"),
        F.percentile(err, 0.5).alias("p50_deg"), F.percentile(err, 0.95).alias("p95_deg"), F.avg(F.when(err.isNotNull(), (err <= 2 * F.col("sigma_deg")).cast("double"))).alias("within_2sigma"),
    ).select("drive_id", "q.*", "mounts", "availability", "n_errors", "p50_deg", "p95_deg", "within_2sigma")
