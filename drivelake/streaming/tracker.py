"""Vehicle motion from a phone's inertial sensors: one step for each sample, over sorted partitions in batch and over keyed state in a stream.

The up direction is carried by the gyroscope and pulled back by the accelerometer while the car is quiet; the yaw rate about it, rest, the
car's forward axis (from turns), new mounts, and a dead-reckoned path come out every 50 ms. Recursions with irregular steps and events that
clear them aren't window frames, so this is a fold; what comes out are rows, on which times between are windows (path_at).
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drivelake.streaming.batches import rows_of
from drivelake.streaming.keyed import keyed_stream

Vec = tuple[float, float, float]


@dataclass(frozen=True)
class MotionRules:
    """Rates, time constants and thresholds."""

    period_ns: int = 50_000_000
    window_ns: int = 1_000_000_000
    gravity_s: float = 5.0
    still_accel: float = 0.12
    still_gyro: float = 0.03
    loose_accel: float = 0.3
    loose_gyro: float = 0.02
    loose_bridge_s: float = 1.5
    least_samples: int = 10
    history_ns: int = 600_000_000_000
    orientation_ns: int = 500_000_000
    turn_rate: float = 0.08
    turn_accel: float = 0.4
    axis_samples: int = 1000
    axis_concentration: float = 0.6
    accel_fresh_ns: int = 50_000_000
    remount_rad: float = 0.35
    remount_ns: int = 3_000_000_000
    shake_ns: int = 500_000_000
    speed_age_ns: int = 1_500_000_000
    #: None: no gyroscope-carried up; the rotation vector or slow gravity stand for it.
    up_s: float | None = 30.0
    gate_accel: float = 0.3
    gate_yaw: float = 0.05
    gate_horizontal: float = 0.5
    yaw_s: float = 0.5
    norm_s: float = 120.0
    still_up_s: float | None = 3.0
    still_least_s: float = 3.0
    still_speed: float = 1.5
    still_onset: float = 0.15


class Motion(NamedTuple):
    """What comes out at a time: yaw rate about up (counter-clockwise, rad/s), rest, axes in the phone's frame, shaking, specific force
    along and to the left of the car, and the path since the start (bearing clockwise from an arbitrary one, east, north, way, gaps)."""

    t_ns: int
    dt_s: float
    yaw_rate: float
    still: bool
    still_s: float
    gyro_mean: float
    accel_std: float | None
    up: Vec | None
    forward: Vec | None
    mount: int
    tilt_rms: float
    horizontal_accel: float
    steady_up: bool
    along_accel: float | None
    left_accel: float | None
    still_loose: bool
    bearing: float
    east_m: float
    north_m: float
    way_m: float
    gaps: int


def _dot(a: Vec, b: Vec) -> float:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _norm(a: Vec) -> float:
    x, y, z = a
    return math.sqrt(x * x + y * y + z * z)


def _toward(a: Vec, b: Vec, share: float) -> Vec:
    return a[0] + (b[0] - a[0]) * share, a[1] + (b[1] - a[1]) * share, a[2] + (b[2] - a[2]) * share


def _unit(a: Vec) -> Vec | None:
    x, y, z = a
    n = math.sqrt(x * x + y * y + z * z)
    return None if n < 1e-9 else (x / n, y / n, z / n)


def _cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _flat(a: Vec, up: Vec) -> Vec:
    """The part of a that is perpendicular to up."""
    k = _dot(a, up)
    return a[0] - k * up[0], a[1] - k * up[1], a[2] - k * up[2]


class _Recent:
    """Values of a sliding time window, with their sum and sum of squares about a first guess."""

    def __init__(self, span_ns: int):
        self.span, self.rows, self.base, self.sum, self.squares = span_ns, deque(), 0.0, 0.0, 0.0

    def add(self, t: int, v: float) -> None:
        rows = self.rows
        if not rows:
            self.base, self.sum, self.squares = v, 0.0, 0.0
        rows.append((t, v))
        base, since = self.base, t - self.span
        off = v - base
        total, squares = self.sum + off, self.squares + off**2
        while rows[0][0] < since:
            off = rows.popleft()[1] - base
            total -= off
            squares -= off**2
        self.sum, self.squares = total, squares

    def mean(self) -> float:
        return self.base + self.sum / len(self.rows) if self.rows else 0.0

    def std(self) -> float | None:
        n = len(self.rows)
        return math.sqrt(max(0.0, (self.squares - self.sum * self.sum / n) / (n - 1))) if n > 1 else None


class Tracker:
    """The state of one drive. `take` a sample, get a Motion when one is due. Samples without a number are left out."""

    def __init__(self, rules: MotionRules = MotionRules()):
        self.rules = rules
        #: The estimator's speed, where there is one: lets up follow the accelerometer quickly at stops.
        self.speed_hint: float | None = None
        self.gravity: Vec | None = None
        self.tilted: tuple[int, Vec] | None = None  # up by the rotation vector
        self.accel: tuple[int, Vec] | None = None
        self.carried: Vec | None = None  # up by the gyroscope
        self.quick = self.slow = None  # smoothed specific force
        self.norm: float | None = None
        self.turning = False  # a gyroscope sample has come
        self.gyro_t: int | None = None
        self.calibrated = False
        self.yaw = 0.0
        self.force, self.forces = (0.0, 0.0, 0.0), 0
        self.turned, self.turned_s = 0.0, 0.0
        self.accels, self.gyros, self.shakes = _Recent(self.rules.window_ns), _Recent(self.rules.window_ns), _Recent(self.rules.shake_ns)
        self.tilts: deque[tuple[int, Vec]] = deque()
        self.tilt: Vec = (0.0, 0.0, 0.0)
        self.mount, self.mounted = 0, None
        self.left, self.left_weight, self.left_n = (0.0, 0.0, 0.0), 0.0, 0
        self.emitted: int | None = None
        self.still_since: int | None = None
        self.loose, self.loose_since, self.loose_last = False, None, None
        self.car: tuple[int, float] | None = None
        self.bearing = self.east = self.north = self.way = 0.0
        self.gaps = 0
        self.latest: Motion | None = None
        self.path: list[tuple[int, float, float, float, float, int]] = []

    def take(self, kind: str, t: int, sub: str | None, x: float | None, y: float | None = None, z: float | None = None, w: float | None = None) -> Motion | None:
        """A sample: kind imu (sub ACCEL, GYRO, GYRO_UNCAL; others pass), orientation (sub a rotation vector; x, y, z, w) or vehicle_speed (x)."""
        if kind == "imu" and sub in ("ACCEL", "GYRO", "GYRO_UNCAL"):
            if x is None or y is None or z is None:
                return None
            if sub == "ACCEL":
                self._accelerate(t, (x, y, z))
                return None
            if sub == "GYRO":
                self.calibrated = True
            elif self.calibrated:
                return None
            return self._rotate(t, (x, y, z))
        if kind == "orientation" and sub in ("GAME_ROTATION_VECTOR", "ROTATION_VECTOR") and None not in (x, y, z, w):
            # What the world calls up, in the phone's frame: the last row of the quaternion's matrix.
            self.tilted = t, (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))
        elif kind == "vehicle_speed" and x is not None:
            self.car = t, x
        return None

    def _accelerate(self, t: int, a: Vec) -> None:
        r = self.rules
        dt = 0.01 if self.accel is None else min(max((t - self.accel[0]) / 1e9, 0.0), 0.5)
        self.gravity = a if self.gravity is None else _toward(self.gravity, a, 1 - math.exp(-dt / r.gravity_s))
        self.accel = t, a
        self.force, self.forces = (self.force[0] + a[0], self.force[1] + a[1], self.force[2] + a[2]), self.forces + 1
        size = _norm(a)
        if r.up_s is not None:
            self._correct_up(t, a, size, dt)
        self.accels.add(t, size)

    def _correct_up(self, t: int, a: Vec, size: float, dt: float) -> None:
        """Pulls the carried up toward the smoothed specific force, only while that can hardly be anything but gravity."""
        r = self.rules
        self.quick = a if self.quick is None else _toward(self.quick, a, 0.1)
        self.slow = a if self.slow is None else _toward(self.slow, a, min(dt, 1.0))
        self.norm = size if self.norm is None else self.norm + (size - self.norm) * (dt / r.norm_s)
        if self.carried is None:
            self.carried = _unit(self.quick)
            return
        if not self.turning or abs(self.yaw) >= r.gate_yaw:
            return
        x, y, z = self.quick
        n = _norm(self.quick)
        if n < 1e-9 or abs(n - self.norm) >= r.gate_accel:
            return
        aim = x / n, y / n, z / n
        bridged = self.speed_hint is not None and self.loose_since is not None and (t - self.loose_last) / 1e9 <= r.loose_bridge_s
        stopped = bridged and r.still_up_s is not None and (t - self.loose_since) / 1e9 >= r.still_least_s and self.speed_hint < r.still_speed
        if not (stopped or self.loose or _norm(_flat(self.quick, self.carried)) < r.gate_horizontal):
            return
        pull = r.still_up_s if stopped and math.dist(self.quick, self.slow) < r.still_onset else r.up_s
        self.carried = _unit(_toward(self.carried, aim, min(dt / pull, 1.0))) or self.carried

    def up(self, t: int) -> Vec | None:
        if self.rules.up_s is not None and self.carried is not None:
            return self.carried
        if self.tilted is not None and t - self.tilted[0] <= self.rules.orientation_ns:
            return self.tilted[1]
        return _unit(self.gravity) if self.gravity is not None else None

    def _rotate(self, t: int, w: Vec) -> Motion | None:
        r = self.rules
        self.gyros.add(t, _norm(w))
        first, dt = self.gyro_t is None, 0.0 if self.gyro_t is None else min(max((t - self.gyro_t) / 1e9, 0.0), 0.2)
        if not first and r.up_s is not None and self.carried is not None:
            # A direction fixed in the world turns backwards in the phone's frame.
            c = _cross(w, self.carried)
            self.carried = _unit((self.carried[0] - c[0] * dt, self.carried[1] - c[1] * dt, self.carried[2] - c[2] * dt)) or self.carried
        self.turning, up = True, self.up(t)
        if not first and up is not None:
            rate = _dot(w, up)
            self.yaw += (rate - self.yaw) * min(dt / r.yaw_s, 1.0)
            self.turned += rate * dt
            self.turned_s += dt
            self._mount(t, w, rate, up, dt)
        self.gyro_t = t
        if self.emitted is None:
            self.emitted = t
        return self._emit(t) if t - self.emitted >= r.period_ns else None

    def _mount(self, t: int, w: Vec, rate: float, up: Vec, dt: float) -> None:
        """Shaking, new mounts, and which way is left: in a turn the horizontal force points to its centre."""
        r, side = self.rules, _flat(w, up)
        self.shakes.add(t, _dot(side, side))
        (x, y, z), (a, b, c), tilts, since = (side[0] * dt, side[1] * dt, side[2] * dt), self.tilt, self.tilts, t - r.remount_ns
        tilts.append((t, (x, y, z)))
        a, b, c = a + x, b + y, c + z
        while tilts and tilts[0][0] < since:
            x, y, z = tilts.popleft()[1]
            a, b, c = a - x, b - y, c - z
        self.tilt = a, b, c
        if _norm(self.tilt) > r.remount_rad and (self.mounted is None or t - self.mounted > r.remount_ns):
            self.mount, self.mounted = self.mount + 1, t
            self.left, self.left_weight, self.left_n = (0.0, 0.0, 0.0), 0.0, 0
            self.tilts.clear()
            self.tilt, self.gravity, self.carried, self.quick = (0.0, 0.0, 0.0), None, None, None
            return
        if self.accel is None or t - self.accel[0] > r.accel_fresh_ns:
            return
        smooth = r.up_s is not None
        turn, a = (self.yaw, self.quick or self.accel[1]) if smooth else (rate, self.accel[1])
        if abs(turn) < r.turn_rate or (size := _norm(flat := _flat(a, up))) < r.turn_accel:
            return
        s = math.copysign(1.0, turn)
        self.left = self.left[0] + s * flat[0], self.left[1] + s * flat[1], self.left[2] + s * flat[2]
        self.left_weight, self.left_n = self.left_weight + size, self.left_n + 1

    def forward(self, t: int) -> Vec | None:
        """The car's forward axis in the phone's frame, once enough turns agree on it."""
        r, up = self.rules, self.up(t)
        if up is None or self.left_n < r.axis_samples or self.left_weight <= 0 or _norm(self.left) / self.left_weight < r.axis_concentration:
            return None
        left = _unit(_flat(self.left, up))
        return None if left is None else _unit(_cross(left, up))

    def _emit(self, t: int) -> Motion:
        r, dt = self.rules, (t - self.emitted) / 1e9
        rate = self.turned / self.turned_s if self.turned_s > 0 else 0.0
        self.bearing -= rate * dt
        self.turned = self.turned_s = 0.0
        if self.car is not None and t - self.car[0] <= r.speed_age_ns:
            d = self.car[1] * dt
            self.east, self.north, self.way = self.east + d * math.sin(self.bearing), self.north + d * math.cos(self.bearing), self.way + d
        elif dt > 0:
            self.gaps += 1
        self.emitted = t
        std, gyro = self.accels.std(), self.gyros.mean()
        full = len(self.accels.rows) >= r.least_samples and len(self.gyros.rows) >= r.least_samples
        still = full and std < r.still_accel and gyro < r.still_gyro
        self.still_since = (self.still_since if self.still_since is not None else t) if still else None
        up, forward = self.up(t), self.forward(t)
        mean = tuple(v / self.forces for v in self.force) if self.forces else None
        self.force, self.forces = (0.0, 0.0, 0.0), 0
        left = _unit(_cross(up, forward)) if up is not None and forward is not None else None
        self.loose = full and std < r.loose_accel and gyro < r.loose_gyro
        if self.loose:
            if self.loose_since is None or (t - self.loose_last) / 1e9 > r.loose_bridge_s:
                self.loose_since = t
            self.loose_last = t
        steady = r.up_s is not None and self.carried is not None or self.tilted is not None and t - self.tilted[0] <= r.orientation_ns
        self.latest = Motion(
            t, dt, rate, still, (t - self.still_since) / 1e9 if still else 0.0, gyro, std, up, forward, self.mount, math.sqrt(max(0.0, self.shakes.mean())),
            _norm(_flat(self.accel[1], up)) if up is not None and self.accel is not None else 0.0, steady,
            _dot(mean, forward) if mean is not None and forward is not None else None, _dot(mean, left) if mean is not None and left is not None else None,
            self.loose, self.bearing, self.east, self.north, self.way, self.gaps,
        )
        self.path.append((t, self.bearing, self.east, self.north, self.way, self.gaps))
        if len(self.path) > 2 * r.history_ns // r.period_ns or self.path[0][0] < t - 2 * r.history_ns:
            self.path = self.path[bisect_right(self.path, (t - r.history_ns,)) :]
        return self.latest

    # What trust asks between two times.

    def still_s(self) -> float:
        return self.latest.still_s if self.latest is not None else 0.0

    def _at(self, t: int) -> tuple[float, float, float, float, int, int] | None:
        """Bearing, east, north and way at a time, and the gaps at the rows before and behind; None outside of the history."""
        r, p = self.rules, self.path
        if not p or t > p[-1][0] + 4 * r.period_ns:
            return None
        i = bisect_right(p, (t, math.inf)) - 1
        if i < 0 or p[i][0] < p[-1][0] - r.history_ns and t < p[-1][0] - r.history_ns:
            return None
        a, b = p[i], p[min(i + 1, len(p) - 1)]
        u = (t - a[0]) / (b[0] - a[0]) if b[0] > a[0] else 0.0
        return *(a[k] + u * (b[k] - a[k]) for k in range(1, 5)), a[5], b[5]

    def turn(self, t1: int, t2: int) -> float | None:
        """Change of bearing by the gyroscope, clockwise."""
        a, b = self._at(t1), self._at(t2)
        return None if a is None or b is None else b[0] - a[0]

    def odometry(self, t1: int, t2: int) -> tuple[float, float, float, float, float] | None:
        """Way, chord, east, north and bearing at the end; None where the car's speed lacked in between."""
        a, b = self._at(t1), self._at(t2)
        if a is None or b is None or a[4] != b[5]:
            return None
        e, n = b[1] - a[1], b[2] - a[2]
        return b[3] - a[3], math.hypot(e, n), e, n, b[0]

#: Columns of motion rows.
MOTION = (
    "t_ns long, dt_s double, yaw_rate double, still boolean, still_s double, gyro_mean double, accel_std double, up array<double>, forward array<double>, mount long, tilt_rms double, "
    "horizontal_accel double, steady_up boolean, along_accel double, left_accel double, still_loose boolean, bearing double, east_m double, north_m double, way_m double, gaps long"
)
#: Columns of samples: rank orders kinds at equal times; sub tells the sensor.
SAMPLES = "t_ns long, rank int, seq long, kind string, sub string, x double, y double, z double, w double"
_ORDER = [c.split(" ")[0] for c in SAMPLES.split(", ")]


def samples_of(imu: DataFrame, orientation: DataFrame | None = None, speeds: DataFrame | None = None) -> DataFrame:
    """drive_id and SAMPLES from record tables. Rows without drive or time are left out; uncalibrated sensors other than the gyroscope pass unused."""
    blank = F.lit(None).cast("double")
    out = imu.select("drive_id", "t_ns", F.lit(3).alias("rank"), "seq", F.lit("imu").alias("kind"), F.col("kind").alias("sub"), "x", "y", "z", blank.alias("w"))
    if orientation is not None:
        out = out.unionByName(orientation.select("drive_id", "t_ns", F.lit(4).alias("rank"), "seq", F.lit("orientation").alias("kind"), F.col("kind").alias("sub"), F.col("qx").alias("x"), F.col("qy").alias("y"), F.col("qz").alias("z"), F.col("qw").alias("w")))
    if speeds is not None:
        out = out.unionByName(speeds.select("drive_id", "t_ns", F.lit(12).alias("rank"), "seq", F.lit("vehicle_speed").alias("kind"), F.lit(None).cast("string").alias("sub"), F.col("speed_mps").alias("x"), blank.alias("y"), blank.alias("z"), blank.alias("w")))
    return out.filter("drive_id IS NOT NULL AND t_ns IS NOT NULL AND (kind <> 'imu' OR sub IN ('ACCEL', 'GYRO', 'GYRO_UNCAL'))")


def _columns(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    named = [c.split(" ") for c in MOTION.split(", ")]
    columns = zip(*rows) if rows else [()] * (len(named) + 1)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [key, *(kinds[k] for _, k in named)])], ["drive_id", *(n for n, _ in named)])


def motion_batch(samples: DataFrame, rules: MotionRules = MotionRules()) -> DataFrame:
    """drive_id and MOTION: drive by drive in the order (t_ns, rank, seq). Rows stream through a task; one drive's state is held. Empty input gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drive, tracker = None, None
        for b in batches:
            out = []
            for key, t, kind, sub, x, y, z, w in rows_of(b):
                if tracker is None or key != drive:
                    drive, tracker = key, Tracker(rules)
                if (m := tracker.take(kind, t, sub, x, y, z, w)) is not None:
                    out.append((key, *m))
            yield _columns(out, b.schema.field(0).type)

    kind = samples.schema["drive_id"].dataType.simpleString()
    rows = samples.select("drive_id", *_ORDER).repartition("drive_id").sortWithinPartitions("drive_id", "t_ns", "rank", "seq")
    return rows.drop("rank", "seq").mapInArrow(run, f"drive_id {kind}, {MOTION}")


class _Motions:
    """The tracker as a fold over rows of a stream."""

    def __init__(self, rules: MotionRules):
        self.tracker = Tracker(rules)

    def take(self, row: tuple, late: bool) -> list[tuple]:
        t, _, _, kind, sub, *v = row
        m = self.tracker.take(kind, t, sub, *v)
        return [] if m is None else [m]


def motion_stream(samples: DataFrame, rules: MotionRules = MotionRules(), reorder_ns: int = 500_000_000, flush_ms: int = 2000, forget_ms: int = 600_000) -> DataFrame:
    """A stream's motion rows, equal to those of motion_batch under the conditions of keyed_stream."""
    return keyed_stream(samples, _ORDER, lambda: _Motions(rules), MOTION, reorder_ns, flush_ms, forget_ms)


#: The path at a time, as struct members.
_PATH = ("bearing", "east_m", "north_m", "way_m")


def path_at(times: DataFrame, motion: DataFrame, period_ns: int = MotionRules.period_ns) -> DataFrame:
    """times (drive_id, t_ns and more) with `at`: bearing, east_m, north_m, way_m between the motion rows around, gaps_before and gaps_behind.

    Null before a drive's first motion row and more than four periods after its last. One sort by (drive_id, t_ns): no join with a range.
    """
    names = times.columns
    m = motion.select("drive_id", "t_ns", F.struct("t_ns", *_PATH, "gaps").alias("_m"), F.lit(0).alias("_k"))
    both = times.select("drive_id", "t_ns", F.struct(*names).alias("_row"), F.lit(1).alias("_k")).unionByName(m, allowMissingColumns=True)
    order = Window.partitionBy("drive_id").orderBy("t_ns", "_k")
    before = F.last("_m", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first("_m", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumns({"_a": before, "_b": behind}).filter("_k = 1")
    b = F.coalesce("_b", "_a")
    share = F.when(b["t_ns"] > F.col("_a.t_ns"), (F.col("t_ns") - F.col("_a.t_ns")) / (b["t_ns"] - F.col("_a.t_ns"))).otherwise(0.0)
    parts = [(F.col(f"_a.{c}") + share * (b[c] - F.col(f"_a.{c}"))).alias(c) for c in _PATH]
    known = F.col("_a").isNotNull() & (F.col("_b").isNotNull() | (F.col("t_ns") <= F.col("_a.t_ns") + 4 * period_ns))
    at = F.when(known, F.struct(*parts, F.col("_a.gaps").alias("gaps_before"), b["gaps"].alias("gaps_behind")))
    return rows.select("_row.*", at.alias("at"))
