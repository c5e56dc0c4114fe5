"""Declarative faults for recorded drives: each step becomes a filter or a projection, later steps see what earlier ones made."""

from __future__ import annotations

import glob
import json
import math
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drivelake.functions import geo

#: Sources that a step moves unless it names others.
SATELLITE = frozenset({"GNSS", "FUSED"})
#: Kinds of steps that degrade satellite positions, with the kind of their window.
WINDOW_KINDS = {"drop_source": "gnss_outage", "offset": "gnss_offset", "drift": "gnss_drift", "teleport": "gnss_teleport", "inflate_noise": "gnss_noise"}
KINDS = (*WINDOW_KINDS, "drop_sensor", "drop_vehicle_speed", "synthetic_network", "synthetic_vehicle_speed")


@dataclass(frozen=True)
class Step:
    """One fault, active from start_s for duration_s (None: to the end). kind is one of KINDS.

    source: what drop_source and inflate_noise act on; sources: what offset, drift and teleport act on. drop_raw: dropping GNSS also drops
    satellite status, raw measurements and NMEA. sensor: the IMU kind to drop (None: all); orientation: drop orientation too.
    """

    kind: str
    start_s: float = 0.0
    duration_s: float | None = None
    source: str = "GNSS"
    sources: frozenset[str] = SATELLITE
    drop_raw: bool = True
    sensor: str | None = None
    orientation: bool = False
    east_m: float = 0.0
    north_m: float = 0.0
    ramp_s: float = 0.0
    rate_mps: float = 0.0
    bearing_deg: float = 0.0
    lat: float = 0.0
    lon: float = 0.0
    sigma_m: float = 0.0
    sigma_mps: float = 0.3
    period_s: float = 20.0
    scale_error: float = 0.0
    latency_s: float = 0.0
    quantize_kmh: bool = False
    consistent_velocity: bool = False
    freeze: bool = False
    honest: bool = False


#: Names of step fields in scenario files.
_FILE_NAMES = {
    "type": "kind", "startS": "start_s", "durationS": "duration_s", "source": "source", "sources": "sources", "dropRawGnss": "drop_raw", "kind": "sensor", "orientation": "orientation",
    "dEastM": "east_m", "dNorthM": "north_m", "rampS": "ramp_s", "rateMps": "rate_mps", "bearingDeg": "bearing_deg", "lat": "lat", "lon": "lon", "sigmaM": "sigma_m", "sigmaMps": "sigma_mps",
    "periodS": "period_s", "scaleError": "scale_error", "latencyS": "latency_s", "quantizeKmh": "quantize_kmh", "consistentVelocity": "consistent_velocity", "frozen": "freeze", "reportHonestly": "honest",
}
#: Fields that a file must give, and defaults that hold for one kind of step only.
_NEEDED = {"drop_source": ("source",), "offset": ("startS", "dEastM", "dNorthM"), "drift": ("startS", "rateMps", "bearingDeg"), "teleport": ("startS", "lat", "lon"), "inflate_noise": ("sigmaM",)}
_DEFAULTS = {"synthetic_network": {"sigma_m": 500.0, "period_s": 20.0}, "synthetic_vehicle_speed": {"period_s": 0.2}}


def step_of(values: dict) -> Step:
    """A step from a scenario file. Unknown keys are ignored; an unknown type or a lacking field is an error."""
    kind = values.get("type")
    if kind not in KINDS:
        raise ValueError(f"unknown step type {kind!r}")
    lacking = [x for x in _NEEDED.get(kind, ()) if x not in values]
    if lacking:
        raise ValueError(f"step {kind} lacks {', '.join(lacking)}")
    found = _DEFAULTS.get(kind, {}) | {_FILE_NAMES[k]: v for k, v in values.items() if k in _FILE_NAMES}
    if "sources" in found:
        found["sources"] = frozenset(found["sources"])
    kinds = {f.name: f.type for f in fields(Step)}
    return Step(**{k: float(v) if kinds[k].startswith("float") and v is not None else v for k, v in found.items()})


def load_scenarios(folder: str) -> dict[str, tuple[list[Step], int]]:
    """Name -> (steps, seed) of every *.json file of a folder, in order of file names. Configuration, so read where the job is built."""
    out = {}
    for path in sorted(glob.glob(f"{glob.escape(folder)}/*.json")):
        with open(path, encoding="utf-8") as f:
            x = json.load(f)
        out[x["name"]] = [step_of(s) for s in x.get("steps", [])], int(x.get("seed", 42))
    return out


def load_variants(path: str | None = None, names: list[str] | None = None, with_roads: bool = False) -> dict[str, Variant]:
    """Variants of a JSON file (a list), or the standard ladder; those that need roads only if with_roads. An unknown name is an error."""
    every = VARIANTS
    if path is not None:
        with open(path, encoding="utf-8") as f:
            every = {x["name"]: Variant(x.get("estimator", "baseline"), tuple(step_of(s) for s in x.get("extraSteps", [])), bool(x.get("roads", False))) for x in json.load(f)}
    for n in names or ():
        if n not in every:
            raise ValueError(f"unknown variant {n!r}")
    return {n: v for n, v in every.items() if (with_roads or not v.roads) and (names is None or n in names)}


#: The corpus of named scenarios.
SCENARIOS = {
    "clean": [],
    "gnss_absent_from_start": [Step("drop_source", 0)],
    "gnss_drop_30s": [Step("drop_source", 120, 30)],
    "gnss_drop_2min": [Step("drop_source", 120, 120)],
    "gnss_drop_10min": [Step("drop_source", 120, 600)],
    "gnss_drop_1h": [Step("drop_source", 120, 3600)],
    "gnss_jump_5km": [Step("offset", 120, 120, east_m=5000)],
    "gnss_ramp_capture": [Step("offset", 120, 300, east_m=700, north_m=700, ramp_s=120)],
    "gnss_ramp_capture_doppler_consistent": [Step("offset", 120, 300, east_m=700, north_m=700, ramp_s=120, consistent_velocity=True)],
    "gnss_drift_gradual": [Step("drift", 120, 300, rate_mps=2)],
    "gnss_drift_doppler_consistent": [Step("drift", 120, 300, rate_mps=2, consistent_velocity=True)],
    "gnss_teleport_country": [Step("teleport", 120, 300, lat=-12.0464, lon=-77.0428)],
    "gnss_noise_overconfident": [Step("inflate_noise", 120, 180, sigma_m=40)],
}


@dataclass(frozen=True)
class Variant:
    """An estimator's name, the steps that a variant adds to a scenario's, whether it needs roads and may use the compass."""

    estimator: str = "baseline"
    steps: tuple[Step, ...] = ()
    roads: bool = False
    compass: bool = True


_NO_FUSED = (Step("drop_source", source="FUSED", drop_raw=False),)
_NO_NETWORK = (*_NO_FUSED, Step("drop_source", source="NETWORK", drop_raw=False))
_NO_OBD = (Step("drop_vehicle_speed"),)
_NETWORK = (Step("synthetic_network", sigma_m=500, period_s=20),)
_OBD = (Step("synthetic_vehicle_speed", sigma_mps=0.3, period_s=0.2, scale_error=0.03, quantize_kmh=True, latency_s=0.15),)
#: The standard ladder of variants.
VARIANTS = {
    "hold-last-fix": Variant("passthrough"),
    "gyro-only": Variant(steps=_NO_NETWORK + _NO_OBD, compass=False),
    "phone-only": Variant(steps=_NO_NETWORK + _NO_OBD),
    "phone+network": Variant(steps=_NO_FUSED + _NO_OBD),
    "phone+synthNetwork": Variant(steps=_NO_NETWORK + _NO_OBD + _NETWORK),
    "gyro+synthNetwork+synthObd": Variant(steps=_NO_NETWORK + _NO_OBD + _NETWORK + _OBD, compass=False),
    "phone+synthNetwork+synthObd": Variant(steps=_NO_NETWORK + _NO_OBD + _NETWORK + _OBD),
    "phone+obd": Variant(steps=_NO_NETWORK),
    "phone+network+obd": Variant(steps=_NO_FUSED),
    "phone+network+osm": Variant(steps=_NO_FUSED + _NO_OBD, roads=True),
    "phone+network+obd+osm": Variant(steps=_NO_FUSED, roads=True),
}


def active(s: Step, since: Column) -> Column:
    """True while a step acts, by seconds since the drive's first row."""
    on = since >= s.start_s
    return on if s.duration_s is None else on & (since < s.start_s + s.duration_s)


def apply_steps(fixes: DataFrame, steps: list[Step], seed: int = 42, t0: DataFrame | None = None) -> DataFrame:
    """The perturbed fixes, with lat0 and lon0 (as recorded) for labels.

    Time counts from each drive's first row, or from t0 (drive_id, t0_ns: the first measurement of any kind). Noise is a hash of seed,
    drive, step and seq: the same on any cluster. Steps for other record kinds leave fixes alone. Null accuracies count as 0 under honest
    noise; null speeds stay null. An empty table gives an empty result.
    """
    first = F.min("t_ns").over(Window.partitionBy("drive_id"))
    out = fixes if t0 is None else fixes.join(t0, "drive_id")
    begun = first if t0 is None else F.col("t0_ns")
    out = out.select(*fixes.columns, F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), ((F.col("t_ns") - begun) / F.lit(1e9)).alias("_t"))
    for i, s in enumerate(steps):
        out = _apply(out, s, i, seed)
    return out.drop("_t")


def apply_to_records(rows: DataFrame, kind: str, steps: list[Step], t0: DataFrame) -> DataFrame:
    """Rows of one record kind (not location) that the steps leave. t0: drive_id, t0_ns of each drive's first measurement.

    Dropping GNSS takes gnss_status, gnss_meas and nmea too unless told otherwise; drop_sensor takes imu rows of its kind (or all) and
    orientation if asked; drop_vehicle_speed spares rows whose source is synthetic.
    """
    since = (F.col("t_ns") - F.col("t0_ns")) / F.lit(1e9)
    gone = F.lit(False)
    for s in steps:
        hit = F.lit(False)
        if s.kind == "drop_source" and s.source == "GNSS" and s.drop_raw and kind in ("gnss_status", "gnss_meas", "nmea"):
            hit = F.lit(True)
        elif s.kind == "drop_sensor" and kind == "imu":
            hit = F.lit(True) if s.sensor is None else F.col("kind") == s.sensor
        elif s.kind == "drop_sensor" and kind == "orientation":
            hit = F.lit(s.orientation)
        elif s.kind == "drop_vehicle_speed" and kind == "vehicle_speed":
            hit = F.coalesce(F.col("source") != "synthetic", F.lit(True))
        gone = gone | (active(s, since) & hit)
    return rows.join(t0, "drive_id").filter(~gone).select(*rows.columns)


def _moved(out: DataFrame, active: Column, values: dict[str, Column]) -> DataFrame:
    return out.withColumns({c: F.when(active, v).otherwise(F.col(c)) for c, v in values.items()})


def _apply(out: DataFrame, s: Step, i: int, seed: int) -> DataFrame:
    lat, lon, since = F.col("lat"), F.col("lon"), F.col("_t") - s.start_s
    on = active(s, F.col("_t")) & F.coalesce(F.col("source").isin(*({s.source} if s.kind in ("drop_source", "inflate_noise") else s.sources)), F.lit(False))
    if s.kind == "drop_source":
        return out.filter(~on)
    if s.kind in ("offset", "drift"):
        if s.kind == "offset":
            part = F.least(F.greatest(since / s.ramp_s, F.lit(0.0)), F.lit(1.0)) if s.ramp_s > 0 else F.lit(1.0)
            east, north = part * s.east_m, part * s.north_m
            speed = (s.east_m / s.ramp_s, s.north_m / s.ramp_s) if s.ramp_s > 0 else (0.0, 0.0)
            moving = since < s.ramp_s
        else:
            b = math.radians(s.bearing_deg)
            speed = (s.rate_mps * math.sin(b), s.rate_mps * math.cos(b))
            east, north, moving = since * speed[0], since * speed[1], F.lit(True)
        to = geo.offset_by(lat, lon, east, north)
        values = {"lat": to[0], "lon": to[1]}
        if s.consistent_velocity:
            v, b = geo.add_velocity(F.col("speed_mps"), F.col("bearing_deg"), F.lit(speed[0]), F.lit(speed[1]))
            values |= {"speed_mps": F.when(moving & F.col("speed_mps").isNotNull(), v).otherwise(F.col("speed_mps")), "bearing_deg": F.when(moving & F.col("speed_mps").isNotNull(), b).otherwise(F.col("bearing_deg"))}
        return _moved(out, on, values)
    if s.kind == "teleport":
        if s.freeze:
            return _moved(out, on, {"lat": F.lit(s.lat), "lon": F.lit(s.lon), "speed_mps": F.lit(0.0)})
        # The first fix that the step meets is the anchor; the track keeps its differences in degrees.
        anchor = F.min(F.when(on, F.struct("t_ns", "seq", "lat", "lon"))).over(Window.partitionBy("drive_id"))
        out = out.withColumn("_anchor", anchor)
        to = s.lat + (lat - F.col("_anchor.lat")), geo.wrap_deg(s.lon + (lon - F.col("_anchor.lon")))
        return _moved(out, on, {"lat": to[0], "lon": to[1]}).drop("_anchor")
    if s.kind == "inflate_noise":
        e, n = (geo.gaussian(F.lit(seed), F.lit(i), F.lit(axis), F.col("drive_id"), F.col("seq")) * s.sigma_m for axis in (0, 1))
        to = geo.offset_by(lat, lon, e, n)
        values = {"lat": to[0], "lon": to[1]}
        if s.honest:
            values["h_acc_m"] = F.hypot(F.coalesce("h_acc_m", F.lit(0.0)), F.lit(s.sigma_m * geo.R68_PER_SIGMA))
        return _moved(out, on, values)
    if s.kind in KINDS:
        return out
    raise ValueError(f"unknown step {s.kind}")


def injected_offset(fixes: DataFrame) -> Column:
    """Metres between a fix as recorded and as perturbed."""
    return geo.haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))


def degraded_windows(spans: DataFrame, steps: list[Step]) -> DataFrame:
    """drive_id, step_idx, kind, start_ns, end_ns (in the drive's own time) of each step that degrades satellite positions.

    spans: drive_id, t0_ns, end_ns of each drive. A window ends with its drive at the latest, so one that begins later ends before it begins
    and holds nothing. Dropping a source other than GNSS degrades nothing; offsets, drifts, teleports and noise count whatever they act on.
    Seconds become nanoseconds by truncation.
    """
    picked = [(i, s) for i, s in enumerate(steps) if s.kind in WINDOW_KINDS and (s.kind != "drop_source" or s.source == "GNSS")]
    start = lambda s: F.col("t0_ns") + int(s.start_s * 1e9)
    end = lambda s: F.col("end_ns") if s.duration_s is None else F.least(start(s) + int(s.duration_s * 1e9), F.col("end_ns"))
    rows = [F.struct(F.lit(i).alias("step_idx"), F.lit(WINDOW_KINDS[s.kind]).alias("kind"), start(s).alias("start_ns"), end(s).alias("end_ns")) for i, s in picked]
    every = F.array(*rows) if rows else F.array().cast("array<struct<step_idx:int,kind:string,start_ns:bigint,end_ns:bigint>>")
    return spans.select("drive_id", F.explode(every).alias("_w")).select("drive_id", "_w.*")


def matrix_cells(drives: DataFrame, scenarios: list[str], variants: dict[str, Variant]) -> DataFrame:
    """drive_id x scenario x variant, with the variant's estimator, extra_steps and roads: the work list of an experiment. Both lists are configuration, a few names each."""
    each = F.array(*(F.struct(F.lit(n).alias("variant"), F.lit(len(v.steps)).alias("extra_steps"), F.lit(v.estimator).alias("estimator"), F.lit(v.roads).alias("roads")) for n, v in variants.items()))
    return drives.select("drive_id", F.explode(F.array(*map(F.lit, scenarios))).alias("scenario")).select("*", F.explode(each).alias("_v")).select("drive_id", "scenario", "_v.*")
