"""Stateful trust in location fixes: one step for each event, run over sorted partitions in batch and over keyed state in a stream.

Events are fixes, and what fixes are held against: vehicle speeds, satellite statuses, provider events. The prediction is that of the estimator
that holds the last trusted satellite fix, unless the caller has another one. Checks against gyroscope, stillness and odometry need a motion history
(tracker.Tracker), which the fold of whole drives has (drive_fold); without one they are left out, as where a phone has no such sensors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivelake.functions.geo import EARTH_RADIUS, R68_PER_SIGMA, WGS84_A, WGS84_E2
from drivelake.operators.trust import BASE_CONFIDENCE, STATES
from drivelake.streaming.batches import rows_of
from drivelake.streaming.keyed import keyed_stream
from drivelake.streaming.tracker import Tracker

#: The columns of events; rank orders kinds at equal times.
EVENTS = (
    "seq long, t_ns long, rank int, kind string, source string, provider string, lat double, lon double, h_acc_m double, speed_mps double, bearing_deg double, synthetic boolean, latency_s double, event string, used int, spread_db double, "
    "x double, y double, z double, w double, speed_acc_mps double, bearing_acc_deg double"
)
COLUMNS = [c.split(" ")[0] for c in EVENTS.split(", ")]
OUT = "seq long, t_ns long, source string, provider string, state string, confidence double, reasons string, innovation_nis double, implied_speed_mps double, late boolean"
_NAMES = [x.split(" ")[0] for x in OUT.split(", ")]
#: Rejections that a long consistent stream may outlast, and hits that agreement with the estimate takes away.
RESETTABLE = {"INNOVATION_GATE", "IMPOSSIBLE_ACCELERATION", "RECOVERING", "CN0_UNIFORM", "COURSE_GYRO_MISMATCH", "VELOCITY_POSITION_MISMATCH"}
OVERRIDDEN_BY_AGREEMENT = {"IMPOSSIBLE_ACCELERATION", "INNOVATION_GATE", "MOVING_WHILE_STATIONARY"}


@dataclass(frozen=True)
class TrustRules:
    """The thresholds of the checks."""

    max_speed_mps: float = 70.0
    max_accel_mps2: float = 8.0
    gate_question: float = 13.8
    gate_reject: float = 50.0
    gate_reject_m: float = 5000.0
    velocity_window_s: float = 10.0
    velocity_slack_m: float = 15.0
    obd_abs_mps: float = 1.5
    obd_share: float = 0.08
    obd_age_s: float = 1.5
    status_age_s: float = 2.0
    few_satellites: int = 4
    uniform_satellites: int = 6
    uniform_db: float = 1.0
    network_max_age_s: float = 120.0
    network_impossible_m: float = 20_000.0
    agree_m: float = 100.0
    agree_acc_m: float = 30.0
    agree_obd_s: float = 10.0
    echo_s: float = 10.0
    recovery_fixes: int = 5
    reset_after_s: float = 120.0
    reset_with_network_s: float = 15.0
    outage_s: float = 30.0
    reset_after_outage_s: float = 10.0
    hold_acc_m: float = 10.0
    hold_growth_mps: float = 20.0
    course_mps: float = 5.0
    course_dt_s: float = 5.0
    course_deg: float = 25.0
    course_deg_per_s: float = 10.0
    still_s: float = 3.0
    still_mps: float = 3.0
    vote_k: float = 3.0
    vote_share: float = 0.05
    vote_slack_m: float = 10.0
    vote_age_s: float = 180.0
    voters: int = 3
    vote_floor_m: float = 50.0
    vote_weighted: bool = True
    vector_heading_deg: float = 15.0
    vector_least_deg: float = 5.0
    vector_k: float = 2.5
    vector_no_satellite_s: float = 180.0
    unconfirmed_reject: bool = False


class Prediction(NamedTuple):
    """An estimator's place at a time: covariance in the plane (east, north), heading clockwise from north where it is known."""

    lat: float
    lon: float
    ee: float
    en: float
    nn: float
    heading: float | None = None
    heading_std: float | None = None


class Event(NamedTuple):
    seq: int
    t_ns: int
    rank: int
    kind: str
    source: str | None = None
    provider: str | None = None
    lat: float | None = None
    lon: float | None = None
    h_acc_m: float | None = None
    speed_mps: float | None = None
    bearing_deg: float | None = None
    synthetic: bool | None = None
    latency_s: float | None = None
    event: str | None = None
    used: int | None = None
    spread_db: float | None = None
    x: float | None = None
    y: float | None = None
    z: float | None = None
    w: float | None = None
    speed_acc_mps: float | None = None
    bearing_acc_deg: float | None = None


# A fix in memory is the list [t_ns, lat, lon, acc, speed, bearing]: plain values, so that a state is JSON.


def _metres(a: list, b: list) -> float:
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * EARTH_RADIUS * math.asin(math.sqrt(min(max(h, 0.0), 1.0)))


def _plane(a: list, b: list) -> tuple[float, float]:
    """East and north metres from a to b."""
    s = math.sin(math.radians(a[1]))
    r = WGS84_A / math.sqrt(1 - WGS84_E2 * s * s)
    turn = (b[2] - a[2] + 180) % 360 - 180
    return math.radians(turn) * r * math.cos(math.radians(a[1])), math.radians(b[1] - a[1]) * r * (1 - WGS84_E2) / (1 - WGS84_E2 * s * s)


def _half(degrees: float) -> float:
    """An angle in (-180, 180]."""
    return 180 - (180 - degrees) % 360


def _or(x: float | None, other: float) -> float:
    return other if x is None else x


def _beyond(a: list, b: list) -> float:
    """Metres between two fixes beyond what their accuracies allow."""
    return max(_metres(a, b) - 2 * (_or(a[3], 50.0) + _or(b[3], 50.0)), 0.0)


def _consistent(a: list | None, b: list, rules: TrustRules) -> bool:
    if a is None:
        return False
    dt = (b[0] - a[0]) / 1e9
    return 0 < dt <= 10 and _beyond(a, b) / dt <= rules.max_speed_mps


def _velocity_differs(recent: list[list], fix: list, rules: TrustRules) -> bool:
    """True if the way over the last window isn't the integral of the reported velocity; False where that can't be told."""
    fixes = [f for f in [*recent, fix] if (fix[0] - f[0]) / 1e9 <= rules.velocity_window_s * 1.2]
    if len(fixes) < 2 or (fix[0] - fixes[0][0]) / 1e9 < rules.velocity_window_s * 0.6:
        return False
    e = n = 0.0
    for a, b in zip(fixes, fixes[1:]):
        dt = (b[0] - a[0]) / 1e9
        if not 0 < dt <= 3:
            return False
        for x in (a, b):
            if x[4] is None or (x[4] >= 1 and x[5] is None):
                return False
            course = math.radians(x[5]) if x[4] >= 1 else 0.0
            e, n = e + 0.5 * dt * x[4] * math.sin(course), n + 0.5 * dt * x[4] * math.cos(course)
    east, north = _plane(fixes[0], fix)
    return math.hypot(east - e, north - n) > rules.velocity_slack_m + 2 * (_or(fixes[0][3], 20.0) + _or(fix[3], 20.0))


def observe(memory: dict, x: Event) -> None:
    """Takes in an event that isn't a fix."""
    if x.kind == "vehicle_speed":
        memory["obd"] = [x.t_ns, x.speed_mps]
    elif x.kind == "gnss_status":
        memory["status"] = [x.t_ns, x.used, x.spread_db]
    elif x.kind == "provider" and x.event == "OVERRIDDEN" and x.provider not in memory.setdefault("overridden", []):
        memory["overridden"].append(x.provider)
    elif x.kind == "provider" and x.event == "RESTORED" and x.provider in memory.get("overridden", []):
        memory["overridden"].remove(x.provider)
        memory["restored"] = x.t_ns


def is_echo(memory: dict, t_ns: int, rules: TrustRules) -> bool:
    """True while fused fixes may repeat our own output."""
    return bool(memory.get("overridden")) or ("restored" in memory and (t_ns - memory["restored"]) / 1e9 < rules.echo_s)


def _held(memory: dict, t_ns: int, rules: TrustRules) -> Prediction | None:
    """The last trusted satellite fix, with a radius that grows."""
    if (held := memory.get("held")) is None:
        return None
    spread = ((_or(held[3], rules.hold_acc_m) + rules.hold_growth_mps * max(0.0, (t_ns - held[0]) / 1e9)) / R68_PER_SIGMA) ** 2
    return Prediction(held[1], held[2], spread, 0.0, spread)


def _motion_checks(own: dict, fix: list, motion: Tracker | None, rules: TrustRules) -> list[tuple[str, int, float]]:
    """A course that the gyroscope doesn't confirm, and a speed while the car rests."""
    hits, last = [], own["last_fix"]
    if motion is None:
        return hits
    if last is not None and None not in (last[5], fix[5]) and min(_or(last[4], 0.0), _or(fix[4], 0.0)) >= rules.course_mps and 0 < (dt := (fix[0] - last[0]) / 1e9) <= rules.course_dt_s:
        if (turn := motion.turn(last[0], fix[0])) is not None and abs(_half(fix[5] - last[5] - math.degrees(turn))) > rules.course_deg + rules.course_deg_per_s * dt:
            hits.append(("COURSE_GYRO_MISMATCH", 1, 0.6))
    if motion.still_s() >= rules.still_s and _or(fix[4], 0.0) > rules.still_mps:
        hits.append(("MOVING_WHILE_STATIONARY", 1, 0.6))
    return hits


def _vote(memory: dict, a: list, b: list, motion: Tracker, predicted: Prediction | None, rules: TrustRules) -> tuple[bool, float] | None:
    """Whether the way from fix a to fix b is as far as the car drove (where the heading is known without satellites: also in its direction),
    and the vote's weight; None without odometry or accuracy."""
    if None in (a[3], b[3]) or (odo := motion.odometry(a[0], b[0])) is None:
        return None
    way, chord, east, north, bearing = odo
    sigmas = a[3] / R68_PER_SIGMA, b[3] / R68_PER_SIGMA
    spread, slack = math.hypot(*sigmas), rules.vote_share * way + rules.vote_slack_m
    weight = 1 / sum(max(s, rules.vote_floor_m) ** 2 for s in sigmas) if rules.vote_weighted else 1.0
    last = [o["trusted"][0] for k, o in memory.get("sources", {}).items() if k in ("GNSS", "FUSED") and o["trusted"] is not None]
    by_satellite = any((b[0] - t) / 1e9 <= rules.vector_no_satellite_s for t in last)
    if predicted is not None and predicted.heading is not None and predicted.heading_std is not None and bearing is not None and math.degrees(predicted.heading_std) <= rules.vector_heading_deg and not by_satellite:
        turn = predicted.heading - bearing
        e, n = _plane(a, b)
        off = math.hypot(e - (east * math.cos(turn) + north * math.sin(turn)), n - (north * math.cos(turn) - east * math.sin(turn)))
        return off <= rules.vector_k * math.hypot(spread, chord * max(predicted.heading_std, math.radians(rules.vector_least_deg))) + slack, weight
    return abs(_metres(a, b) - chord) <= rules.vote_k * spread + slack, weight


def _odometry_vote(memory: dict, own: dict, fix: list, motion: Tracker | None, predicted: Prediction | None, rules: TrustRules) -> tuple[list[tuple[str, int, float]], list[int]]:
    """What the last trusted coarse fixes say of a new one, and the times of fixes that it confirms if it is trusted.

    The heavier side wins. Against a fix that follows its refused forerunner nothing is said; voters that nothing confirmed only dispute.
    """
    if motion is None:
        return [], []
    ask = lambda v: _vote(memory, v, fix, motion, predicted, rules)
    votes = [(v[0], *said) for v in own["voters"] if (fix[0] - v[0]) / 1e9 <= rules.vote_age_s and (said := ask(v)) is not None]
    agreeing, against = [t for t, yes, _ in votes if yes], [t for t, yes, _ in votes if not yes]
    if sum(w for _, yes, w in votes if not yes) <= sum(w for _, yes, w in votes if yes):
        return [], [*agreeing, fix[0]] if agreeing else []
    last = own["last_fix"]
    if last is not None and last != own["trusted"] and (said := ask(last)) is not None and said[0]:
        return [], [fix[0]]
    if rules.unconfirmed_reject or any(t in own["confirmed"] for t in against):
        return [("COARSE_ODOMETRY_MISMATCH", 2, 1.0)], []
    return [("COARSE_ODOMETRY_DISPUTED", 1, 0.5)], []


def _satellite_checks(memory: dict, own: dict, x: Event, fix: list, motion: Tracker | None, predicted: Prediction | None, rules: TrustRules) -> tuple[list[tuple[str, int, float]], float | None, float | None, bool, bool]:
    """Hits, innovation, implied speed, agreement with the network and with the estimate of a satellite or fused fix."""
    hits, acc, late = [], x.h_acc_m, _or(x.latency_s, 0.0)
    if late > 2:
        hits.append(("STALE", 2, 1.0) if late > 10 else ("STALE", 1, 0.7))
    if acc is None:
        hits.append(("NO_ACCURACY", 1, 0.5))
    elif acc > 30:
        hits.append(("POOR_ACCURACY", 2, 1.0) if acc > 150 else ("POOR_ACCURACY", 1, 0.6))
    implied = innovation = None
    if (last := own["trusted"]) is not None and (dt := (fix[0] - last[0]) / 1e9) > 0:
        implied = _beyond(last, fix) / max(dt, 0.5)
        if implied > rules.max_speed_mps:
            hits.append(("IMPOSSIBLE_VELOCITY", 2, 1.0))
        if None not in (last[4], fix[4]) and dt <= 5 and abs(fix[4] - last[4]) / max(dt, 0.2) > rules.max_accel_mps2:
            hits.append(("IMPOSSIBLE_ACCELERATION", 1, 0.6))
    here = None if predicted is None else [x.t_ns, predicted.lat, predicted.lon]
    if here is not None and acc is not None:
        noise = (acc / R68_PER_SIGMA) ** 2
        ee, nn, en = predicted.ee + noise, predicted.nn + noise, predicted.en
        e, n = _plane(here, fix)
        if (det := ee * nn - en * en) > 0:
            innovation = (nn * e * e - 2 * en * e * n + ee * n * n) / det
            if innovation > rules.gate_reject and math.hypot(e, n) >= rules.gate_reject_m:
                hits.append(("INNOVATION_GATE", 2, 1.0))
            elif innovation > rules.gate_question:
                hits.append(("INNOVATION_GATE", 1, 0.6))
    hits += _motion_checks(own, fix, motion, rules)
    if _velocity_differs(own["recent"], fix, rules):
        hits.append(("VELOCITY_POSITION_MISMATCH", 1, 0.6))
    obd = memory.get("obd")
    obd_age = abs(fix[0] - obd[0]) / 1e9 if obd else math.inf
    if obd_age <= rules.obd_age_s and None not in (obd[1], fix[4]) and abs(fix[4] - obd[1]) > rules.obd_abs_mps + rules.obd_share * obd[1]:
        hits.append(("SPEED_OBD_MISMATCH", 1, 0.5))
    near_network = False
    if (net := memory.get("network")) is not None and (age := abs(fix[0] - net[0]) / 1e9) <= rules.network_max_age_s:
        far = _metres(net, fix) - (2 * (_or(net[3], 1000.0) + _or(acc, 50.0)) + 30 * age)
        near_network = far <= 0
        if far > 0:
            hits.append(("GEOGRAPHICALLY_IMPOSSIBLE", 2, 1.0) if far > rules.network_impossible_m else ("NETWORK_DISAGREEMENT", 1, 0.5))
    status = memory.get("status")
    if x.source == "GNSS" and status is not None and abs(fix[0] - status[0]) / 1e9 <= rules.status_age_s:
        if status[1] < rules.few_satellites:
            hits.append(("FEW_SATELLITES", 1, 0.7))
        if status[1] >= rules.uniform_satellites and status[2] < rules.uniform_db:
            hits.append(("CN0_UNIFORM", 0, 0.8))
    agrees = here is not None and acc is not None and acc <= rules.agree_acc_m and obd_age > rules.agree_obd_s and _metres(here, fix) <= rules.agree_m
    if agrees and any(r in OVERRIDDEN_BY_AGREEMENT for r, _, _ in hits):
        hits = [h for h in hits if h[0] not in OVERRIDDEN_BY_AGREEMENT] + [("AGREES_WITH_ESTIMATE", 0, 1.0)]
    return hits, innovation, implied, near_network, agrees


def assess(
    memory: dict, x: Event, rules: TrustRules = TrustRules(), motion: Tracker | None = None, predicted: Prediction | None | str = "held"
) -> tuple[str, float, list[str], float | None, float | None]:
    """State, confidence, sorted reasons, innovation and implied speed of a fix; memory (plain JSON values) is changed in place.

    motion tells turns, rest and odometry; predicted is the estimator's place at the fix's time (None: it has none), or that of the held fix.
    Our own output and fixes of replaced providers leave no trace in memory. After a rejection a source has to recover, unless a consistent
    stream of fixes resets it: after 120 s, or 15 s where the network agrees; streams that only the innovation gate questions after 10 s behind an outage.
    """
    hits = [("SYNTHETIC_INPUT", 2, 0.0)] if x.synthetic else []
    if x.provider in memory.get("overridden", []):
        hits.append(("SOURCE_OVERRIDDEN", 3, 0.0))
    elif x.source == "FUSED" and is_echo(memory, x.t_ns, rules):
        hits.append(("ECHO_OF_OUR_OUTPUT", 3, 0.0))
    if hits:
        return STATES[max(s for _, s, _ in hits)], 0.0, sorted({r for r, _, _ in hits}), None, None
    own = memory.setdefault("sources", {}).setdefault(x.source, {
        "trusted": None, "recovery": 0, "first": None, "last": None, "recent": [], "last_fix": None, "outage": False, "q_first": None, "q_last": None, "q_outage": False, "voters": [], "confirmed": [],
    })
    if predicted == "held":
        predicted = _held(memory, x.t_ns, rules)
    fix = [x.t_ns, x.lat, x.lon, x.h_acc_m, x.speed_mps, x.bearing_deg]
    innovation = implied = None
    near_network = agrees = False
    confirms: list[int] = []
    satellite = x.source in ("GNSS", "FUSED")
    if satellite:
        hits, innovation, implied, near_network, agrees = _satellite_checks(memory, own, x, fix, motion, predicted, rules)
    elif x.source == "NETWORK":
        hits = [("STALE", 1, 0.5)] if _or(x.latency_s, 0.0) > 30 else []
        hits += [("NO_ACCURACY", 2, 1.0)] if x.h_acc_m is None else [("POOR_ACCURACY", 2, 1.0)] if x.h_acc_m > 5000 else []
        said, confirms = _odometry_vote(memory, own, fix, motion, predicted, rules)
        hits += said
    worst, reasons = max((s for _, s, _ in hits), default=0), {r for r, _, _ in hits}
    outage = own["outage"] or own["last_fix"] is None or (fix[0] - own["last_fix"][0]) / 1e9 >= rules.outage_s
    own["last_fix"], own["outage"] = fix, outage
    own["recent"] = [f for f in [*own["recent"], fix] if f[0] >= fix[0] - int(rules.velocity_window_s * 1.5 * 1e9)]
    reset = False
    wait = rules.reset_with_network_s if near_network else rules.reset_after_s
    if satellite and worst == 2:
        begun = own["first"] if _consistent(own["last"], fix, rules) else fix
        own["recovery"], own["first"], own["last"] = rules.recovery_fixes, begun, fix
        if reasons <= RESETTABLE and (fix[0] - begun[0]) / 1e9 >= wait:
            reset, own["recovery"], own["first"], own["last"] = True, 0, None, None
    elif satellite and worst == 1:
        if reasons != {"INNOVATION_GATE"}:
            own["q_first"], own["q_last"], own["q_outage"] = None, None, False
        else:
            follows = _consistent(own["q_last"], fix, rules)
            begun, after = (own["q_first"], own["q_outage"]) if follows else (fix, outage)
            own["q_first"], own["q_last"], own["q_outage"] = begun, fix, after
            limit = rules.reset_after_outage_s if after else wait if innovation is not None and innovation > rules.gate_reject else math.inf
            if (fix[0] - begun[0]) / 1e9 >= limit:
                reset, own["q_first"], own["q_last"], own["q_outage"] = True, None, None, False
    elif satellite:
        own["first"] = own["last"] = own["q_first"] = own["q_last"] = None
        own["q_outage"] = False
        if own["recovery"] > 0 and agrees:
            own["recovery"], reasons = 0, reasons | {"AGREES_WITH_ESTIMATE"}
        elif own["recovery"] > 0:
            own["recovery"] -= 1
            worst, reasons = 1, reasons | {"RECOVERING"}
    if reset:
        worst, reasons = 0, {"RESET_AFTER_CONSISTENT_STREAM"}
    if worst == 0:
        own["trusted"], own["outage"], own["voters"] = fix, False, [*own["voters"], fix][-rules.voters :]
        own["confirmed"] = [t for t in {*own["confirmed"], *confirms} if any(v[0] == t for v in own["voters"])]
        if x.source == "GNSS":
            memory["held"] = fix
    if x.source == "NETWORK" and worst < 2:
        memory["network"] = fix
    confidence = min(max(math.prod([BASE_CONFIDENCE[worst], *(f for _, _, f in hits)]), 0.0), 1.0)
    return STATES[worst], confidence, sorted(reasons), innovation, implied


def _judge(memory: dict, x: Event, rules: TrustRules) -> tuple | None:
    """The output row of an event: none unless it is a fix. Events before the last one are taken all the same, and marked late."""
    late = x.t_ns < memory.get("seen", x.t_ns)
    memory["seen"] = x.t_ns
    if x.kind != "location":
        observe(memory, x)
        return None
    state, confidence, reasons, innovation, implied = assess(memory, x, rules)
    return x.seq, x.t_ns, x.source, x.provider, state, confidence, ",".join(reasons), innovation, implied, late


def events_of(locations: DataFrame, speeds: DataFrame | None = None, statuses: DataFrame | None = None, providers: DataFrame | None = None) -> DataFrame:
    """drive_id and EVENTS from record tables: location (with synthetic and latency_s), vehicle_speed, gnss_status (with used and std_db), provider_event. Rows without drive, time or place are left out; a status without a count has none in use, a speed without a number is left out."""
    def rows(df: DataFrame, kind: str, rank: int, **values) -> DataFrame:
        known = {"kind": F.lit(kind), "rank": F.lit(rank), "seq": F.col("seq"), "t_ns": F.col("t_ns")} | values
        columns = [known.get(n, F.lit(None)).cast(t).alias(n) for n, t in (c.split(" ") for c in EVENTS.split(", "))]
        return df.filter("drive_id IS NOT NULL AND t_ns IS NOT NULL").select("drive_id", *columns)

    c = F.col
    fixes = locations.filter("lat IS NOT NULL AND lon IS NOT NULL")
    out = rows(fixes, "location", 13, **{n: c(n) for n in ("source", "provider", "lat", "lon", "h_acc_m", "speed_mps", "bearing_deg", "synthetic", "latency_s", "speed_acc_mps", "bearing_acc_deg") if n in locations.columns})
    if speeds is not None:
        out = out.unionByName(rows(speeds.filter("speed_mps IS NOT NULL"), "vehicle_speed", 12, speed_mps=c("speed_mps"), **({"speed_acc_mps": c("std_mps")} if "std_mps" in speeds.columns else {})))
    if statuses is not None:
        out = out.unionByName(rows(statuses, "gnss_status", 5, used=F.coalesce("used", F.lit(0)), spread_db=F.coalesce("std_db", F.lit(0.0))))
    if providers is not None:
        out = out.unionByName(rows(providers, "provider", 2, provider=c("provider"), event=c("event")))
    return out


def trust_batch(events: DataFrame, rules: TrustRules = TrustRules()) -> DataFrame:
    """A verdict for each fix, drive by drive in the order (t_ns, rank, seq). Rows stream through a task; only one drive's memory is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drive, memory = None, {}
        for b in batches:
            out = []
            for key, *values in rows_of(b):
                if key != drive:
                    drive, memory = key, {}
                row = _judge(memory, Event(*values), rules)
                if row is not None:
                    out.append((key, *row))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(kinds), kinds)], ["drive_id", *_NAMES])

    kind = events.schema["drive_id"].dataType.simpleString()
    simple = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds = [simple[kind], *(simple[c.split(" ")[1]] for c in OUT.split(", "))]
    rows = events.select("drive_id", *COLUMNS).repartition("drive_id").sortWithinPartitions("drive_id", "t_ns", "rank", "seq")
    return rows.mapInArrow(run, f"drive_id {kind}, {OUT}")


class _Verdicts:
    """The fold over rows of a stream."""

    def __init__(self, rules: TrustRules):
        self.rules, self.memory = rules, {}

    def take(self, row: tuple, late: bool) -> list[tuple]:
        out = _judge(self.memory, Event(**dict(zip(_STREAMED, row))), self.rules)
        return [] if out is None else [out]


_STREAMED = ["t_ns", "rank", "seq", *(c for c in COLUMNS if c not in ("t_ns", "rank", "seq"))]


def trust_stream(events: DataFrame, rules: TrustRules = TrustRules(), reorder_ns: int = 500_000_000, flush_ms: int = 2000, forget_ms: int = 600_000) -> DataFrame:
    """A stream's verdicts, equal to those of trust_batch under the conditions of keyed_stream; what comes later still is judged at once and marked."""
    return keyed_stream(events.fillna({"used": 0}), _STREAMED, lambda: _Verdicts(rules), OUT, reorder_ns, flush_ms, forget_ms)
