"""Whole drives in one fold: motion tracker, trust, an estimator chosen by name, and a tick a second, in batch and in a stream.

The parts feed each other at each event (the estimate is what trust holds a fix against, its speed is what the tracker knows of stops), so
they are one state of one drive. Drives are independent: Spark spreads them over tasks, and rows stream through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivelake.streaming.batches import rows_of
from drivelake.streaming.estimators import ESTIMATORS, Estimator
from drivelake.streaming.keyed import keyed_stream
from drivelake.streaming.road_filter import road_filter_of
from drivelake.streaming.road_matcher import Network, Networks, with_networks
from drivelake.streaming.tracker import Tracker
from drivelake.streaming.trust_fold import COLUMNS, EVENTS, Event, Prediction, TrustRules, assess, events_of, observe

TICK_NS = 1_000_000_000
#: What comes out: record is verdict (seq to late) or estimate (lat to mode).
OUT = (
    "record string, t_ns long, seq long, source string, provider string, state string, confidence double, reasons string, innovation_nis double, implied_speed_mps double, late boolean, "
    "lat double, lon double, cov_ee double, cov_en double, cov_nn double, r68 double, heading_deg double, heading_std_deg double, speed_mps double, speed_std_mps double, mode string"
)
_NAMES = [c.split(" ")[0] for c in OUT.split(", ")]
_DEGREE = 57.29577951308232


class Drive:
    """The state of one drive; `take` an event in order, get the rows that it gives: ticks before it, then its verdict."""

    def __init__(self, estimator: str | Callable[[], Estimator] = "baseline", rules: TrustRules = TrustRules()):
        self.rules, self.memory = rules, {}
        self.tracker, self.estimator = Tracker(), (ESTIMATORS[estimator] if isinstance(estimator, str) else estimator)()
        self.next: int | None = None
        self.seen: int | None = None

    def take(self, x: Event) -> list[tuple]:
        out = []
        late = self.seen is not None and x.t_ns < self.seen
        self.seen = x.t_ns if self.seen is None else max(self.seen, x.t_ns)
        if self.next is None:
            self.next = -(-x.t_ns // TICK_NS) * TICK_NS
        while x.t_ns >= self.next:
            if (e := self.estimator.estimate(self.next)) is not None:
                self.tracker.speed_hint = e.speed_mps
                r68 = e.r68
                heading = None if e.heading_rad is None else e.heading_rad * _DEGREE
                std = None if e.heading_std_rad is None else e.heading_std_rad * _DEGREE
                out.append(("estimate", e.t_ns, e.t_ns, None, None, None, 1 / (1 + r68 / 50), None, None, None, False, e.lat, e.lon, e.ee, e.en, e.nn, r68, heading, std, e.speed_mps, e.speed_std_mps, e.mode))
            self.next += TICK_NS
        motion = self.tracker.take(x.kind, x.t_ns, x.event, x.speed_mps if x.kind == "vehicle_speed" else x.x, x.y, x.z, x.w)
        if motion is not None:
            self.estimator.on_motion(motion)
        if x.kind != "location":
            observe(self.memory, x)
            self.estimator.on_event(x, None)
            return out
        e = self.estimator.estimate(x.t_ns)
        predicted = None if e is None else Prediction(e.lat, e.lon, e.ee, e.en, e.nn, e.heading_rad, e.heading_std_rad)
        state, confidence, reasons, nis, implied = assess(self.memory, x, self.rules, self.tracker, predicted)
        self.estimator.on_event(x, state)
        out.append(("verdict", x.t_ns, x.seq, x.source, x.provider, state, confidence, ",".join(reasons), nis, implied, late, *[None] * 11))
        return out


def fold_events_of(tables: dict[str, DataFrame]) -> DataFrame:
    """drive_id and EVENTS of record tables (location with synthetic and latency_s, gnss_status with used and std_db, vehicle_speed, provider_event, imu, orientation, geomag, power); absent ones are empty."""
    out = events_of(tables["location"], tables.get("vehicle_speed"), tables.get("gnss_status"), tables.get("provider_event"))
    c = F.col
    others = {
        "imu": (3, {"event": c("kind"), "x": c("x"), "y": c("y"), "z": c("z")}),
        "orientation": (4, {"event": c("kind"), "x": c("qx"), "y": c("qy"), "z": c("qz"), "w": c("qw")}),
        "geomag": (10, {"x": c("declination_deg"), "y": c("inclination_deg"), "z": c("field_ut")}),
        "power": (11, {"event": c("plug"), "w": c("charging").cast("double")}),
    }
    for table, (rank, places) in others.items():
        if table in tables:
            known = {"kind": F.lit(table), "rank": F.lit(rank), "seq": c("seq"), "t_ns": c("t_ns")} | places
            df = tables[table].filter("drive_id IS NOT NULL AND t_ns IS NOT NULL")
            out = out.unionByName(df.select("drive_id", *[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in (x.split(" ") for x in EVENTS.split(", "))]))
    return out


#: Makers of estimators that need the roads near a drive, by name.
ROAD_ESTIMATORS: dict[str, Callable[[Network], Estimator]] = {"baseline-roads": road_filter_of()}


def fold_batch(events: DataFrame, estimators: dict[object, str] | str = "baseline", rules: TrustRules = TrustRules(), networks: DataFrame | None = None) -> DataFrame:
    """drive_id and OUT: each drive's verdicts and estimates, in the order (t_ns, rank, seq) of its events.

    estimators: a registered name for all drives, or names by the part of a run's key behind its last "|" (its variant). An estimator that isn't
    registered is an error. networks (road_matcher.with_networks) brings the roads for estimators that need them; a drive without has none near. Drives whose events are all others than fixes get no rows; an empty table gives an empty result.
    """
    named, by_network = [estimators] if isinstance(estimators, str) else list(estimators.values()), networks is not None
    if unknown := [n for n in named if n not in ESTIMATORS and n not in ROAD_ESTIMATORS]:
        raise ValueError(f"unknown estimators {unknown}")
    made = {n: ESTIMATORS.get(n) for n in named}  # travels to the tasks, with those that a caller registered
    on_roads = {n: ROAD_ESTIMATORS[n] for n in named if n in ROAD_ESTIMATORS}
    name_of = lambda key: estimators if isinstance(estimators, str) else estimators[str(key).rsplit("|", 1)[-1]]

    def begun(key: object, network: Network | None) -> Drive:
        name = name_of(key)
        return Drive(made[name] if name not in on_roads else lambda: on_roads[name](network or Network([])), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drive, fold, at = None, None, Networks()
        for b in batches:
            out = []
            for key, *values in rows_of(b):
                if by_network:
                    row, first = at.takes(key, *values[:2])
                    if not row:
                        continue
                    values = values[2:]
                    fold = begun(key, at.network) if first else fold
                elif fold is None or key != drive:
                    drive, fold = key, begun(key, None)
                out += [(key, *row) for row in fold.take(Event(*values))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(kinds), kinds)], ["drive_id", *_NAMES])

    kind = events.schema["drive_id"].dataType.simpleString()
    simple = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds = [simple[kind], *(simple[c.split(" ")[1]] for c in OUT.split(", "))]
    order = ["t_ns", "rank", "seq"]
    rows = events.select("drive_id", *COLUMNS).repartition("drive_id").sortWithinPartitions("drive_id", *order) if networks is None else with_networks(events, networks, COLUMNS, order)
    return rows.mapInArrow(run, f"drive_id {kind}, {OUT}")


class _Events:
    """A drive's fold over rows of a stream."""

    def __init__(self, make: Callable[[], Estimator], rules: TrustRules):
        self.drive = Drive(make, rules)

    def take(self, row: tuple, late: bool) -> list[tuple]:
        return self.drive.take(Event(**dict(zip(_STREAMED, row))))


_STREAMED = ["t_ns", "rank", "seq", *(c for c in COLUMNS if c not in ("t_ns", "rank", "seq"))]


def fold_stream(events: DataFrame, estimator: str = "baseline", rules: TrustRules = TrustRules(), reorder_ns: int = 500_000_000, flush_ms: int = 2000, forget_ms: int = 600_000) -> DataFrame:
    """A stream's rows, equal to those of fold_batch under the conditions of keyed_stream; what comes later is marked late."""
    make = ESTIMATORS[estimator]
    return keyed_stream(events.fillna({"used": 0}), _STREAMED, lambda: _Events(make, rules), OUT, reorder_ns, flush_ms, forget_ms)


def verdicts_of(rows: DataFrame) -> DataFrame:
    """The verdicts among rows of a fold."""
    return rows.filter("record = 'verdict'").select("drive_id", *_NAMES[1:11])


def estimates_of(rows: DataFrame) -> DataFrame:
    """The estimates at ticks among rows of a fold, as replays want them."""
    return rows.filter("record = 'estimate'").select("drive_id", "t_ns", "lat", "lon", "r68", "heading_deg", "speed_mps", "mode", "confidence", "cov_ee", "cov_en", "cov_nn", "heading_std_deg", "speed_std_mps")
