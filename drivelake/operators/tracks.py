"""Operators on time-ordered tracks: steps, as-of and interval joins, ticks, gaps, windows. All are plain column expressions.

A track table has drive_id, t_ns and seq; every window is by drive in the order (t_ns, seq), so ties have one order. One shuffle by
drive_id serves all windows of a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivelake.functions import geo

SECOND = 1_000_000_000


def by_drive() -> Window:
    return Window.partitionBy("drive_id").orderBy("t_ns", "seq")


def range_frame(seconds: float) -> Window:
    """The rows of the last so many seconds, this one and its equals in time included."""
    return Window.partitionBy("drive_id").orderBy("t_ns").rangeBetween(-int(seconds * SECOND), 0)


def with_steps(fixes: DataFrame) -> DataFrame:
    """Adds dt_s, step_m and the implied speed against the fix of the same source before: null for the first one.

    Half the sum of both accuracies, twice over, is allowed before distance counts as movement.
    """
    w = Window.partitionBy("drive_id", "source").orderBy("t_ns", "seq")
    before = {c: F.lag(c).over(w) for c in ("t_ns", "lat", "lon", "h_acc_m")}
    out = fixes.withColumns({f"_{c}": x for c, x in before.items()})
    dt = (F.col("t_ns") - F.col("_t_ns")) / F.lit(1e9)
    step = geo.haversine_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    allowed = 2 * (F.coalesce("_h_acc_m", F.lit(50.0)) + F.coalesce("h_acc_m", F.lit(50.0)))
    implied = F.when(dt > 0, geo.clamp(step - allowed, 0.0, float("inf")) / F.greatest(dt, F.lit(0.5)))
    return out.withColumns({"dt_s": dt, "step_m": step, "implied_mps": implied}).drop(*(f"_{c}" for c in before))


def with_last(fixes: DataFrame, when: Column, columns: dict[str, Column]) -> DataFrame:
    """As-of join of a track with itself: for each row the values of the last row before it (in order) where `when` holds."""
    frame = by_drive().rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(when, F.struct(*(c.alias(n) for n, c in columns.items()))), ignorenulls=True).over(frame)
    out = fixes.withColumn("_last", last)
    return out.select(*fixes.columns, *(F.col("_last")[n].alias(n) for n in columns))


def before(rows: DataFrame, others: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """As as_of, but of what comes before each row in the order (t_ns, seq), so a row isn't its own."""
    mine = rows.select("drive_id", "t_ns", "seq", F.lit(0).alias("_k"), F.struct(*rows.columns).alias("_row"), F.lit(True).alias("_is"))
    theirs = others.select("drive_id", "t_ns", "seq", F.lit(1).alias("_k"), F.struct(*(c.alias(n) for n, c in columns.items())).alias("_o"), F.lit(False).alias("_is"))
    w = Window.partitionBy("drive_id").orderBy("t_ns", "seq", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = mine.unionByName(theirs, allowMissingColumns=True).withColumn("_last", F.last("_o", ignorenulls=True).over(w)).filter("_is")
    return both.select("_row.*", *(F.col("_last")[n].alias(n) for n in columns))


def as_of(rows: DataFrame, others: DataFrame, columns: dict[str, Column], strict: bool = False) -> DataFrame:
    """Each row with values of the last row of others (drive_id, t_ns, seq) in its drive that isn't later; null without one.

    At equal times others come first, or not at all if strict. Both go through one shuffle and one sort by drive; nothing is multiplied.
    """
    mine = rows.select("drive_id", "t_ns", "seq", F.lit(0 if strict else 1).alias("_k"), F.struct(*rows.columns).alias("_row"), F.lit(True).alias("_is"))
    theirs = others.select("drive_id", "t_ns", "seq", F.lit(1 if strict else 0).alias("_k"), F.struct(*(c.alias(n) for n, c in columns.items())).alias("_o"), F.lit(False).alias("_is"))
    w = Window.partitionBy("drive_id").orderBy("t_ns", "_k", "seq").rowsBetween(Window.unboundedPreceding, 0)
    both = mine.unionByName(theirs, allowMissingColumns=True).withColumn("_last", F.last("_o", ignorenulls=True).over(w)).filter("_is")
    return both.select("_row.*", *(F.col("_last")[n].alias(n) for n in columns))


def brackets(track: DataFrame, columns: list[str]) -> DataFrame:
    """Each sample with the next one: t0, t1 and both values of each column (b null for the last). Of equal times the last stays."""
    latest = Window.partitionBy("drive_id", "t_ns").orderBy(F.desc("seq"))
    one = track.withColumn("_n", F.row_number().over(latest)).filter("_n = 1")
    w = Window.partitionBy("drive_id").orderBy("t_ns")
    pairs = [x for c in columns for x in (F.col(c).alias(f"{c}_a"), F.lead(c).over(w).alias(f"{c}_b"))]
    return one.select("drive_id", F.col("t_ns").alias("t0"), F.lead("t_ns").over(w).alias("t1"), *pairs)


def interpolate(rows: DataFrame, track: DataFrame, max_gap_s: float = 3.0) -> DataFrame:
    """truth_lat, truth_lon, truth_speed, truth_bearing of a track at each row's time; null where it has none.

    An exact hit takes the sample. Between two samples not more than max_gap_s apart the values are linear and the bearing takes
    the shorter arc. An equi-join on drive and time bucket finds brackets (each spans two buckets at most); the exact
    bounds are checked after it.
    """
    gap = int(max_gap_s * SECOND)
    b = brackets(track, ["lat", "lon", "speed_mps", "bearing_deg"])
    usable = F.col("t1").isNotNull() & (F.col("t1") - F.col("t0") <= gap)
    bucket = lambda c: F.expr(f"({c} - pmod({c}, {gap}L)) DIV {gap}L")  # noqa: E731  (in whole numbers)
    b = b.withColumn("_bucket", F.explode(F.sequence(bucket("t0"), F.when(usable, bucket("t1")).otherwise(bucket("t0")))))
    b = b.withColumnRenamed("drive_id", "_drive")
    left = rows.withColumn("_b", bucket("t_ns"))
    hit = (F.col("t_ns") == F.col("t0")) | (usable & (F.col("t_ns") > F.col("t0")) & (F.col("t_ns") < F.col("t1")))
    both = left.join(b, (F.col("drive_id") == F.col("_drive")) & (F.col("_b") == F.col("_bucket")) & hit, "left")
    u = F.when(F.col("t_ns") == F.col("t0"), 0.0).otherwise((F.col("t_ns") - F.col("t0")) / (F.col("t1") - F.col("t0")))

    def line(a: Column, b: Column) -> Column:
        return F.when(u == 0, a).otherwise(a + u * (b - a))

    turn = geo.wrap_deg(F.col("bearing_deg_b") - F.col("bearing_deg_a"))
    return both.select(
        *rows.columns,
        line(F.col("lat_a"), F.col("lat_b")).alias("truth_lat"),
        geo.wrap_deg(F.when(u == 0, F.col("lon_a")).otherwise(F.col("lon_a") + u * geo.wrap_deg(F.col("lon_b") - F.col("lon_a")))).alias("truth_lon"),
        line(F.col("speed_mps_a"), F.col("speed_mps_b")).alias("truth_speed"),
        F.when(u == 0, F.col("bearing_deg_a")).otherwise(F.pmod(F.col("bearing_deg_a") + u * turn, F.lit(360.0))).alias("truth_bearing"),
    )


def tick_grid(track: DataFrame, period_s: float = 1.0) -> DataFrame:
    """Every full period of each drive from its first time on; none after its last."""
    p = int(period_s * SECOND)
    span = track.groupBy("drive_id").agg(F.min("t_ns").alias("a"), F.max("t_ns").alias("b"))
    # In whole numbers: doubles can't tell nanoseconds apart at the size of an epoch.
    before = F.col("a") + (p - 1)
    first = before - F.pmod(before, F.lit(p))
    return span.filter(first <= F.col("b")).select("drive_id", F.explode(F.sequence(first, F.col("b"), F.lit(p))).alias("t_ns"))


def gap_sessions(track: DataFrame, gap_s: float) -> DataFrame:
    """Runs without a gap of gap_s or more: drive_id, session (from 0), t0, t1, n."""
    broken = F.coalesce((F.col("t_ns") - F.lag("t_ns").over(by_drive()) >= int(gap_s * SECOND)).cast("long"), F.lit(0))
    numbered = track.withColumn("_new", broken).withColumn("session", F.sum("_new").over(by_drive().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("drive_id", "session").agg(F.min("t_ns").alias("t0"), F.max("t_ns").alias("t1"), F.count("*").alias("n"))


def velocity_consistency(fixes: DataFrame, window_s: float = 10.0, slack_m: float = 15.0, max_step_s: float = 3.0) -> DataFrame:
    """Displacement over about window_s against the integral of the reported velocity, for one source's fixes.

    Adds span_s, diff_m, mismatch: null where the fixes of the last 1.2 windows span less than 0.6 of one, a step among them takes
    over max_step_s or no time, or one of them has no speed (or no bearing at 1 m/s or more). Cumulative trapezoids make the integral a difference of two values, so no list of fixes is collected.
    """
    w = Window.partitionBy("drive_id").orderBy("t_ns", "seq")
    fast = F.col("speed_mps") >= 1.0
    b = F.when(fast, F.radians("bearing_deg")).otherwise(0.0)
    f = fixes.withColumns({"_ve": F.col("speed_mps") * F.sin(b), "_vn": F.col("speed_mps") * F.cos(b)})
    f = f.withColumn("_dt", (F.col("t_ns") - F.lag("t_ns").over(w)) / F.lit(1e9))
    f = f.withColumns({f"_s{x}": F.coalesce(0.5 * (F.col(f"_v{x}") + F.lag(f"_v{x}").over(w)) * F.col("_dt"), F.lit(0.0)) for x in "en"})
    # A step counts against a window that holds both its ends; a fix without velocity against every window that holds it.
    unknown = F.col("speed_mps").isNull() | (fast & F.col("bearing_deg").isNull())
    f = f.withColumns({"_bad": F.coalesce(((F.col("_dt") <= 0) | (F.col("_dt") > max_step_s)).cast("long"), F.lit(0)), "_no": unknown.cast("long")})
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumns({"_ce": F.sum("_se").over(to_here), "_cn": F.sum("_sn").over(to_here), "_cb": F.sum("_bad").over(to_here), "_cu": F.sum("_no").over(to_here)})
    first = F.min(F.struct("t_ns", "seq", "lat", "lon", "h_acc_m", "_ce", "_cn", "_cb", "_cu", "_no")).over(range_frame(1.2 * window_s))
    f = f.withColumn("_f", first)
    span = (F.col("t_ns") - F.col("_f.t_ns")) / F.lit(1e9)
    e, n = geo.to_enu(F.col("_f.lat"), F.col("_f.lon"), F.col("lat"), F.col("lon"))
    diff = F.hypot(e - (F.col("_ce") - F.col("_f._ce")), n - (F.col("_cn") - F.col("_f._cn")))
    fit = (span >= 0.6 * window_s) & (F.col("_cb") == F.col("_f._cb")) & (F.col("_cu") == F.col("_f._cu") - F.col("_f._no"))
    allowed = slack_m + 2 * (F.coalesce("_f.h_acc_m", F.lit(20.0)) + F.coalesce("h_acc_m", F.lit(20.0)))
    return f.select(*fixes.columns, F.when(fit, span).alias("span_s"), F.when(fit, diff).alias("diff_m"), F.when(fit, diff > allowed).alias("mismatch"))
