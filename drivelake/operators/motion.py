"""Motion from sensors as window expressions: shaking, stillness, dead reckoning, up vectors, stop scores, least squares.

Tables have drive_id, t_ns, seq; windows are by drive. Null samples are left out of means; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivelake.operators.tracks import SECOND, by_drive, range_frame

#: Spread of acceleration and mean turn rate under which a device is still, and loosely still; samples that a window needs.
STILL, LOOSE, SAMPLES = (0.12, 0.03), (0.3, 0.02), 10
#: A speed is used for dead reckoning for so long.
SPEED_AGE_NS = 1_500_000_000


def _norm() -> Column:
    return F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))


def shaking(imu: DataFrame, window_s: float = 1.0) -> DataFrame:
    """For each accelerometer or gyroscope row: acc_std (sample deviation of |a|, null below two), gyro_mean (0 without samples), still and still_loose over the last window.

    Both need SAMPLES samples of each sensor in the window.
    """
    rows = imu.filter(F.col("kind").isin("ACCEL", "GYRO")).withColumn("_n", _norm())
    a, g = (F.when(F.col("kind") == k, F.col("_n")) for k in ("ACCEL", "GYRO"))
    w = range_frame(window_s)
    out = rows.withColumns({"acc_n": F.count(a).over(w), "gyro_n": F.count(g).over(w), "acc_std": F.stddev_samp(a).over(w), "gyro_mean": F.coalesce(F.avg(g).over(w), F.lit(0.0))})
    full = (F.col("acc_n") >= SAMPLES) & (F.col("gyro_n") >= SAMPLES)
    under = lambda t: full & (F.col("acc_std") < t[0]) & (F.col("gyro_mean") < t[1])
    return out.withColumns({"still": under(STILL), "still_loose": under(LOOSE)}).drop("_n")


def rms(rows: DataFrame, value: Column, window_s: float, name: str) -> DataFrame:
    """Root mean square of a value over the last window; 0 without values."""
    return rows.withColumn(name, F.coalesce(F.sqrt(F.avg(value * value).over(range_frame(window_s))), F.lit(0.0)))


def held_for(rows: DataFrame, holds: Column, name: str, bridge_s: float | None = None) -> DataFrame:
    """Seconds since a condition began to hold without a break; 0 where it doesn't hold.

    With bridge_s, rows where it fails don't break a run if the condition held at most bridge_s before.
    """
    on = F.coalesce(holds, F.lit(False))
    w = by_drive()
    rows = rows.withColumn("_on", on)
    if bridge_s is None:
        breaks = (~F.col("_on")).cast("long")
    else:
        before = F.last(F.when(F.col("_on"), F.col("t_ns")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        breaks = F.when(F.col("_on") & (before.isNull() | ((F.col("t_ns") - before) / F.lit(1e9) > bridge_s)), 1).otherwise(0)
    rows = rows.withColumn("_b", breaks).withColumn("_run", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    begun = F.min(F.when(F.col("_on"), F.struct("t_ns", "seq"))).over(Window.partitionBy("drive_id", "_run"))
    return rows.withColumn(name, F.when(F.col("_on"), (F.col("t_ns") - begun["t_ns"]) / F.lit(1e9)).otherwise(0.0)).drop("_on", "_b", "_run")


def dead_reckoning(updates: DataFrame) -> DataFrame:
    """Adds bearing, east, north, way (cumulative) and gaps to motion updates: drive_id, t_ns, seq, rate (rad/s, counter-clockwise), speed, speed_t_ns.

    A step lasts from the update before; its bearing is that at its end. Without a speed of the last SPEED_AGE_NS a step of some length is
    a gap and adds no way. The first update of a drive adds nothing.
    """
    w = by_drive()
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    dt = F.coalesce((F.col("t_ns") - F.lag("t_ns").over(w)) / F.lit(1e9), F.lit(0.0))
    u = updates.withColumn("_dt", dt)
    u = u.withColumn("bearing", -F.sum(F.col("rate") * F.col("_dt")).over(to_here))
    fresh = F.coalesce(F.col("speed").isNotNull() & (F.col("t_ns") - F.col("speed_t_ns") <= SPEED_AGE_NS), F.lit(False))
    step = F.when(fresh, F.col("speed") * F.col("_dt")).otherwise(0.0)
    u = u.withColumns({"_e": step * F.sin("bearing"), "_n": step * F.cos("bearing"), "_d": step, "_g": (~fresh & (F.col("_dt") > 0)).cast("long")})
    return u.withColumns({n: F.sum(c).over(to_here) for n, c in (("east", "_e"), ("north", "_n"), ("way", "_d"), ("gaps", "_g"))}).drop("_dt", "_e", "_n", "_d", "_g")


def way_between(pairs: DataFrame, reckoned: DataFrame, slack_ns: int = 200_000_000) -> DataFrame:
    """What dead reckoning tells of the time between two moments: way_m, chord_m and turn (rad, clockwise); null where history or speed is missing.

    pairs: drive_id, id, t1, t2. Each moment is interpolated between the updates round it; up to slack_ns after the last one that one holds.
    Moments meet updates by an equi-join on drive and half-minute bucket, so no moment meets all updates of its drive.
    """
    w = Window.partitionBy("drive_id").orderBy("t_ns", "seq")
    values = ("bearing", "east", "north", "way", "gaps")
    latest = Window.partitionBy("drive_id", "t_ns").orderBy(F.desc("seq"))
    one = reckoned.withColumn("_i", F.row_number().over(latest)).filter("_i = 1")
    br = one.select("drive_id", F.col("t_ns").alias("_a"), F.lead("t_ns").over(w).alias("_b"), *(x for v in values for x in (F.col(v).alias(f"{v}_a"), F.lead(v).over(w).alias(f"{v}_b"))))
    size = 30 * SECOND
    cell = lambda c: F.floor(c / F.lit(size))
    end = F.coalesce(F.col("_b"), F.col("_a") + slack_ns)
    br = br.withColumn("_cell", F.explode(F.sequence(cell(F.col("_a")), cell(end))))
    moments = pairs.select("drive_id", "id", F.explode(F.array(F.struct(F.lit(1).alias("w"), F.col("t1").alias("t")), F.struct(F.lit(2).alias("w"), F.col("t2").alias("t")))).alias("m")).select("drive_id", "id", "m.*")
    moments = moments.withColumn("_cell", cell(F.col("t")))
    hit = moments.join(br, ["drive_id", "_cell"]).filter((F.col("t") >= F.col("_a")) & F.when(F.col("_b").isNull(), F.col("t") <= F.col("_a") + slack_ns).otherwise(F.col("t") < F.col("_b")))
    f = F.when(F.col("_b").isNull(), 0.0).otherwise((F.col("t") - F.col("_a")) / (F.col("_b") - F.col("_a")))
    at = {v: F.col(f"{v}_a") + F.when(f > 0, f * (F.col(f"{v}_b") - F.col(f"{v}_a"))).otherwise(0.0) for v in values[:4]}
    hit = hit.select("drive_id", "id", "w", *(c.alias(n) for n, c in at.items()), F.col("gaps_a").alias("g1"), F.coalesce("gaps_b", "gaps_a").alias("g2"))
    pick = lambda n, k: F.max(F.when(F.col("w") == k, F.col(n)))
    g = hit.groupBy("drive_id", "id").agg(*(pick(v, k).alias(f"{v}{k}") for v in values[:4] for k in (1, 2)), pick("g1", 1).alias("_g1"), pick("g2", 2).alias("_g2"))
    whole = F.col("_g1") == F.col("_g2")
    d = lambda v: F.col(f"{v}2") - F.col(f"{v}1")
    g = g.select("drive_id", "id", F.when(whole, d("way")).alias("way_m"), F.when(whole, F.hypot(d("east"), d("north"))).alias("chord_m"), d("bearing").alias("turn"))
    return pairs.select("drive_id", "id").join(g, ["drive_id", "id"], "left")


def unwrapped(rows: DataFrame, angle: str, name: str) -> DataFrame:
    """A sequence of angles (rad) without jumps of a full turn: each follows the one before by the shorter way. Null angles give null and end the sums."""
    w = by_drive()
    d = F.col(angle) - F.lag(angle).over(w)
    # Jumps of less than three half turns are compared as they are: divided, one just inside a half turn rounds to it.
    full = 2 * math.pi
    turn = F.when(F.abs(d) >= 1.5 * full, d - full * F.ceil((d - math.pi) / full)).when(d > math.pi, d - full).when(d <= -math.pi, d + full).otherwise(d)
    rows = rows.withColumn("_d", F.coalesce(turn, F.lit(0.0)))
    return rows.withColumn(name, F.first(angle).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def last_n(rows: DataFrame, value: Column, n: int, name: str) -> DataFrame:
    """The values of the last n rows up to this one, oldest first."""
    return rows.withColumn(name, F.collect_list(value).over(by_drive().rowsBetween(1 - n, 0)))


def up_vectors(imu: DataFrame, half_s: int = 60) -> DataFrame:
    """drive_id, second, ux, uy, uz: direction of the summed acceleration over half_s seconds either way, for each second with samples. Seconds count from the drive's first row; sums are made by second first."""
    t0 = F.min("t_ns").over(Window.partitionBy("drive_id"))
    rows = imu.withColumn("_t0", t0).filter("kind = 'ACCEL'")
    bins = rows.groupBy("drive_id", F.floor((F.col("t_ns") - F.col("_t0")) / F.lit(SECOND)).alias("second")).agg(*(F.sum(c).alias(c) for c in "xyz"))
    w = Window.partitionBy("drive_id").orderBy("second").rangeBetween(-half_s, half_s)
    s = bins.select("drive_id", "second", *(F.sum(c).over(w).alias(c) for c in "xyz"))
    return s.select("drive_id", "second", *((F.col(c) / _norm()).alias(f"u{c}") for c in "xyz"))


def field_stats(imu: DataFrame) -> DataFrame:
    """drive_id, n, min, median and max of the raw magnetic field's norm, and its largest component: of the uncalibrated sensor, and of the calibrated one until the first uncalibrated row."""
    raw = F.last(F.when(F.col("kind") == "MAG_UNCAL", 1), ignorenulls=True).over(by_drive().rowsBetween(Window.unboundedPreceding, 0))
    m = imu.filter(F.col("kind").isin("MAG", "MAG_UNCAL")).withColumn("_raw", raw).filter((F.col("kind") == "MAG_UNCAL") | F.col("_raw").isNull()).withColumn("_n", _norm())
    return m.groupBy("drive_id").agg(F.count("*").alias("n"), F.min("_n").alias("min_ut"), F.percentile("_n", 0.5).alias("median_ut"), F.max("_n").alias("max_ut"), F.max(F.greatest(*(F.abs(c) for c in "xyz"))).alias("max_component_ut"))


def seconds_in_state(rows: DataFrame, state: Column) -> DataFrame:
    """drive_id, seconds: time from each row in the state to the row after it."""
    w = by_drive()
    held = F.when(F.lag(F.coalesce(state, F.lit(False))).over(w), (F.col("t_ns") - F.lag("t_ns").over(w)) / F.lit(1e9))
    return rows.withColumn("_s", held).groupBy("drive_id").agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("seconds"))


def heading_stats(rows: DataFrame) -> DataFrame:
    """mode (null: all of a drive), n, p50_deg, p95_deg, within_2sigma of heading errors: drive_id, mode, err_deg, sigma_deg. Rows without an error don't count."""
    r = rows.filter("err_deg IS NOT NULL")
    return r.rollup("drive_id", "mode").agg(
        F.count("*").alias("n"), F.percentile("err_deg", 0.5).alias("p50_deg"), F.percentile("err_deg", 0.95).alias("p95_deg"), F.avg((F.col("err_deg") <= 2 * F.col("sigma_deg")).cast("double")).alias("within_2sigma"), F.grouping_id().alias("_g")
    ).filter("_g < 2").drop("_g")


def recent_slope(rows: DataFrame, value: str, window_s: float, name: str, least: int = 3) -> DataFrame:
    """Least-squares slope a second of a value over the last window; 0 below `least` rows or where they are at one time."""
    w = range_frame(window_s)
    t0 = F.min("t_ns").over(Window.partitionBy("drive_id"))
    rows = rows.withColumn("_t", (F.col("t_ns") - t0) / F.lit(1e9))
    n, spread = F.count(value).over(w), F.var_pop(F.when(F.col(value).isNotNull(), F.col("_t"))).over(w)
    slope = F.covar_pop(value, "_t").over(w) / spread
    return rows.withColumn(name, F.when((n >= least) & (spread * n > 1e-6), slope).otherwise(0.0)).drop("_t")


def circle_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares circles through points x, y (x^2 + y^2 = 2 a x + 2 b y + c): keys, n, a, b, radius. Null where points don't tell: fewer than three, or on a line.

    Sums of centred powers are enough, so each task sends one row a group.
    """
    c = points.groupBy(*keys).agg(F.count("*").alias("_n0"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    p = points.join(c, keys).withColumns({"_u": F.col("x") - F.col("_mx"), "_v": F.col("y") - F.col("_my")})
    u, v = F.col("_u"), F.col("_v")
    s = p.groupBy(*keys).agg(F.count("*").alias("n"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"), F.sum(u * (u * u + v * v)).alias("ru"), F.sum(v * (u * u + v * v)).alias("rv"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    fits = (F.col("n") >= 3) & (det > 1e-9 * F.col("uu") * F.col("vv"))
    a = (F.col("ru") * F.col("vv") - F.col("rv") * F.col("uv")) / (2 * det)
    b = (F.col("rv") * F.col("uu") - F.col("ru") * F.col("uv")) / (2 * det)
    radius = F.sqrt(a * a + b * b + (F.col("uu") + F.col("vv")) / F.col("n"))
    return s.select(*keys, "n", F.when(fits, F.col("_mx") + a).alias("a"), F.when(fits, F.col("_my") + b).alias("b"), F.when(fits, radius).alias("radius"))


def ellipse_fit(points: DataFrame, keys: list[str], axes_ratio: float = 2.0) -> DataFrame:
    """Least-squares ellipses A x^2 + B x y + C y^2 + D x + E y = 1 around the mean of points x, y: keys, n, a, b (the centre), w11, w12, w22, radius.

    The symmetric matrix w makes the ellipse a circle of the radius. Null where points don't tell (fewer than six, or on a line or conic of another
    kind) or where one axis is more than axes_ratio times the other. Sums of centred powers are enough, so each task sends one row a group; the
    five normal equations are solved by elimination in columns.
    """
    c = points.groupBy(*keys).agg(F.count("*").alias("_n0"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    u, v = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")
    basis = [u * u, u * v, v * v, u, v]
    sums = {f"_s{i}{j}": F.sum(basis[i] * basis[j]) for i in range(5) for j in range(i, 5)} | {f"_s{i}5": F.sum(basis[i]) for i in range(5)}
    s = points.join(c, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), *(e.alias(k) for k, e in sums.items()))
    name = lambda i, j: f"_s{min(i, j)}{max(i, j)}" if j < 5 else f"_s{i}5"
    s = s.withColumns({f"_e0{i}{j}": F.col(name(i, j)) for i in range(5) for j in range(6)})
    for k in range(5):
        pivot = F.nullif(F.col(f"_e{k}{k}{k}"), F.lit(0.0))
        s = s.withColumns({f"_e{k + 1}{i}{j}": F.col(f"_e{k}{i}{j}") - F.col(f"_e{k}{i}{k}") / pivot * F.col(f"_e{k}{k}{j}") for i in range(k + 1, 5) for j in range(k + 1, 6)})
    for i in range(4, -1, -1):
        rest = F.col(f"_e{i}{i}5")
        for j in range(i + 1, 5):
            rest = rest - F.col(f"_e{i}{i}{j}") * F.col(f"_x{j}")
        s = s.withColumn(f"_x{i}", rest / F.nullif(F.col(f"_e{i}{i}{i}"), F.lit(0.0)))
    a, b, cc, d, e = (F.col(f"_x{i}") for i in range(5))
    s = s.withColumn("_det", 4 * a * cc - b * b)
    s = s.withColumns({"_cx": (b * e - 2 * cc * d) / F.nullif(F.col("_det"), F.lit(0.0)), "_cy": (b * d - 2 * a * e) / F.nullif(F.col("_det"), F.lit(0.0))})
    level = 1 + a * F.col("_cx") * F.col("_cx") + b * F.col("_cx") * F.col("_cy") + cc * F.col("_cy") * F.col("_cy")
    s = s.withColumn("_k", F.when((F.col("n") >= 6) & (a > 0) & (cc > 0) & (F.col("_det") > 0) & (level > 0), level))
    m11, m12, m22 = a / F.col("_k"), b / 2 / F.col("_k"), cc / F.col("_k")
    half = F.sqrt((m11 - m22) / 2 * ((m11 - m22) / 2) + m12 * m12)
    s = s.withColumns({"_l1": F.sqrt((m11 + m22) / 2 + half), "_l2": F.sqrt(F.greatest((m11 + m22) / 2 - half, F.lit(0.0))), "_m11": m11, "_m12": m12, "_m22": m22})
    fits = (F.col("_l2") > 0) & (F.col("_l1") <= axes_ratio * F.col("_l2"))
    # The square root of a symmetric 2 x 2 matrix: (M + sqrt(det) I) / sqrt(trace + 2 sqrt(det)).
    l1, l2 = F.col("_l1"), F.col("_l2")
    radius = 1 / F.sqrt(l1 * l2)
    root = lambda m, diagonal: (F.col(m) + (l1 * l2 if diagonal else F.lit(0.0))) / (l1 + l2) * radius
    values = {"a": F.col("_mx") + F.col("_cx"), "b": F.col("_my") + F.col("_cy"), "w11": root("_m11", True), "w12": root("_m12", False), "w22": root("_m22", True), "radius": radius}
    return s.select(*keys, "n", *(F.when(fits, x).alias(k) for k, x in values.items()))


def widest(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and the largest distance between two points x, y of a group. A group's points come as one array: a compass has 31 centres in five minutes at most. Points with a null are left out."""
    g = points.filter("x IS NOT NULL AND y IS NOT NULL").groupBy(*keys).agg(F.collect_list(F.struct("x", "y")).alias("p"))
    apart = F.transform("p", lambda i: F.array_max(F.transform("p", lambda j: F.hypot(i["x"] - j["x"], i["y"] - j["y"]))))
    return g.select(*keys, F.size("p").alias("n"), F.array_max(apart).alias("widest"))


def signed_median(samples: DataFrame, column: str, first: int = 50, step: float = 0.02) -> DataFrame:
    """samples with running: the mean of a drive's first values, which each later one moves a step toward itself. Rows where the column is null have what was before.

    Each drive's rows stream through a task in the order (t_ns, seq) with two numbers kept.
    """
    at = samples.columns.index(column), samples.columns.index("drive_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drive, n, now = None, 0, None
        for b in batches:
            out = []
            for v, key in zip(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist()):
                if key != drive:
                    drive, n, now = key, 0, None
                if v is not None:
                    n += 1
                    now = v if n == 1 else now + ((v - now) / n if n <= first else step * ((v > now) - (v < now)))
                out.append(now)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "running"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in samples.dtypes)
    return samples.repartition("drive_id").sortWithinPartitions("drive_id", "t_ns", "seq").mapInArrow(run, f"{kinds}, running double")


def stop_score(ticks: DataFrame) -> DataFrame:
    """How well estimated speeds tell standing from driving, for each drive.

    ticks: drive_id, t_ns, seq, truth, speed (m/s); rows without one of them don't count. A false stop is an estimate under 0.5 while the truth is
    over 3; its longest run joins rows less than 1.1 s apart. A stop is a truth of 0.5 at most; missed where the estimate is 0.5 or more. Five
    stop rows or more in a row (at most 1.1 s apart) are a sustained stop.
    """
    w = by_drive()
    r = ticks.filter("truth IS NOT NULL AND speed IS NOT NULL AND NOT isnan(truth) AND NOT isnan(speed)").withColumn("v", F.abs("speed"))
    false_stop, stop = (F.col("truth") > 3) & (F.col("v") < 0.5), F.col("truth") <= 0.5
    r = r.withColumns({"_f": false_stop, "_s": stop})

    def runs(flag: str, gap: Column) -> DataFrame:
        """Rows with the flag, numbered by run: rows apart by gap, or (for stops) by a row without the flag, begin a new one."""
        return r.withColumn("_gap", F.coalesce(gap, F.lit(True)).cast("long")).withColumn("_run", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(flag)

    seconds = (F.col("t_ns") - F.last(F.when(F.col("_f"), F.col("t_ns")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))) / F.lit(1e9)
    longest = runs("_f", F.when(F.col("_f"), seconds.isNull() | (seconds >= 1.1)).otherwise(False)).groupBy("drive_id", "_run").count().groupBy("drive_id").agg(F.max("count").alias("longest_false_stop"))
    apart = ~F.lag("_s").over(w) | ((F.col("t_ns") - F.lag("t_ns").over(w)) / F.lit(1e9) > 1.1)
    sustained = runs("_s", F.when(F.col("_s"), apart).otherwise(False)).groupBy("drive_id", "_run").count().filter("count >= 5").groupBy("drive_id").agg(F.count("*").alias("sustained_stops"))
    out = r.groupBy("drive_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("truth") > 3).alias("moving"), F.count_if("_f").alias("false_stops"), F.count_if("_s").alias("stops"), F.count_if(F.col("_s") & (F.col("v") >= 0.5)).alias("missed_stops"),
        F.coalesce(F.sum(F.when(F.col("_s"), F.col("v"))), F.lit(0.0)).alias("travel_in_stops_m"),
    )
    out = out.join(longest, "drive_id", "left").join(sustained, "drive_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("longest_false_stop", "sustained_stops")})


def departures(ticks: DataFrame) -> DataFrame:
    """For each sustained stop (see stop_score) that a departure follows within 30 s: drive_id, end_ns, departure_ns, delay_s (to the estimate's own move within 15 s, else null), stopped_before."""
    w = by_drive()
    r = ticks.filter("truth IS NOT NULL AND speed IS NOT NULL AND NOT isnan(truth) AND NOT isnan(speed)").withColumns({"v": F.abs("speed"), "_s": F.col("truth") <= 0.5})
    apart = ~F.lag("_s").over(w) | ((F.col("t_ns") - F.lag("t_ns").over(w)) / F.lit(1e9) > 1.1)
    r = r.withColumn("_run", F.sum(F.when(F.col("_s"), F.coalesce(apart, F.lit(True))).otherwise(False).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    later = Window.partitionBy("drive_id").orderBy("t_ns")
    r = r.withColumns({
        "_go": F.min(F.when(F.col("truth") > 2, F.col("t_ns"))).over(later.rangeBetween(1, 30 * SECOND)),
        "_moves": F.min(F.when(F.col("v") > 0.5, F.col("t_ns"))).over(later.rangeBetween(0, 15 * SECOND)),
    })
    ends = r.filter("_s").groupBy("drive_id", "_run").agg(F.count("*").alias("_n"), F.max_by(F.struct("t_ns", "_go", "v"), F.struct("t_ns", "seq")).alias("_e")).filter("_n >= 5")
    ends = ends.select("drive_id", F.col("_e.t_ns").alias("end_ns"), F.col("_e._go").alias("departure_ns"), (F.col("_e.v") < 0.5).alias("stopped_before")).filter("departure_ns IS NOT NULL")
    exits = r.groupBy("drive_id", F.col("t_ns").alias("departure_ns")).agg(F.min("_moves").alias("_m"))
    out = ends.join(exits, ["drive_id", "departure_ns"])
    return out.select("drive_id", "end_ns", "departure_ns", ((F.col("_m") - F.col("departure_ns")) / F.lit(1e9)).alias("delay_s"), "stopped_before")


def travelled(speeds: DataFrame, scale: float = 1.0, max_step_s: float = 2.0) -> DataFrame:
    """Adds way_m to recorded speeds (drive_id, t_ns, seq, speed_mps): the sum of speed times step, each taken at the step's beginning; steps of max_step_s or more add nothing."""
    w = by_drive()
    dt = (F.col("t_ns") - F.lag("t_ns").over(w)) / F.lit(1e9)
    step = F.when(dt < max_step_s, F.lag("speed_mps").over(w) * dt * scale).otherwise(0.0)
    return speeds.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("way_m", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def outside_intervals(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows that lie in none of their drive's intervals (drive_id, from_ns, until_ns; both ends belong). A drive's intervals come as one array by an equi-join."""
    every = intervals.groupBy("drive_id").agg(F.collect_list(F.struct("from_ns", "until_ns")).alias("_iv"))
    t = F.col("t_ns")
    both = rows.join(every, "drive_id", "left")
    return both.filter(F.col("_iv").isNull() | ~F.exists("_iv", lambda i: (t >= i["from_ns"]) & (t <= i["until_ns"]))).select(*rows.columns)


def low_pass(samples: DataFrame, columns: list[str], tau_s: float, most_s: float = 0.5) -> DataFrame:
    """samples with smooth_<column>: each sample moves it by 1 - exp(-step / tau_s) of its distance; the first one is where it begins.

    Steps are as irregular as the samples, and at most most_s; values are no window frame, so each drive's rows stream through a task in the order
    (t_ns, seq) with one number a column kept. Rows where a column is null keep what was before. An empty table gives an empty result.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in samples.dtypes) + "".join(f", `smooth_{c}` double" for c in columns)
    at = {c: samples.columns.index(c) for c in ("drive_id", "t_ns", *columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drive, last, now = None, 0, [None] * len(columns)
        for b in batches:
            keys, times = b.column(at["drive_id"]).to_pylist(), b.column(at["t_ns"]).to_pylist()
            out = [[] for _ in columns]
            for key, t, *values in zip(keys, times, *(b.column(at[c]).to_pylist() for c in columns)):
                if key != drive:
                    drive, last, now = key, t, [None] * len(columns)
                share = 1 - math.exp(-min(max((t - last) / 1e9, 0.0), most_s) / tau_s)
                last = t
                for i, v in enumerate(values):
                    if v is not None:
                        now[i] = v if now[i] is None else now[i] + (v - now[i]) * share
                    out[i].append(now[i])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.float64()) for x in out)], [*b.schema.names, *(f"smooth_{c}" for c in columns)])

    return samples.repartition("drive_id").sortWithinPartitions("drive_id", "t_ns", "seq").mapInArrow(run, kinds)


def net_tilt(gyro: DataFrame, window_s: float = 3.0) -> DataFrame:
    """gyro (drive_id, t_ns, seq, x, y: rates about the horizontal axes) with tilt_rad: the net rotation over the last window_s. A step lasts from the row before, 0.2 s at most."""
    w = by_drive()
    dt = F.least(F.coalesce((F.col("t_ns") - F.lag("t_ns").over(w)) / F.lit(1e9), F.lit(0.0)), F.lit(0.2))
    frame = Window.partitionBy("drive_id").orderBy("t_ns").rangeBetween(-int(window_s * SECOND), 0)
    steps = gyro.withColumns({"_x": F.col("x") * dt, "_y": F.col("y") * dt})
    return steps.withColumn("tilt_rad", F.hypot(F.sum("_x").over(frame), F.sum("_y").over(frame))).drop("_x", "_y")
