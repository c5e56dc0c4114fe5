"""Queries on motion: stillness, dead reckoning, up vectors, fields, headings, stops, fits and small arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivelake.functions import geo
from drivelake.operators import motion
from drivelake.plans.registry import _query, _r, _wrap
from drivelake.sources.fixes import FIX_SQL, fix_view
from drivelake.sources.views import flat_sql, flat_view

_S = 1_000_000_000
#: The sensor view with time two hundred times as fast, and small values: several samples a second, some of them at rest.
_FAST_SQL = f"{flat_sql('imu')}, fast AS (SELECT drive_id, seq, t_ns // 200 AS t_ns, kind, x * 0.003::DOUBLE AS x, y * 0.003::DOUBLE AS y, z * 0.003::DOUBLE AS z FROM v_imu)"


def _fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_view(spark, sf_dir, "imu").selectExpr("drive_id", "seq", "t_ns DIV 200 AS t_ns", "kind", *(f"{c} * 0.003D AS {c}" for c in "xyz"))


_SHAKE_SQL = f"""{_FAST_SQL}, n AS (SELECT *, CASE kind WHEN 'ACCEL' THEN sqrt(x * x + y * y + z * z) END AS a, CASE kind WHEN 'GYRO' THEN sqrt(x * x + y * y + z * z) END AS g FROM fast WHERE kind <> 'MAG_UNCAL'),
    k AS (SELECT *, count(a) OVER w AS an, count(g) OVER w AS gn, CASE WHEN count(a) OVER w > 1 THEN stddev_samp(a) OVER w END AS sd, coalesce(avg(g) OVER w, 0) + 0 AS gm, sqrt(coalesce(avg(g * g) OVER h, 0)) AS rms FROM n
        WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns RANGE BETWEEN 3000000000 PRECEDING AND CURRENT ROW), h AS (PARTITION BY drive_id ORDER BY t_ns RANGE BETWEEN 500000000 PRECEDING AND CURRENT ROW)),
    s AS (SELECT *, coalesce(an >= 10 AND gn >= 10 AND sd < 0.12 AND gm < 0.03, false) AS still FROM k)"""


@_query(f"WITH {_SHAKE_SQL} SELECT drive_id, seq, an AS acc_n, gn AS gyro_n, round(sd, 6) + 0 AS acc_std, round(gm, 6) + 0 AS gyro_mean, round(rms, 6) + 0 AS gyro_rms, still, an >= 10 AND gn >= 10 AND sd < 0.3 AND gm < 0.02 AS still_loose FROM s")
def sensor_stillness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = motion.shaking(_fast(spark, sf_dir), 3.0)
    norm = F.when(F.col("kind") == "GYRO", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    s = motion.rms(s, norm, 0.5, "gyro_rms")
    return s.select("drive_id", "seq", "acc_n", "gyro_n", _r("acc_std").alias("acc_std"), _r("gyro_mean").alias("gyro_mean"), _r("gyro_rms").alias("gyro_rms"), "still", "still_loose")


@_query(f"""WITH {_SHAKE_SQL}, b AS (SELECT *, sum(CASE WHEN still THEN 0 ELSE 1 END) OVER (PARTITION BY drive_id ORDER BY t_ns, seq ROWS UNBOUNDED PRECEDING) AS run FROM s),
    c AS (SELECT *, seq % 4 <> 0 AS on2, max(CASE WHEN seq % 4 <> 0 THEN t_ns END) OVER (PARTITION BY drive_id ORDER BY t_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b),
    d AS (SELECT *, sum(CASE WHEN on2 AND (p IS NULL OR t_ns - p > 150000000) THEN 1 ELSE 0 END) OVER (PARTITION BY drive_id ORDER BY t_ns, seq ROWS UNBOUNDED PRECEDING) AS run2 FROM c)
    SELECT drive_id, seq, round(CASE WHEN still THEN (t_ns - min(CASE WHEN still THEN t_ns END) OVER (PARTITION BY drive_id, run)) / 1e9 ELSE 0 END, 6) + 0 AS still_s, round(CASE WHEN on2 THEN (t_ns - min(CASE WHEN on2 THEN t_ns END) OVER (PARTITION BY drive_id, run2)) / 1e9 ELSE 0 END, 6) + 0 AS bridged_s FROM d""")
def time_in_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds at rest without a break, and of a condition whose breaks of up to 0.15 s are bridged."""
    s = motion.held_for(motion.shaking(_fast(spark, sf_dir), 3.0), F.col("still"), "still_s")
    s = motion.held_for(s, F.col("seq") % 4 != 0, "bridged_s", bridge_s=0.15)
    return s.select("drive_id", "seq", _r("still_s").alias("still_s"), _r("bridged_s").alias("bridged_s"))


_UPDATES = dict(rate="((i * 37 % 200) - 100) / 1000.0::DOUBLE", speed="CASE WHEN i % 5 <> 0 THEN speed_mps END", speed_t_ns="t_ns - (i % 5) * 400000000")
_RECKON_SQL = f"""{FIX_SQL}, u AS (SELECT drive_id, seq, t_ns, {', '.join(f'{e} AS {n}' for n, e in _UPDATES.items())}, coalesce((t_ns - lag(t_ns) OVER w) / 1e9, 0) + 0 AS dt FROM (SELECT *, seq AS i FROM fix) WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns, seq)),
    b AS (SELECT *, -sum(rate * dt) OVER w AS bearing, coalesce(t_ns - speed_t_ns <= 1500000000 AND speed IS NOT NULL, false) AS fresh FROM u WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns, seq ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT *, sum(CASE WHEN fresh THEN speed * dt * sin(bearing) ELSE 0 END) OVER w AS east, sum(CASE WHEN fresh THEN speed * dt * cos(bearing) ELSE 0 END) OVER w AS north, sum(CASE WHEN fresh THEN speed * dt ELSE 0 END) OVER w AS way,
        sum(CASE WHEN NOT fresh AND dt > 0 THEN 1 ELSE 0 END) OVER w AS gaps FROM b WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns, seq ROWS UNBOUNDED PRECEDING))"""


def _reckoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = fix_view(spark, sf_dir).selectExpr("drive_id", "seq", "t_ns", "speed_mps", "seq AS i").selectExpr("drive_id", "seq", "t_ns", *(f"{e} AS {n}" for n, e in _UPDATES.items()))
    return motion.dead_reckoning(u)


@_query(f"WITH {_RECKON_SQL} SELECT drive_id, seq, round(bearing, 6) + 0 AS bearing, round(east, 4) + 0 AS east, round(north, 4) + 0 AS north, round(way, 4) + 0 AS way, CAST(gaps AS BIGINT) AS gaps FROM r")
def dead_reckoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reckoned(spark, sf_dir).select("drive_id", "seq", _r("bearing").alias("bearing"), *(_r(c, 4).alias(c) for c in ("east", "north", "way")), "gaps")


@_query(f"""WITH {_RECKON_SQL}, one AS (SELECT *, row_number() OVER (PARTITION BY drive_id, t_ns ORDER BY seq DESC) AS k FROM r), br AS (SELECT * EXCLUDE (k), lead(t_ns) OVER w AS tb, lead(bearing) OVER w AS b1, lead(east) OVER w AS e1, lead(north) OVER w AS n1, lead(way) OVER w AS w1, lead(gaps) OVER w AS g1 FROM one WHERE k = 1 WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns)),
    m AS (SELECT drive_id, seq AS id, 1 AS w, t_ns - 7300000000 AS t FROM fix WHERE source = 'NETWORK' UNION ALL SELECT drive_id, seq, 2, t_ns + 150000000 FROM fix WHERE source = 'NETWORK'),
    h AS (SELECT m.*, br.*  EXCLUDE (drive_id), CASE WHEN tb IS NULL THEN 0 ELSE (m.t - br.t_ns) / (tb - br.t_ns)::DOUBLE END AS f FROM m ASOF JOIN br ON m.drive_id = br.drive_id AND m.t >= br.t_ns),
    v AS (SELECT drive_id, id, w, bearing + CASE WHEN f > 0 THEN f * (b1 - bearing) ELSE 0 END AS b, east + CASE WHEN f > 0 THEN f * (e1 - east) ELSE 0 END AS e, north + CASE WHEN f > 0 THEN f * (n1 - north) ELSE 0 END AS n, way + CASE WHEN f > 0 THEN f * (w1 - way) ELSE 0 END AS d,
        gaps AS ga, coalesce(g1, gaps) AS gb FROM h WHERE tb IS NOT NULL OR t <= t_ns + 200000000)
    SELECT x.drive_id, x.seq AS id, round(CASE WHEN p.ga = q.gb THEN q.d - p.d END, 4) + 0 AS way_m, round(CASE WHEN p.ga = q.gb THEN sqrt(pow(q.e - p.e, 2) + pow(q.n - p.n, 2)) END, 4) + 0 AS chord_m, round(q.b - p.b, 6) + 0 AS turn
    FROM fix x LEFT JOIN v p ON p.drive_id = x.drive_id AND p.id = x.seq AND p.w = 1 LEFT JOIN v q ON q.drive_id = x.drive_id AND q.id = x.seq AND q.w = 2 WHERE x.source = 'NETWORK'""")
def odometry_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 7.3 s before each network fix to 0.15 s after it."""
    pairs = fix_view(spark, sf_dir).filter("source = 'NETWORK'").selectExpr("drive_id", "seq AS id", "t_ns - 7300000000 AS t1", "t_ns + 150000000 AS t2")
    out = motion.way_between(pairs, _reckoned(spark, sf_dir))
    return out.select("drive_id", "id", _r("way_m", 4).alias("way_m"), _r("chord_m", 4).alias("chord_m"), _r("turn").alias("turn"))


_TWO_PI = repr(2 * math.pi)


@_query(f"""WITH {FIX_SQL}, a AS (SELECT drive_id, seq, t_ns, radians(bearing_deg) AS a FROM fix), d AS (SELECT *, a - lag(a) OVER (PARTITION BY drive_id ORDER BY t_ns, seq) AS d FROM a),
    e AS (SELECT *, CASE WHEN d > {math.pi!r} THEN d - {_TWO_PI} WHEN d <= -{math.pi!r} THEN d + {_TWO_PI} ELSE coalesce(d, 0) END AS s FROM d)
    SELECT drive_id, seq, round(first_value(a) OVER w + sum(s) OVER w, 6) + 0 AS unwrapped, array_to_string(list(seq) OVER (PARTITION BY drive_id ORDER BY t_ns, seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), ',') AS last_four FROM e WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns, seq ROWS UNBOUNDED PRECEDING)""")
def unwrapped_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearings without full turns, and the last four rows of each."""
    u = motion.unwrapped(fix_view(spark, sf_dir).withColumn("a", F.radians("bearing_deg")), "a", "unwrapped")
    u = motion.last_n(u, F.col("seq"), 4, "last_four")
    return u.select("drive_id", "seq", _r("unwrapped").alias("unwrapped"), F.array_join(F.col("last_four").cast("array<string>"), ",").alias("last_four"))


@_query(f"""WITH {_FAST_SQL}, z AS (SELECT drive_id, min(t_ns * 200) AS t0 FROM fast GROUP BY drive_id), b AS (SELECT drive_id, (t_ns * 200 - t0) // {_S} AS s, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM fast JOIN z USING (drive_id) WHERE kind = 'ACCEL' GROUP BY ALL),
    w AS (SELECT drive_id, s, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(z) OVER w AS z FROM b WINDOW w AS (PARTITION BY drive_id ORDER BY s RANGE BETWEEN 60 PRECEDING AND 60 FOLLOWING))
    SELECT drive_id, CAST(s AS BIGINT) AS second, round(x / sqrt(x * x + y * y + z * z), 6) + 0 AS ux, round(y / sqrt(x * x + y * y + z * z), 6) + 0 AS uy, round(z / sqrt(x * x + y * y + z * z), 6) + 0 AS uz FROM w""")
def up_vector_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    slow = _fast(spark, sf_dir).withColumn("t_ns", F.col("t_ns") * 200)
    return motion.up_vectors(slow).select("drive_id", "second", *(_r(f"u{c}").alias(f"u{c}") for c in "xyz"))


@_query(f"""WITH {flat_sql('imu')}, m AS (SELECT *, CASE kind WHEN 'GYRO' THEN 'MAG' ELSE kind END AS k FROM v_imu WHERE kind <> 'ACCEL'), r AS (SELECT *, sqrt(x * x + y * y + z * z) AS n, max(CASE WHEN k = 'MAG_UNCAL' THEN 1 ELSE 0 END) OVER (PARTITION BY drive_id ORDER BY t_ns, seq ROWS UNBOUNDED PRECEDING) AS raw FROM m)
    SELECT drive_id, count(*) AS n, round(min(n), 6) + 0 AS min_ut, round(quantile_cont(n, 0.5), 6) + 0 AS median_ut, round(max(n), 6) + 0 AS max_ut, round(max(greatest(abs(x), abs(y), abs(z))), 6) + 0 AS max_component_ut, max(greatest(abs(x), abs(y), abs(z))) >= 0.98 * 10 AS near_full_scale FROM r WHERE k = 'MAG_UNCAL' OR raw = 0 GROUP BY drive_id""")
def magnetic_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gyroscope rows stand for the calibrated sensor, which counts until the uncalibrated one begins."""
    imu = flat_view(spark, sf_dir, "imu").withColumn("kind", F.when(F.col("kind") == "GYRO", "MAG").otherwise(F.col("kind")))
    s = motion.field_stats(imu)
    return s.select("drive_id", "n", *(_r(c).alias(c) for c in ("min_ut", "median_ut", "max_ut", "max_component_ut")), (F.col("max_component_ut") >= F.lit(0.98) * 10).alias("near_full_scale"))


@_query(f"WITH {flat_sql('power')}, l AS (SELECT drive_id, (t_ns - lag(t_ns) OVER w) / 1e9 AS d, lag(plug) OVER w AS p FROM v_power WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns, seq)) SELECT drive_id, round(coalesce(sum(CASE WHEN p = 'WIRELESS' THEN d END), 0), 6) + 0 AS seconds FROM l GROUP BY drive_id")
def wireless_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.seconds_in_state(flat_view(spark, sf_dir, "power"), F.col("plug") == "WIRELESS").withColumn("seconds", _r("seconds"))


_HEADING_SQL = f"""{FIX_SQL}, h AS (SELECT drive_id, seq, t_ns, source AS mode, CASE WHEN seq % 4 <> 0 THEN abs({_wrap('bearing_deg - seq % 360')}) END AS err, 5.0::DOUBLE + seq % 60 AS sigma, speed_mps > 3 AS moving FROM fix),
    z AS (SELECT *, (min(t_ns) OVER (PARTITION BY drive_id) + max(t_ns) OVER (PARTITION BY drive_id)) // 2 AS half FROM h)"""


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    err = F.abs(geo.wrap_deg(F.col("bearing_deg") - F.col("seq") % 360))
    w = Window.partitionBy("drive_id")
    f = fix_view(spark, sf_dir).withColumn("half", geo.midpoint_ns(F.min("t_ns").over(w), F.max("t_ns").over(w)))
    return f.filter("t_ns >= half").select("drive_id", F.col("source").alias("mode"), F.when(F.col("seq") % 4 != 0, err).alias("err_deg"), (F.lit(5.0) + F.col("seq") % 60).alias("sigma_deg"), (F.col("speed_mps") > 3).alias("moving"))


@_query(f"WITH {_HEADING_SQL}, r AS (SELECT drive_id, mode, count(*) AS n, quantile_cont(err, 0.5) AS p50, quantile_cont(err, 0.95) AS p95, avg(CASE WHEN err <= 2 * sigma THEN 1.0 ELSE 0.0 END) AS w, grouping(drive_id) AS g FROM z WHERE t_ns >= half AND err IS NOT NULL GROUP BY ROLLUP (drive_id, mode)) SELECT drive_id, mode, n, round(p50, 6) + 0 AS p50_deg, round(p95, 6) + 0 AS p95_deg, round(w, 6) + 0 AS within_2sigma FROM r WHERE g = 0")
def heading_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading errors of each drive's second half, by mode and over all modes."""
    out = motion.heading_stats(_headings(spark, sf_dir))
    return out.select("drive_id", "mode", "n", *(_r(c).alias(c) for c in ("p50_deg", "p95_deg", "within_2sigma")))


@_query(f"WITH {_HEADING_SQL} SELECT drive_id, count(*) FILTER (moving) AS moving, round(CASE WHEN count(*) FILTER (moving) > 0 THEN count(*) FILTER (moving AND err IS NOT NULL) / count(*) FILTER (moving)::DOUBLE END, 6) + 0 AS availability FROM z WHERE t_ns >= half GROUP BY drive_id")
def heading_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    moving, told = F.count_if("moving"), F.count_if(F.col("moving") & F.col("err_deg").isNotNull())
    return _headings(spark, sf_dir).groupBy("drive_id").agg(moving.alias("moving"), _r(F.when(moving > 0, told / moving)).alias("availability"))


@_query(f"""WITH {flat_sql('vehicle_speed')}, z AS (SELECT *, (t_ns - min(t_ns) OVER (PARTITION BY drive_id)) / 1e9 AS t FROM v_vehicle_speed), a AS (SELECT a.drive_id, a.seq, count(*) AS n, count(*) * var_pop(b.t) AS den, CASE WHEN count(*) * var_pop(b.t) > 1e-6 THEN covar_pop(b.speed_mps, b.t) / var_pop(b.t) END AS k
    FROM z a JOIN z b ON a.drive_id = b.drive_id AND b.t_ns BETWEEN a.t_ns - 60000000000 AND a.t_ns GROUP BY a.drive_id, a.seq) SELECT drive_id, seq, round(CASE WHEN n >= 3 AND den > 1e-6 THEN k ELSE 0 END, 6) + 0 AS slope FROM a""")
def speed_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceleration from recorded speeds of the last minute."""
    return motion.recent_slope(flat_view(spark, sf_dir, "vehicle_speed"), "speed_mps", 60.0, "slope").select("drive_id", "seq", _r("slope").alias("slope"))


@_query(f"""WITH {flat_sql('imu')}, p AS (SELECT drive_id, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM v_imu GROUP BY drive_id), s AS (SELECT drive_id, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, sum((x-mx)*(x-mx)) AS uu, sum((x-mx)*(y-my)) AS uv, sum((y-my)*(y-my)) AS vv,
    sum((x-mx)*((x-mx)*(x-mx)+(y-my)*(y-my))) AS ru, sum((y-my)*((x-mx)*(x-mx)+(y-my)*(y-my))) AS rv FROM v_imu JOIN p USING (drive_id) GROUP BY drive_id),
    d AS (SELECT *, uu * vv - uv * uv AS det FROM s), e AS (SELECT *, (ru * vv - rv * uv) / (2 * det) AS a, (rv * uu - ru * uv) / (2 * det) AS b, n >= 3 AND det > 1e-9 * uu * vv AS fits FROM d WHERE det <> 0)
    SELECT drive_id, d.n, round(CASE WHEN fits THEN d.mx + a END, 4) + 0 AS a, round(CASE WHEN fits THEN d.my + b END, 4) + 0 AS b, round(CASE WHEN fits THEN sqrt(a * a + b * b + (d.uu + d.vv) / d.n) END, 4) + 0 AS radius FROM d LEFT JOIN e USING (drive_id)""")
def circle_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.circle_fit(flat_view(spark, sf_dir, "imu").select("drive_id", "x", "y"), ["drive_id"]).select("drive_id", "n", *(_r(c, 4).alias(c) for c in ("a", "b", "radius")))


#: Ticks with a true and an estimated speed: often standing, times twelve times as fast.
_TICKS = dict(truth="CASE WHEN i % 17 = 0 THEN NULL WHEN i % 64 < 40 THEN 0.25::DOUBLE ELSE (i % 9) * 1.0::DOUBLE END", speed="CASE WHEN i % 19 = 0 THEN NULL WHEN i % 3 = 0 THEN 0.4::DOUBLE WHEN i % 3 = 1 THEN -0.7::DOUBLE ELSE 0.0::DOUBLE END")
_TICKS_SQL = f"{FIX_SQL}, i0 AS (SELECT user_id AS drive_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id AS seq FROM events), tk AS (SELECT drive_id, seq, i * 500000000 + (seq % 5) * 200000000 AS t_ns, {', '.join(f'{e} AS {n}' for n, e in _TICKS.items())} FROM i0), ok AS (SELECT *, abs(speed) AS v, truth > 3 AND abs(speed) < 0.5 AS f, truth <= 0.5 AS s FROM tk WHERE truth IS NOT NULL AND speed IS NOT NULL)"


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("drive_id"), F.col("event_id").alias("seq"))
    e = e.withColumn("i", F.row_number().over(Window.partitionBy("drive_id").orderBy("seq")).cast("long"))
    return e.selectExpr("drive_id", "seq", "i * 500000000 + (seq % 5) * 200000000 AS t_ns", *(f"{x} AS {n}" for n, x in _TICKS.items()))


_STOPS_SQL = """, sr AS (SELECT *, lag(s) OVER w AS ps, t_ns - lag(t_ns) OVER w AS dt FROM ok WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns, seq)),
    st AS (SELECT *, sum(CASE WHEN s AND (ps IS NULL OR NOT ps OR dt > 1100000000) THEN 1 ELSE 0 END) OVER (PARTITION BY drive_id ORDER BY t_ns, seq ROWS UNBOUNDED PRECEDING) AS run FROM sr),
    stops AS (SELECT drive_id, run, count(*) AS n, max(t_ns) AS e, arg_max(v, {'t': t_ns, 's': seq}) AS ev FROM st WHERE s GROUP BY drive_id, run HAVING count(*) >= 5)"""


@_query(f"""WITH {_TICKS_SQL}{_STOPS_SQL}, fs AS (SELECT *, CASE WHEN t_ns - lag(t_ns) OVER w < 1100000000 THEN 0 ELSE 1 END AS new FROM ok WHERE f WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns, seq)), fr AS (SELECT drive_id, sum(new) OVER (PARTITION BY drive_id ORDER BY t_ns, seq ROWS UNBOUNDED PRECEDING) AS run FROM fs),
    lf AS (SELECT drive_id, max(n) AS n FROM (SELECT drive_id, run, count(*) AS n FROM fr GROUP BY drive_id, run) GROUP BY drive_id), su AS (SELECT drive_id, count(*) AS n FROM stops GROUP BY drive_id)
    SELECT ok.drive_id, count(*) AS n, count(*) FILTER (truth > 3) AS moving, count(*) FILTER (f) AS false_stops, count(*) FILTER (s) AS stops, count(*) FILTER (s AND v >= 0.5) AS missed_stops, round(coalesce(sum(CASE WHEN s THEN v END), 0), 6) + 0 AS travel_in_stops_m,
    coalesce(any_value(lf.n), 0) + 0 AS longest_false_stop, coalesce(any_value(su.n), 0) + 0 AS sustained_stops FROM ok LEFT JOIN lf USING (drive_id) LEFT JOIN su USING (drive_id) GROUP BY ok.drive_id""")
def stop_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.stop_score(_ticks(spark, sf_dir)).withColumn("travel_in_stops_m", _r("travel_in_stops_m"))


@_query(f"""WITH {_TICKS_SQL}{_STOPS_SQL}, go AS (SELECT p.drive_id, p.e, p.ev, min(o.t_ns) AS d FROM stops p JOIN ok o ON o.drive_id = p.drive_id AND o.t_ns > p.e AND o.t_ns <= p.e + 30000000000 AND o.truth > 2 GROUP BY ALL)
    SELECT go.drive_id, go.e AS end_ns, d AS departure_ns, round((min(o.t_ns) - d) / 1e9, 6) + 0 AS delay_s, any_value(ev) < 0.5 AS stopped_before FROM go LEFT JOIN ok o ON o.drive_id = go.drive_id AND o.t_ns BETWEEN d AND d + 15000000000 AND o.v > 0.5 GROUP BY go.drive_id, go.e, d""")
def stop_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.departures(_ticks(spark, sf_dir)).withColumn("delay_s", _r("delay_s"))


@_query(f"""WITH {flat_sql('vehicle_speed')}, s AS (SELECT *, (t_ns - lag(t_ns) OVER w) / 1e9 AS dt, lag(speed_mps) OVER w AS p FROM v_vehicle_speed WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns, seq))
    SELECT drive_id, seq, round(sum(CASE WHEN dt < 90 THEN p * dt * 0.971::DOUBLE ELSE 0 END) OVER (PARTITION BY drive_id ORDER BY t_ns, seq ROWS UNBOUNDED PRECEDING), 4) + 0 AS way_m FROM s""")
def travelled_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.travelled(flat_view(spark, sf_dir, "vehicle_speed"), 0.971, 90.0).select("drive_id", "seq", _r("way_m", 4).alias("way_m"))


@_query(f"""WITH {flat_sql('annotation')}, iv AS (SELECT drive_id, t_ns - 20000000000 AS a, t_ns + 15000000000 AS b FROM v_annotation) SELECT CAST(drive_id AS VARCHAR) AS drive_id, seq FROM fix f WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.drive_id = CAST(f.drive_id AS VARCHAR) AND f.t_ns BETWEEN a AND b)""")
def outside_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes that aren't near an annotation of their drive."""
    iv = flat_view(spark, sf_dir, "annotation").selectExpr("drive_id", "t_ns - 20000000000 AS from_ns", "t_ns + 15000000000 AS until_ns")
    rows = fix_view(spark, sf_dir).select(F.col("drive_id").cast("string").alias("drive_id"), "seq", "t_ns")
    return motion.outside_intervals(rows, iv).select("drive_id", "seq")


@_query(f"""WITH {FIX_SQL}, x AS (SELECT seq, lat, lon, speed_mps AS v, h_acc_m AS a, radians(bearing_deg) AS b, (seq % 50 - 25) * 1.0::DOUBLE AS e, (seq % 30 - 15) * 1.0::DOUBLE AS n, (seq % 7) * 1.0::DOUBLE AS ee, (seq % 5 - 2) * 1.0::DOUBLE AS en, (seq % 11) * 1.0::DOUBLE AS nn, t_ns FROM fix)
    SELECT seq, CASE WHEN ee * nn - en * en > 0 THEN round((nn * e * e - 2 * en * e * n + ee * n * n) / (ee * nn - en * en), 6) END AS nis, round((ee + nn) / 2 + sqrt(pow((ee - nn) / 2, 2) + en * en), 6) + 0 AS max_eigenvalue, round(sqrt((ee + nn) / 2) * 1.5096::DOUBLE, 6) + 0 AS r68, round(sqrt((ee + nn) / 2) * 2.4477::DOUBLE, 6) + 0 AS r95,
    round(CASE WHEN seq % 7 = 0 THEN -v WHEN seq % 5 = 2 THEN -a ELSE greatest(-v, -a) + ln(1 + exp(-abs(v - a))) END, 6) + 0 AS log_add, round(floor(v * 3.6 + 0.5) / 3.6, 6) + 0 AS shown_mps, round(1 / (1 + a / 50), 6) + 0 AS confidence, (t_ns + 249999999 - 5000000000) - ((t_ns + 249999999 - 5000000000) % 250000000 + 250000000) % 250000000 AS tick_ns,
    round(degrees(asin(least(greatest(sin(radians(lat)) * cos(v * 100 / 6371008.8) + cos(radians(lat)) * sin(v * 100 / 6371008.8) * cos(b), -1), 1))), 7) + 0 AS to_lat FROM x""")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Innovation, eigenvalue, radii, sum of logarithms, shown speed, confidence, tick and destination of each fix."""
    s = F.col("seq")
    e, n, ee, en, nn = (x.cast("double") for x in (s % 50 - 25, s % 30 - 15, s % 7, s % 5 - 2, s % 11))
    v, a, low = F.col("speed_mps"), F.col("h_acc_m"), F.lit(float("-inf"))
    logs = F.when(s % 7 == 0, geo.log_add(low, -v)).when(s % 5 == 2, geo.log_add(-a, low)).otherwise(geo.log_add(-v, -a))
    sigma = geo.cov_sigma(ee, nn)
    return fix_view(spark, sf_dir).select(
        "seq", _r(geo.nis(e, n, ee, en, nn)).alias("nis"), _r(geo.max_eigenvalue(ee, en, nn)).alias("max_eigenvalue"), _r(sigma * geo.R68_PER_SIGMA).alias("r68"), _r(sigma * geo.R95_PER_SIGMA).alias("r95"), _r(logs).alias("log_add"),
        _r(geo.quantize_kmh(v)).alias("shown_mps"), _r(geo.confidence_of_r68(a)).alias("confidence"), geo.ceil_to(F.col("t_ns") - 5 * _S, 250_000_000).alias("tick_ns"), _r(geo.destination(F.col("lat"), F.col("lon"), v * 100, F.col("bearing_deg"))[0], 7).alias("to_lat"),
    )


@_query(f"""WITH {flat_sql('orientation')}, u AS (SELECT drive_id, seq, 2 * (qx * qz - qw * qy) AS x, 2 * (qy * qz + qw * qx) AS y, 1 - 2 * (qx * qx + qy * qy) AS z FROM v_orientation) SELECT drive_id, seq, round(x, 6) + 0 AS ux, round(y, 6) + 0 AS uy, round(z, 6) + 0 AS uz, round(z, 6) + 0 AS along,
    round(sqrt(x * x * z * z + y * y * z * z + (1 - z * z) * (1 - z * z)), 6) + 0 AS across, round(-x, 6) + 0 AS cross_y, round(sqrt(x * x + y * y + z * z), 6) + 0 AS norm FROM u""")
def up_and_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up of each orientation, and the world's z axis along it, across it and in the cross product."""
    u = geo.up_of_quaternion(*(F.col(f"q{c}") for c in "wxyz"))
    z = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return flat_view(spark, sf_dir, "orientation").select(
        "drive_id", "seq", *(_r(c).alias(f"u{n}") for n, c in zip("xyz", u)), _r(geo.dot(u, z)).alias("along"), _r(geo.norm(geo.perpendicular(z, u))).alias("across"), _r(geo.cross(u, z)[1]).alias("cross_y"), _r(geo.norm(u)).alias("norm")
    )


@_query("""WITH x AS (SELECT p_partkey, (p_partkey % 40 - 20) * 1.0::DOUBLE AS px, (p_partkey % 33 - 16) * 1.0::DOUBLE AS py, (p_partkey % 7) * 1.0::DOUBLE AS ax, (p_partkey % 5) * 1.0::DOUBLE AS ay, (p_partkey % 7 + p_partkey % 3 * 10) * 1.0::DOUBLE AS bx, (p_partkey % 5 - p_partkey % 2 * 4) * 1.0::DOUBLE AS by2, p_size FROM part),
    t AS (SELECT *, bx - ax AS dx, by2 - ay AS dy FROM x), u AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(greatest(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0), 1) ELSE 0 END AS t FROM t)
    SELECT p_partkey, round(t, 6) + 0 AS t, round(sqrt(pow(px - ax - t * dx, 2) + pow(py - ay - t * dy, 2)), 6) + 0 AS distance, round(CASE WHEN dx * dx + dy * dy > 0 THEN -(dx * (py - ay - t * dy) - dy * (px - ax - t * dx)) / sqrt(dx * dx + dy * dy) ELSE 0 END, 6) + 0 AS side,
    round(CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 4) * 1.75::DOUBLE ELSE CASE p_partkey % 6 WHEN 0 THEN 7.0::DOUBLE WHEN 1 THEN 3.5 WHEN 2 THEN 1.75 WHEN 3 THEN 3.5 WHEN 4 THEN 7.0 ELSE 1.75 END END, 6) + 0 AS half_width_m,
    CASE WHEN p_size * 0.37 * 100 >= 5 * pow(10, floor(log10(p_size * 0.37 * 100))) THEN 5 WHEN p_size * 0.37 * 100 >= 2 * pow(10, floor(log10(p_size * 0.37 * 100))) THEN 2 ELSE 1 END * pow(10, floor(log10(p_size * 0.37 * 100)))::DOUBLE AS scale_m FROM u""")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points against segments, road half widths, and scale bars."""
    k = F.col("p_partkey")
    px, py, ax, ay, bx, by = (x.cast("double") for x in (k % 40 - 20, k % 33 - 16, k % 7, k % 5, k % 7 + k % 3 * 10, k % 5 - k % 2 * 4))
    t, d, side = geo.on_segment(px, py, ax, ay, bx, by)
    classes = F.element_at(F.array(*map(F.lit, ("primary", "residential", "service", "tertiary", "motorway", "trunk_link"))), (k % 6 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", _r(t).alias("t"), _r(d).alias("distance"), _r(F.when(side == 0, F.lit(0.0)).otherwise(side)).alias("side"), _r(geo.half_width_m(k % 4, classes)).alias("half_width_m"), geo.nice_scale_m(F.col("p_size") * F.lit(0.37), F.lit(100.0)).alias("scale_m"))


@_query("""SELECT n_nationkey, '[out:json][timeout:90];way["highway"~"^(living_street|motorway|motorway_link|primary|primary_link|residential|road|secondary|secondary_link|service|tertiary|tertiary_link|trunk|trunk_link|unclassified)$"](' || (n_nationkey * 0.5::DOUBLE) || ',' || (n_nationkey * 0.25::DOUBLE) || ',' || (n_nationkey * 0.5::DOUBLE + 0.5::DOUBLE) || ',' || (n_nationkey * 0.25::DOUBLE + 0.25::DOUBLE) || ');out body;>;out skel qt;' AS query,
    round((n_nationkey * 0.0001::DOUBLE) * pi() / 180 * 6378137.0 / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(50)), 2)) * cos(radians(50)) / 2.5, 4) + 0 AS x_px FROM nation""")
def tile_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    q = geo.overpass_query(k * F.lit(0.5), k * F.lit(0.25), k * F.lit(0.5) + F.lit(0.5), k * F.lit(0.25) + F.lit(0.25))
    x, _ = geo.map_xy(F.lit(50.0), F.lit(30.0), F.lit(2.5), F.lit(50.0), F.lit(30.0) + k * F.lit(0.0001))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", q.alias("query"), _r(x, 4).alias("x_px"))
