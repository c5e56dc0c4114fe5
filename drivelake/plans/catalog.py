"""Registered queries of the engine's own operators, over the generic driver tables, each with the same result as SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivelake.functions import geo
from drivelake.operators import metrics, scenario, tables, tracks, trust
from drivelake.plans.registry import ORACLE_SQL, QUERIES, _hav, _query, _r, _wrap
from drivelake.sources.fixes import FIX_SQL, fix_view

_RN = "(6378137.0::DOUBLE / sqrt(1 - 6.69437999014e-3 * pow(sin(radians({0})), 2)))"
_RE = f"({_RN} * cos(radians({{0}})))"
_RM = f"({_RN} * (1 - 6.69437999014e-3) / (1 - 6.69437999014e-3 * pow(sin(radians({{0}})), 2)))"
_STEPS_SQL = f"""{FIX_SQL}, steps AS (SELECT *, (t_ns - lag(t_ns) OVER w) / 1e9 AS dt_s, {_hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step_m,
    2 * (coalesce(lag(h_acc_m) OVER w, 50) + coalesce(h_acc_m, 50)) AS allowed FROM fix WINDOW w AS (PARTITION BY drive_id, source ORDER BY t_ns, seq))"""
_ERRORS_SQL = f"{_STEPS_SQL}, err AS (SELECT drive_id, t_ns, seq, source, step_m AS err_m, h_acc_m AS r68 FROM steps)"


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for ticks with errors: the step of each fix as its error, its accuracy as the reported radius, its source as the mode."""
    return tracks.with_steps(fix_view(spark, sf_dir)).select("drive_id", "t_ns", "seq", "source", F.col("step_m").alias("err_m"), F.col("h_acc_m").alias("r68"))


@_query(f"WITH {FIX_SQL} SELECT drive_id, seq, t_ns, source, round(lat, 7) + 0 AS lat, round(lon, 7) + 0 AS lon, h_acc_m, speed_mps, bearing_deg, is_mock, extras FROM fix")
def fixes_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix_view(spark, sf_dir).withColumns({"lat": _r("lat", 7), "lon": _r("lon", 7)})



@_query(f"""WITH {FIX_SQL} SELECT drive_id, seq, row_number() OVER (PARTITION BY drive_id ORDER BY t_ns,
    CASE source WHEN 'GNSS' THEN 0 WHEN 'NETWORK' THEN 1 WHEN 'FUSED' THEN 2 ELSE 3 END, seq) AS place FROM fix""")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.when(F.col("source") == "GNSS", 0).when(F.col("source") == "NETWORK", 1).when(F.col("source") == "FUSED", 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy("drive_id").orderBy("t_ns", rank, "seq"))
    return fix_view(spark, sf_dir).select("drive_id", "seq", place.cast("long").alias("place"))


@_query(f"WITH {FIX_SQL} SELECT drive_id, seq, t_ns, round(lat, 7) + 0 AS lat, round(lon, 7) + 0 AS lon FROM fix WHERE source IN ('GNSS', 'FUSED') AND NOT is_mock AND (h_acc_m IS NULL OR h_acc_m <= 100)")
def route_from_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fix_view(spark, sf_dir)
    f = f.filter(F.col("source").isin("GNSS", "FUSED") & ~F.col("is_mock") & (F.col("h_acc_m").isNull() | (F.col("h_acc_m") <= 100)))
    return f.select("drive_id", "seq", "t_ns", _r("lat", 7).alias("lat"), _r("lon", 7).alias("lon"))


@_query(f"""WITH {_STEPS_SQL} SELECT drive_id, seq, source, round(dt_s, 6) + 0 AS dt_s, round(step_m, 6) + 0 AS step_m,
    round(CASE WHEN dt_s > 0 THEN greatest(step_m - allowed, 0) / greatest(dt_s, 0.5) END, 6) + 0 AS implied_mps FROM steps""")
def step_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tracks.with_steps(fix_view(spark, sf_dir))
    return s.select("drive_id", "seq", "source", _r("dt_s").alias("dt_s"), _r("step_m").alias("step_m"), _r("implied_mps").alias("implied_mps"))


_LAST_NET_SQL = """, netted AS (SELECT *, last(CASE WHEN source = 'NETWORK' THEN {'t': t_ns, 'seq': seq, 'lat': lat, 'lon': lon, 'acc': h_acc_m} END IGNORE NULLS)
    OVER (PARTITION BY drive_id ORDER BY t_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS net FROM fix)"""


def _with_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"net_t": F.col("t_ns"), "net_seq": F.col("seq"), "net_lat": F.col("lat"), "net_lon": F.col("lon"), "net_acc": F.col("h_acc_m")}
    return tracks.with_last(fix_view(spark, sf_dir), F.col("source") == "NETWORK", columns)


@_query(f"WITH {FIX_SQL}{_LAST_NET_SQL} SELECT drive_id, seq, net.seq AS net_seq, round((t_ns - net.t) / 1e9, 6) + 0 AS age_s FROM netted WHERE source = 'GNSS'")
def asof_last_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (F.col("t_ns") - F.col("net_t")) / F.lit(1e9)
    return _with_network(spark, sf_dir).filter("source = 'GNSS'").select("drive_id", "seq", "net_seq", _r(age).alias("age_s"))


@_query(f"""WITH {FIX_SQL}{_LAST_NET_SQL}, d AS (SELECT drive_id, seq, abs(t_ns - net.t) / 1e9 AS age, h_acc_m, net,
    {_hav('net.lat', 'net.lon', 'lat', 'lon')} AS dist FROM netted WHERE source = 'GNSS'),
    e AS (SELECT drive_id, seq, CASE WHEN age <= 120 THEN dist END AS dist, 2 * (coalesce(net.acc, 1000) + coalesce(h_acc_m, 50)) + age * 30 AS allowed FROM d)
    SELECT drive_id, seq, round(dist, 6) + 0 AS distance_m, CASE WHEN dist > allowed + 20000 THEN 'GEOGRAPHICALLY_IMPOSSIBLE' WHEN dist > allowed THEN 'NETWORK_DISAGREEMENT' END AS reason FROM e""")
def network_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, reason = trust.network_check("net_lat", "net_lon", "net_acc", "net_t")
    return _with_network(spark, sf_dir).filter("source = 'GNSS'").select("drive_id", "seq", _r(d).alias("distance_m"), reason.alias("reason"))


def _truth_sql(gap_s: int) -> str:
    gap = gap_s * 10**9
    u = "(CASE WHEN f.t_ns = b.t0 THEN 0 ELSE (f.t_ns - b.t0) / (b.t1 - b.t0)::DOUBLE END)"
    return f"""WITH {FIX_SQL}, one AS (SELECT *, row_number() OVER (PARTITION BY drive_id, t_ns ORDER BY seq DESC) AS n FROM fix WHERE source = 'GNSS'),
    b AS (SELECT drive_id, t_ns AS t0, lead(t_ns) OVER w AS t1, lat, lon, speed_mps AS v, bearing_deg AS c, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1, lead(speed_mps) OVER w AS v1, lead(bearing_deg) OVER w AS c1
        FROM one WHERE n = 1 WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns)),
    j AS (SELECT f.drive_id, f.seq, b.*, {u} AS u FROM fix f LEFT JOIN b ON f.drive_id = b.drive_id AND (f.t_ns = b.t0 OR (f.t_ns > b.t0 AND f.t_ns < b.t1 AND b.t1 - b.t0 <= {gap})) WHERE f.source = 'NETWORK')
    SELECT drive_id, seq, round(CASE WHEN u = 0 THEN lat ELSE lat + u * (lat1 - lat) END, 7) + 0 AS truth_lat, round({_wrap('CASE WHEN u = 0 THEN lon ELSE lon + u * ' + _wrap('lon1 - lon') + ' END')}, 7) + 0 AS truth_lon,
    round(CASE WHEN u = 0 THEN v ELSE v + u * (v1 - v) END, 6) + 0 AS truth_speed, round(CASE WHEN u = 0 THEN c ELSE (c + u * {_wrap('c1 - c')}) - 360 * floor((c + u * {_wrap('c1 - c')}) / 360) END, 6) + 0 AS truth_bearing FROM j"""


def _truth(spark: SparkSession, sf_dir: str, gap_s: int) -> DataFrame:
    f = fix_view(spark, sf_dir)
    out = tracks.interpolate(f.filter("source = 'NETWORK'"), f.filter("source = 'GNSS'"), gap_s)
    return out.select("drive_id", "seq", _r("truth_lat", 7).alias("truth_lat"), _r("truth_lon", 7).alias("truth_lon"), _r("truth_speed").alias("truth_speed"), _r("truth_bearing").alias("truth_bearing"))


@_query(_truth_sql(3).replace("SELECT f.drive_id, f.seq, b.*", "SELECT f.drive_id, f.seq, b.* EXCLUDE (drive_id)"))
def truth_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir, 3)


@_query(_truth_sql(60).replace("SELECT f.drive_id, f.seq, b.*", "SELECT f.drive_id, f.seq, b.* EXCLUDE (drive_id)"))
def truth_interpolation_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir, 60)


@_query(f"""WITH {FIX_SQL}, s AS (SELECT drive_id, min(t_ns) AS a, max(t_ns) AS b FROM fix GROUP BY drive_id)
    SELECT drive_id, unnest(generate_series((a + 999999999) // 1000000000 * 1000000000, b, 1000000000)) AS t_ns FROM s""")
def tick_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.tick_grid(fix_view(spark, sf_dir))


@_query(f"""WITH {FIX_SQL} SELECT drive_id, seq, count(*) OVER w AS n, round(avg(speed_mps) OVER w, 6) + 0 AS mean_mps FROM fix
    WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns RANGE BETWEEN 15000000000 PRECEDING AND CURRENT ROW)""")
def recent_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tracks.range_frame(15)
    return fix_view(spark, sf_dir).select("drive_id", "seq", F.count("*").over(w).alias("n"), _r(F.avg("speed_mps").over(w)).alias("mean_mps"))


@_query(f"""WITH {FIX_SQL}, g AS (SELECT * REPLACE (CASE WHEN seq % 41 <> 0 THEN speed_mps END AS speed_mps, CASE WHEN seq % 43 <> 0 THEN bearing_deg END AS bearing_deg, t_ns + 1700000000123456789 AS t_ns) FROM fix WHERE source = 'GNSS'),
    v AS (SELECT *, CASE WHEN speed_mps >= 1 THEN radians(bearing_deg) ELSE 0 END AS b FROM g),
    p AS (SELECT *, (t_ns - lag(t_ns) OVER w) / 1e9 AS dt, speed_mps * sin(b) AS ve, speed_mps * cos(b) AS vn, row_number() OVER w AS i FROM v WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns, seq)),
    j AS (SELECT a.drive_id, a.seq, a.t_ns, a.lat, a.lon, a.h_acc_m, list(z ORDER BY z.i) AS zs FROM p a JOIN p z ON a.drive_id = z.drive_id AND z.t_ns BETWEEN a.t_ns - 120000000000 AND a.t_ns AND (z.i <= a.i OR z.t_ns = a.t_ns) GROUP BY ALL),
    k AS (SELECT *, zs[1] AS o, list_filter(zs, lambda z: z.i <= list_max(list_transform(list_filter(zs, lambda y: y.seq = seq), lambda y: y.i))) AS ws FROM j),
    s AS (SELECT *, (t_ns - o.t_ns) / 1e9 AS span, len(list_filter(ws, lambda z: z.ve IS NULL)) AS unknown, len(list_filter(ws[2:], lambda z: z.dt <= 0 OR z.dt > 60)) AS bad,
        list_sum(list_transform(range(2, len(ws) + 1), lambda n: 0.5 * (ws[n].ve + ws[n - 1].ve) * ws[n].dt)) AS pe, list_sum(list_transform(range(2, len(ws) + 1), lambda n: 0.5 * (ws[n].vn + ws[n - 1].vn) * ws[n].dt)) AS pn FROM k),
    d AS (SELECT drive_id, seq, span, unknown = 0 AND bad = 0 AND span >= 60 AS fit, 15 + 2 * (coalesce(o.h_acc_m, 20) + coalesce(h_acc_m, 20)) AS allowed,
        sqrt(pow(radians({_wrap('lon - o.lon')}) * {_RE.format('o.lat')} - pe, 2) + pow(radians(lat - o.lat) * {_RM.format('o.lat')} - pn, 2)) AS diff FROM s)
    SELECT drive_id, seq, round(CASE WHEN fit THEN span END, 6) + 0 AS span_s, round(CASE WHEN fit THEN diff END, 4) + 0 AS diff_m, CASE WHEN fit THEN diff > allowed END AS mismatch FROM d""")
def velocity_consistency_100s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over 100 s windows with steps up to 60 s, as the fix view's rows are far apart; some speeds and bearings are made null and times are epochs."""
    f = fix_view(spark, sf_dir).filter("source = 'GNSS'").withColumns({
        "speed_mps": F.when(F.col("seq") % 41 != 0, F.col("speed_mps")), "bearing_deg": F.when(F.col("seq") % 43 != 0, F.col("bearing_deg")), "t_ns": F.col("t_ns") + F.lit(1700000000123456789),
    })
    out = tracks.velocity_consistency(f, 100.0, max_step_s=60.0)
    return out.select("drive_id", "seq", _r("span_s").alias("span_s"), _r("diff_m", 4).alias("diff_m"), "mismatch")


@_query(f"""WITH {FIX_SQL}, b AS (SELECT *, CASE WHEN t_ns - lag(t_ns) OVER w >= 30000000000 THEN 1 ELSE 0 END AS new FROM fix WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns, seq)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY drive_id ORDER BY t_ns, seq ROWS UNBOUNDED PRECEDING) AS session FROM b)
    SELECT drive_id, CAST(session AS BIGINT) AS session, min(t_ns) AS t0, max(t_ns) AS t1, count(*) AS n FROM s GROUP BY drive_id, session""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.gap_sessions(fix_view(spark, sf_dir), 30)


@_query(f"""WITH {FIX_SQL}, l AS (SELECT *, (seq * 13 % 140) / 10.0::DOUBLE AS lat_s FROM fix),
    h AS (SELECT *, NOT is_mock AND source = 'NETWORK' AND lat_s > 30 AS ns, NOT is_mock AND source = 'NETWORK' AND h_acc_m IS NULL AS nn, NOT is_mock AND source = 'NETWORK' AND coalesce(h_acc_m > 5000, false) AS np,
        NOT is_mock AND source IN ('GNSS', 'FUSED') AS g FROM l),
    k AS (SELECT drive_id, seq, ns, nn, np, is_mock, g AND lat_s > 10 AS g10, g AND lat_s > 2 AND lat_s <= 10 AS g2, g AND h_acc_m IS NULL AS gn, g AND coalesce(h_acc_m > 150, false) AS gp, g AND coalesce(h_acc_m > 30 AND h_acc_m <= 150, false) AS gq FROM h),
    w AS (SELECT *, CASE WHEN is_mock OR nn OR np OR g10 OR gp THEN 2 WHEN ns OR g2 OR gn OR gq THEN 1 ELSE 0 END AS worst FROM k)
    SELECT drive_id, seq, CASE worst WHEN 2 THEN 'REJECTED' WHEN 1 THEN 'QUESTIONABLE' ELSE 'TRUSTED' END AS state,
    round(CASE worst WHEN 2 THEN 0.05 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE * CASE WHEN is_mock THEN 0 ELSE 1 END * CASE WHEN ns THEN 0.5 ELSE 1 END * CASE WHEN g2 THEN 0.7 ELSE 1 END * CASE WHEN gn THEN 0.5 ELSE 1 END * CASE WHEN gq THEN 0.6 ELSE 1 END, 6) + 0 AS confidence,
    array_to_string(list_sort(list_filter([CASE WHEN is_mock THEN 'SYNTHETIC_INPUT' END, CASE WHEN ns OR g10 OR g2 THEN 'STALE' END, CASE WHEN nn OR gn THEN 'NO_ACCURACY' END, CASE WHEN np OR gp OR gq THEN 'POOR_ACCURACY' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM w""")
def stateless_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trust.stateless_trust(fix_view(spark, sf_dir), (F.col("seq") * 13 % 140) / F.lit(10.0))
    return out.select("drive_id", "seq", "state", _r("confidence").alias("confidence"), F.array_join("reasons", ",").alias("reasons"))


_STATS_SQL = """count(err_m) AS n, round(sqrt(avg(err_m * err_m)), 6) + 0 AS rmse_m, round(quantile_cont(err_m, 0.5), 6) + 0 AS p50_m, round(quantile_cont(err_m, 0.95), 6) + 0 AS p95_m, round(max(err_m), 6) + 0 AS max_m,
    round(avg(CASE WHEN err_m <= r68 THEN 1.0 WHEN err_m > r68 THEN 0.0 END), 6) + 0 AS within68, round(avg(CASE WHEN err_m <= r68 * 2.4477::DOUBLE / 1.5096::DOUBLE THEN 1.0 WHEN err_m > r68 * 2.4477::DOUBLE / 1.5096::DOUBLE THEN 0.0 END), 6) + 0 AS within95"""


@_query(f"WITH {_ERRORS_SQL} SELECT source, {_STATS_SQL} FROM err GROUP BY source")
def error_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _errors(spark, sf_dir).groupBy("source").agg(*metrics.error_stats())
    return out.select("source", "n", *(_r(c).alias(c) for c in out.columns[2:]))


_WINDOWS = [scenario.Step("drop_source", 100, 200), scenario.Step("offset", 250, 200)]
_WINDOWS_SQL = """span AS (SELECT drive_id, min(t_ns) AS t0, max(t_ns) AS e FROM fix GROUP BY drive_id), win AS (SELECT drive_id AS wd, step_idx, kind, t0 + s AS start_ns, least(t0 + s + 200000000000, e) AS end_ns
    FROM span, (VALUES (0, 'gnss_outage', 100000000000), (1, 'gnss_offset', 250000000000)) AS v(step_idx, kind, s))"""
_TICKED_SQL = f"""{_ERRORS_SQL}, {_WINDOWS_SQL}, met AS (SELECT e.*, w.kind, w.step_idx, (e.t_ns - w.start_ns) / 1e9 AS since_s, row_number() OVER (PARTITION BY e.drive_id, e.t_ns, e.seq ORDER BY w.step_idx) AS i
    FROM err e LEFT JOIN win w ON e.drive_id = w.wd AND e.t_ns >= w.start_ns AND e.t_ns < w.end_ns), ticked AS (SELECT * FROM met WHERE i = 1)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix_view(spark, sf_dir).groupBy("drive_id").agg(F.min("t_ns").alias("t0_ns"), F.max("t_ns").alias("end_ns"))


def _ticked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_first_window(_errors(spark, sf_dir), scenario.degraded_windows(_spans(spark, sf_dir), _WINDOWS))


@_query(f"""WITH {_TICKED_SQL} SELECT CAST(floor(since_s / 10) * 10 AS DOUBLE) AS bin_s, round(quantile_cont(err_m, 0.5), 6) + 0 AS p50_m, round(quantile_cont(err_m, 0.95), 6) + 0 AS p95_m, count(*) AS n
    FROM ticked WHERE since_s IS NOT NULL AND err_m IS NOT NULL GROUP BY 1""")
def error_time_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.time_bins(_ticked(spark, sf_dir)).withColumns({"p50_m": _r("p50_m"), "p95_m": _r("p95_m")})


_EXCEED = ", ".join(f"round(min(CASE WHEN inside AND err_m > {x} THEN t_ns - start_ns END) / 1e9, 6) + 0 AS exceed_{x}m_s" for x in metrics.THRESHOLDS_M)


@_query(f"""WITH {_ERRORS_SQL}, {_WINDOWS_SQL},
    m AS (SELECT r.*, w.*, r.t_ns >= start_ns AND r.t_ns < end_ns AS inside FROM err r JOIN win w ON drive_id = wd AND ((r.t_ns >= start_ns AND r.t_ns < end_ns) OR (r.t_ns >= end_ns AND r.t_ns < end_ns + 300000000000)) WHERE err_m IS NOT NULL),
    g AS (SELECT drive_id, step_idx, kind, any_value(end_ns) AS end_ns, round(max(CASE WHEN inside THEN err_m END), 6) + 0 AS max_err_m, round(arg_max(err_m, CASE WHEN inside THEN {{'t': t_ns, 's': seq}} END), 6) + 0 AS err_at_end_m, {_EXCEED},
        min(CASE WHEN t_ns >= end_ns AND err_m < 20 THEN t_ns END) AS back FROM m GROUP BY drive_id, step_idx, kind)
    SELECT g.* EXCLUDE (end_ns, back), round(CASE WHEN end_ns < e - 1000000000 THEN (back - end_ns) / 1e9 END, 6) + 0 AS recovery_s FROM g JOIN span USING (drive_id)""")
def window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _errors(spark, sf_dir)
    spans = _spans(spark, sf_dir)
    out = metrics.window_metrics(ticks, scenario.degraded_windows(spans, _WINDOWS), spans)
    keys = ["drive_id", "step_idx", "kind"]
    return out.select(*keys, *(_r(c).alias(c) for c in out.columns if c not in keys))


_OFFSET = [scenario.Step("offset", 120, 300, east_m=700, north_m=700, ramp_s=120, consistent_velocity=True)]


def _scenario_sql(east: str, north: str, ve: str, vn: str, moving: str, active: str) -> str:
    e, n = f"(speed_mps * sin(radians(bearing_deg)) + {ve})", f"(speed_mps * cos(radians(bearing_deg)) + {vn})"
    v = f"sqrt({e} * {e} + {n} * {n})"
    b = f"((degrees(atan2({e}, {n})) + 360) - 360 * floor((degrees(atan2({e}, {n})) + 360) / 360))"
    return f"""WITH {FIX_SQL}, a AS (SELECT *, t_ns / 1e9 AS t, t_ns / 1e9 - 120 AS since, source IN ('GNSS', 'FUSED') AND {active} AS act FROM fix),
    o AS (SELECT *, CASE WHEN act THEN lat + degrees(({north}) / {_RM.format('lat')}) ELSE lat END AS lat1, CASE WHEN act THEN {_wrap(f"lon + degrees(({east}) / {_RE.format('lat')})")} ELSE lon END AS lon1,
        CASE WHEN act AND {moving} THEN {v} ELSE speed_mps END AS v1, CASE WHEN act AND {moving} AND {v} > 0.5 THEN {b} ELSE bearing_deg END AS b1 FROM a)
    SELECT drive_id, seq, round(lat1, 7) + 0 AS lat, round(lon1, 7) + 0 AS lon, round(v1, 6) + 0 AS speed_mps, round(b1, 6) + 0 AS bearing_deg, round({_hav('lat', 'lon', 'lat1', 'lon1')}, 4) + 0 AS offset_m FROM o"""


def _perturbed(spark: SparkSession, sf_dir: str, steps: list) -> DataFrame:
    out = scenario.apply_steps(fix_view(spark, sf_dir), steps)
    offset = scenario.injected_offset(out)
    return out.select("drive_id", "seq", _r("lat", 7).alias("lat"), _r("lon", 7).alias("lon"), _r("speed_mps").alias("speed_mps"), _r("bearing_deg").alias("bearing_deg"), _r(offset, 4).alias("offset_m"))


_PART = "least(greatest(since / 120, 0), 1) * 700"


@_query(_scenario_sql(_PART, _PART, "700 / 120.0::DOUBLE", "700 / 120.0::DOUBLE", "since < 120", "t_ns / 1e9 >= 120 AND t_ns / 1e9 < 420"))
def scenario_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _perturbed(spark, sf_dir, _OFFSET)


@_query(_scenario_sql("0", "since * 2", "0", "2", "true", "t_ns / 1e9 >= 120 AND t_ns / 1e9 < 420"))
def scenario_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _perturbed(spark, sf_dir, scenario.SCENARIOS["gnss_drift_doppler_consistent"])


@_query(f"""WITH {FIX_SQL}, a AS (SELECT *, source IN ('GNSS', 'FUSED') AND t_ns >= 120000000000 AND t_ns < 420000000000 AS act FROM fix),
    k AS (SELECT drive_id, min({{'t': t_ns, 's': seq, 'lat': lat, 'lon': lon}}) AS o FROM a WHERE act GROUP BY drive_id),
    q AS (SELECT a.*, CASE WHEN act THEN -12.0464::DOUBLE + (lat - o.lat) ELSE lat END AS lat1, CASE WHEN act THEN {_wrap("-77.0428::DOUBLE + (lon - o.lon)")} ELSE lon END AS lon1 FROM a LEFT JOIN k USING (drive_id))
    SELECT drive_id, seq, round(lat1, 7) + 0 AS lat, round(lon1, 7) + 0 AS lon, speed_mps, bearing_deg, round({_hav('lat', 'lon', 'lat1', 'lon1')}, 4) + 0 AS offset_m FROM q""")
def scenario_teleport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _perturbed(spark, sf_dir, scenario.SCENARIOS["gnss_teleport_country"])


@_query(f"WITH {FIX_SQL} SELECT drive_id, seq, source FROM fix WHERE NOT (source = 'GNSS' AND t_ns >= 120000000000 AND t_ns < 240000000000)")
def scenario_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario.apply_steps(fix_view(spark, sf_dir), scenario.SCENARIOS["gnss_drop_2min"]).select("drive_id", "seq", "source")


@_query()
def scenario_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _perturbed(spark, sf_dir, scenario.SCENARIOS["gnss_noise_overconfident"])


@_query(f"""WITH {FIX_SQL}, s AS (SELECT drive_id, min(t_ns) + 1700000000000000007 AS a, max(t_ns) + 1700000000000000007 AS b FROM fix GROUP BY drive_id)
    SELECT drive_id, CAST(i AS INTEGER) AS step_idx, kind, a + s0 AS start_ns, CASE WHEN n IS NULL THEN b ELSE least(a + s0 + n, b) END AS end_ns FROM s,
    (VALUES (1, 'gnss_offset', 120500000000, 300000000000), (2, 'gnss_noise', 0, NULL), (3, 'gnss_outage', 60000000000, 30000000000), (5, 'gnss_drift', 700000000000, 900000000000)) AS v(i, kind, s0, n)""")
def degraded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of drives whose time is an epoch, for steps on all sources: dropping FUSED and a sensor makes no window, moving FUSED only does."""
    step = scenario.Step
    steps = [step("drop_source", source="FUSED"), step("offset", 120.5, 300, sources=frozenset({"FUSED"})), step("inflate_noise", source="NETWORK", sigma_m=3), step("drop_source", 60, 30), step("drop_sensor"), step("drift", 700, 900, rate_mps=1)]
    return scenario.degraded_windows(_spans(spark, sf_dir).selectExpr("drive_id", "t0_ns + 1700000000000000007 AS t0_ns", "end_ns + 1700000000000000007 AS end_ns"), steps)


@_query("""WITH d AS (SELECT DISTINCT user_id AS drive_id FROM events) SELECT d.drive_id, s.scenario, v.variant, CAST(v.n AS INTEGER) AS extra_steps, v.estimator, v.roads FROM d,
    (VALUES ('clean'), ('gnss_absent_from_start'), ('gnss_drop_30s'), ('gnss_drop_2min'), ('gnss_drop_10min'), ('gnss_drop_1h'), ('gnss_jump_5km'), ('gnss_ramp_capture'), ('gnss_ramp_capture_doppler_consistent'),
        ('gnss_drift_gradual'), ('gnss_drift_doppler_consistent'), ('gnss_teleport_country'), ('gnss_noise_overconfident')) AS s(scenario),
    (VALUES ('hold-last-fix', 0, 'passthrough', false), ('gyro-only', 3, 'baseline', false), ('phone-only', 3, 'baseline', false), ('phone+network', 2, 'baseline', false), ('phone+synthNetwork', 4, 'baseline', false),
        ('gyro+synthNetwork+synthObd', 5, 'baseline', false), ('phone+synthNetwork+synthObd', 5, 'baseline', false), ('phone+obd', 2, 'baseline', false), ('phone+network+obd', 1, 'baseline', false),
        ('phone+network+osm', 2, 'baseline', true), ('phone+network+obd+osm', 1, 'baseline', true)) AS v(variant, n, estimator, roads)""")
def matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario.matrix_cells(fix_view(spark, sf_dir).select("drive_id").distinct(), list(scenario.SCENARIOS), scenario.VARIANTS)


_CONFUSION_SQL = f"""{_ERRORS_SQL}, v AS (SELECT e.drive_id, CASE WHEN r68 > 150 THEN 'REJECTED' WHEN r68 > 30 THEN 'QUESTIONABLE' ELSE 'TRUSTED' END AS state, err_m AS offset_m, seq % 3 <> 0 AS has_truth FROM err e WHERE source = 'GNSS' AND err_m IS NOT NULL)"""


@_query(f"""WITH {_CONFUSION_SQL}, c AS (SELECT drive_id, count(*) FILTER (offset_m < 1 AND has_truth) AS clean_fixes, count(*) FILTER (offset_m < 1 AND has_truth AND state <> 'TRUSTED') AS false_rejections,
    count(*) FILTER (offset_m >= 50) AS perturbed_fixes, count(*) FILTER (offset_m >= 50 AND state = 'TRUSTED') AS missed_detections FROM v GROUP BY drive_id)
    SELECT *, round(CASE WHEN clean_fixes > 0 THEN false_rejections / clean_fixes::DOUBLE END, 6) + 0 AS false_rejection_rate, round(CASE WHEN perturbed_fixes > 0 THEN missed_detections / perturbed_fixes::DOUBLE END, 6) + 0 AS missed_detection_rate FROM c""")
def trust_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("r68") > 150, "REJECTED").when(F.col("r68") > 30, "QUESTIONABLE").otherwise("TRUSTED")
    v = _errors(spark, sf_dir).filter("source = 'GNSS' AND err_m IS NOT NULL").select("drive_id", state.alias("state"), F.col("err_m").alias("offset_m"), (F.col("seq") % 3 != 0).alias("has_truth"))
    out = v.groupBy("drive_id").agg(*metrics.trust_confusion())
    return out.withColumns({c: _r(c) for c in ("false_rejection_rate", "missed_detection_rate")})


@_query(f"WITH {FIX_SQL} SELECT drive_id, source, round(count(*) / sum(count(*)) OVER (PARTITION BY drive_id), 6) + 0 AS fraction FROM fix GROUP BY drive_id, source")
def mode_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = fix_view(spark, sf_dir).groupBy("drive_id", "source").count()
    return n.select("drive_id", "source", _r(F.col("count") / F.sum("count").over(Window.partitionBy("drive_id"))).alias("fraction"))


@_query(f"WITH {FIX_SQL} SELECT drive_id, source, count(*) AS n, min(t_ns) AS t0, max(t_ns) AS t1 FROM fix GROUP BY ROLLUP (drive_id, source)")
def record_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix_view(spark, sf_dir).rollup("drive_id", "source").agg(F.count("*").alias("n"), F.min("t_ns").alias("t0"), F.max("t_ns").alias("t1"))


@_query(f"""WITH {_TICKED_SQL}, s AS (SELECT drive_id, CAST(floor(max(t_ns) / 1e9) AS INTEGER) AS ticks, count(*) AS ticks_with_estimate, {_STATS_SQL}, round(sqrt(avg(CASE WHEN kind IS NOT NULL THEN err_m * err_m END)), 6) + 0 AS degraded_rmse_m,
    round(quantile_cont(CASE WHEN kind IS NOT NULL THEN err_m END, 0.95), 6) + 0 AS degraded_p95_m FROM ticked GROUP BY drive_id) SELECT * FROM s""")
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    degraded = F.when(F.col("kind").isNotNull(), F.col("err_m"))
    t = _ticked(spark, sf_dir).withColumn("_deg", degraded)
    out = t.groupBy("drive_id").agg(
        F.floor(F.max("t_ns") / F.lit(1e9)).cast("int").alias("ticks"), F.count("*").alias("ticks_with_estimate"), *metrics.error_stats(),
        F.sqrt(F.avg(F.col("_deg") * F.col("_deg"))).alias("degraded_rmse_m"), F.percentile("_deg", 0.95).alias("degraded_p95_m"),
    )
    whole = ["drive_id", "ticks", "ticks_with_estimate", "n"]
    return out.select(*whole, *(_r(c).alias(c) for c in out.columns if c not in whole))


@_query(f"WITH {FIX_SQL} SELECT drive_id, seq, CAST(json_extract_string(extras, '$.k') AS BIGINT) AS k FROM fix")
def extras_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix_view(spark, sf_dir).select("drive_id", "seq", F.get_json_object("extras", "$.k").cast("long").alias("k"))


@_query("""SELECT o_orderkey, count(l_linenumber) AS n_items, round(coalesce(sum(l_quantity), 0), 4) + 0 AS quantity, arg_min(l_partkey, {'n': l_linenumber, 'p': l_partkey}) FILTER (l_orderkey IS NOT NULL) AS first_part
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def nest_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _nested(spark, sf_dir)
    total = F.aggregate("items", F.lit(0.0), lambda a, x: a + x["l_quantity"])
    return nested.select("o_orderkey", F.size("items").cast("long").alias("n_items"), _r(total, 4).alias("quantity"), F.get("items", F.lit(0))["l_partkey"].alias("first_part"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    return tables.nest_children(orders.select("o_orderkey"), items, "o_orderkey", "l_orderkey", ["l_partkey", "l_quantity"], "l_linenumber")


@_query("SELECT o_orderkey, l_linenumber, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def unnest_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.unnest_children(_nested(spark, sf_dir), ["o_orderkey"])


@_query(f"""WITH {FIX_SQL}, n AS (SELECT seq AS o_id, lat AS o_lat, lon AS o_lon FROM fix WHERE source = 'NETWORK'), p AS (SELECT f.drive_id, f.seq, n.o_id, {_hav('f.lat', 'f.lon', 'o_lat', 'o_lon')} AS d FROM fix f, n
    WHERE f.source = 'FUSED' AND abs(f.lat - o_lat) < 0.002 AND abs(f.lon - o_lon) < 0.002) SELECT drive_id, seq, o_id, round(d, 4) + 0 AS distance_m FROM p WHERE d <= 20""")
def grid_spatial_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fix_view(spark, sf_dir)
    others = f.filter("source = 'NETWORK'").select(F.col("seq").alias("o_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"))
    near = tables.near_places(f.filter("source = 'FUSED'").select("drive_id", "seq", "lat", "lon"), others, d, 20.0, 0.0005)
    whole = F.floor(F.col("distance_m") * 1e4)  # rounded half up as _r does it, without a decimal for each of many rows
    near = near.select("points", "others", ((whole + F.when(F.col("distance_m") * 1e4 - whole >= 0.5, 1).otherwise(0)) / 1e4).alias("distance_m"))
    return tables.unpacked(near).select("drive_id", "seq", "o_id", "distance_m")


_WAYS_SQL = """way AS (SELECT l_orderkey AS way_id, l_linenumber AS pos, l_partkey AS node FROM lineitem), z AS (SELECT *, count(*) OVER (PARTITION BY node) > 1 AS shared, row_number() OVER (PARTITION BY way_id ORDER BY pos, node) AS i,
    count(*) OVER (PARTITION BY way_id) AS n FROM way), c AS (SELECT *, CASE WHEN shared AND i > 1 AND i < n THEN 1 ELSE 0 END AS cut FROM z),
    b AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY way_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0 AS before FROM c),
    e AS (SELECT way_id, i, node, unnest(CASE WHEN cut = 1 THEN [before, before + 1] ELSE [before] END) AS piece FROM b),
    seg AS (SELECT way_id, CAST(piece AS INTEGER) AS piece, arg_min(node, i) AS start_node, arg_max(node, i) AS end_node, count(*) AS n_nodes FROM e GROUP BY way_id, piece)"""


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ways whose nodes are the parts of their lines."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    packed = items.groupBy(F.col("l_orderkey").alias("way_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    return packed.select("way_id", F.col("s.l_partkey").alias("nodes"))


@_query(f"WITH {_WAYS_SQL} SELECT * FROM seg")
def road_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.split_ways(_ways(spark, sf_dir)).withColumn("piece", F.col("piece").cast("int"))


@_query(f"WITH {_WAYS_SQL} SELECT a.way_id AS from_way, a.piece AS from_piece, b.way_id AS to_way, b.piece AS to_piece, a.end_node AS node FROM seg a JOIN seg b ON a.end_node = b.start_node WHERE a.way_id <> b.way_id OR a.piece <> b.piece")
def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.segment_edges(tables.split_ways(_ways(spark, sf_dir)))
    return out.withColumns({c: F.col(c).cast("int") for c in ("from_piece", "to_piece")})


_OBD_SQL = """CASE event_id % 8 WHEN 0 THEN 'SEARCHING...' || chr(13) || '41 0D ' || printf('%02x', event_id % 256) || chr(13) || '>' WHEN 1 THEN '010D' || chr(13) || '410D' || upper(printf('%02x', event_id % 256)) WHEN 2 THEN 'NO DATA' WHEN 3 THEN '?'
    WHEN 4 THEN '41' || chr(13) || '0D2A' WHEN 5 THEN '410D' || chr(13) || chr(10) || '41 0D 1F' WHEN 6 THEN '41 0D GG' || chr(13) || '41 0D 11' ELSE 'searching 41 0D 2A' END"""


@_query(f"""SELECT event_id, kmh, round(kmh / 3.6::DOUBLE, 6) + 0 AS speed_mps, lines FROM (SELECT event_id, CAST(CASE event_id % 8 WHEN 0 THEN event_id % 256 WHEN 1 THEN event_id % 256 WHEN 5 THEN 31 END AS INTEGER) AS kmh,
    array_to_string(list_filter(list_transform(regexp_split_to_array(response, '[\\r\\n]'), lambda x: trim(x)), lambda x: x <> '' AND x <> '>' AND NOT upper(x) LIKE 'SEARCHING%'), '/') AS lines FROM (SELECT *, {_OBD_SQL} AS response FROM events))""")
def obd_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers over several lines, with notes, prompts, a cut line and no hex digits."""
    i = F.col("event_id")
    code = F.lower(F.lpad(F.hex(i % 256), 2, "0"))
    texts = [F.concat(F.lit("SEARCHING...\r41 0D "), code, F.lit("\r>")), F.concat(F.lit("010D\r410D"), F.upper(code)), *map(F.lit, ("NO DATA", "?", "41\r0D2A", "410D\r\n41 0D 1F", "41 0D GG\r41 0D 11", "searching 41 0D 2A"))]
    answer = F.element_at(F.array(*texts), (i % 8 + 1).cast("int"))
    kmh = geo.speed_of_obd(answer)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", kmh.alias("kmh"), _r(kmh / F.lit(3.6)).alias("speed_mps"), F.array_join(geo.obd_lines(answer), "/").alias("lines"))


@_query(f"WITH {FIX_SQL} SELECT drive_id, source, max(t_ns) AS t_ns, arg_max(seq, {{'t': t_ns, 's': seq}}) AS seq FROM fix GROUP BY drive_id, source")
def last_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.last_wins(fix_view(spark, sf_dir), ["drive_id", "source"], ["t_ns", "seq"]).select("drive_id", "source", "t_ns", "seq")


@_query(f"WITH {FIX_SQL}, p AS (SELECT drive_id, seq, source, lag(source) OVER (PARTITION BY drive_id ORDER BY t_ns, seq) AS before FROM fix) SELECT drive_id, seq, source FROM p WHERE before IS DISTINCT FROM source")
def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.without_repeats(fix_view(spark, sf_dir), F.col("source")).select("drive_id", "seq", "source")


@_query(f"WITH {_STEPS_SQL} SELECT drive_id, source, count(*) AS n, round(coalesce(sum(step_m), 0), 3) + 0 AS length_m FROM steps GROUP BY drive_id, source")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tracks.with_steps(fix_view(spark, sf_dir))
    return s.groupBy("drive_id", "source").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("step_m"), F.lit(0.0)), 3).alias("length_m"))


@_query(f"""WITH {FIX_SQL}, b AS (SELECT *, CASE WHEN t_ns - lag(t_ns) OVER w >= 10000000000 THEN 1 ELSE 0 END AS new FROM fix WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns, seq)),
    s AS (SELECT drive_id, sum(new) OVER (PARTITION BY drive_id ORDER BY t_ns, seq ROWS UNBOUNDED PRECEDING) AS run FROM b) SELECT drive_id, max(n) AS longest FROM (SELECT drive_id, run, count(*) AS n FROM s GROUP BY drive_id, run) GROUP BY drive_id""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.gap_sessions(fix_view(spark, sf_dir), 10).groupBy("drive_id").agg(F.max("n").alias("longest"))


@_query(f"""WITH {FIX_SQL}, m AS (SELECT drive_id, degrees(atan2(sum(speed_mps * sin(radians(bearing_deg))), sum(speed_mps * cos(radians(bearing_deg))))) + 360 AS b FROM fix GROUP BY drive_id)
    SELECT drive_id, round(b - 360 * floor(b / 360), 6) + 0 AS bearing_deg FROM m""")
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix_view(spark, sf_dir).groupBy("drive_id").agg(_r(metrics.circular_mean_deg("bearing_deg", F.col("speed_mps"))).alias("bearing_deg"))


@_query(f"WITH {FIX_SQL} SELECT 'r' || CAST(floor(lat / 0.05) AS BIGINT) || '_' || CAST(floor(lon / 0.08) AS BIGINT) AS tile, count(*) AS n FROM fix GROUP BY 1")
def tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix_view(spark, sf_dir).groupBy(geo.tile_key(F.col("lat"), F.col("lon")).alias("tile")).agg(F.count("*").alias("n"))


from drivelake.plans import fold_catalog, motion_catalog, record_catalog, replay_catalog, road_catalog, trip_catalog, trust_catalog  # noqa: E402, F401  (they add their queries)

__all__ = ["ORACLE_SQL", "QUERIES"]
