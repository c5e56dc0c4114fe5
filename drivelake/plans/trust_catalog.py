"""Queries on trust: checks against other records as columns, source states at ticks, and the full fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivelake.functions import geo
from drivelake.operators import satellites, throttle, tracks, trust
from drivelake.plans.registry import _hav, _query, _r, _wrap
from drivelake.sources.fixes import FIX_SQL, fix_view
from drivelake.sources.views import flat_sql, flat_view, record_tables
from drivelake.streaming.trust_fold import events_of, trust_batch

_ONE = "(SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY drive_id, t_ns ORDER BY seq DESC) AS k FROM {0}) WHERE k = 1)"


@_query(f"""WITH {flat_sql('location', 'provider_event')}, ev AS (SELECT *, event = 'OVERRIDDEN' AS o FROM v_provider_event WHERE event IN ('OVERRIDDEN', 'RESTORED')), ch AS (SELECT *, CASE WHEN o AND NOT coalesce(lag(o) OVER w, false) THEN 1 WHEN NOT o AND coalesce(lag(o) OVER w, false) THEN -1 ELSE 0 END AS d FROM ev WINDOW w AS (PARTITION BY drive_id, provider ORDER BY t_ns, seq)),
    f AS (SELECT l.drive_id, l.seq, l.t_ns, l.source, (SELECT arg_max(o, {{'t': e.t_ns, 's': e.seq}}) FROM ch e WHERE e.drive_id = l.drive_id AND e.provider = l.provider AND e.t_ns <= l.t_ns) AS r, (SELECT sum(d) FROM ch e WHERE e.drive_id = l.drive_id AND e.t_ns <= l.t_ns) AS n, (SELECT max(e.t_ns) FROM ch e WHERE e.drive_id = l.drive_id AND e.t_ns <= l.t_ns AND d = -1) AS b FROM v_location l)
    SELECT drive_id, seq, coalesce(r, false) AS replaced, source = 'FUSED' AND NOT coalesce(r, false) AND (coalesce(n, 0) > 0 OR coalesce(t_ns - b < 10000000000, false)) AS echo FROM f""")
def provider_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trust.provider_state(flat_view(spark, sf_dir, "location"), flat_view(spark, sf_dir, "provider_event"))
    return out.select("drive_id", "seq", "replaced", "echo")


_SAT_SQL = """sg AS (SELECT p.drive_id, p.t_ns, p.seq, count(*) FILTER (s.used_in_fix) AS used, CASE WHEN count(*) FILTER (s.used_in_fix) > 1 THEN stddev_samp(CASE WHEN s.used_in_fix THEN s.cn0_dbhz END) END AS sd FROM v_gnss_status p LEFT JOIN v_gnss_sat s ON p.drive_id = s.drive_id AND p.t_ns = s.t_ns GROUP BY ALL)"""


@_query(f"""WITH {flat_sql('location', 'vehicle_speed', 'gnss_status', 'gnss_sat')}, {_SAT_SQL}, l AS (SELECT * FROM v_location WHERE source = 'GNSS'),
    a AS (SELECT l.*, o.speed_mps AS ov, (l.t_ns - o.t_ns) / 1e9 AS oa FROM l ASOF LEFT JOIN {_ONE.format('v_vehicle_speed')} o ON l.drive_id = o.drive_id AND l.t_ns >= o.t_ns), b AS (SELECT a.*, s.used, s.sd, (a.t_ns - s.t_ns) / 1e9 AS sa FROM a ASOF LEFT JOIN {_ONE.format('sg')} s ON a.drive_id = s.drive_id AND a.t_ns >= s.t_ns)
    SELECT drive_id, seq, round(ov, 6) + 0 AS obd_mps, round(oa, 6) + 0 AS obd_age_s, coalesce(oa <= 1.5 AND abs(speed_mps - ov) > 1.5 + 0.08 * ov, false) AS obd_mismatch, coalesce(sa <= 2 AND used < 4, false) AS few_satellites, coalesce(sa <= 2 AND used >= 6 AND sd < 1, false) AS uniform_signal FROM b""")
def fix_against_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satellite fixes against the car's speed and the satellites' status as of their time."""
    f = flat_view(spark, sf_dir, "location").filter("source = 'GNSS'")
    f = tracks.as_of(f, flat_view(spark, sf_dir, "vehicle_speed"), {"obd": F.col("speed_mps"), "obd_t": F.col("t_ns")})
    used, _, std = satellites.signal_stats(F.col("sats"))
    f = tracks.as_of(f, record_tables(spark, sf_dir)["gnss_status"], {"used": used, "std_db": std, "sat_t": F.col("t_ns")})
    age = lambda c: (F.col("t_ns") - F.col(c)) / F.lit(1e9)
    few, uniform = trust.satellite_hits(F.col("used"), F.col("std_db"), age("sat_t"))
    return f.select("drive_id", "seq", _r("obd").alias("obd_mps"), _r(age("obd_t")).alias("obd_age_s"), trust.obd_mismatch(F.col("speed_mps"), F.col("obd"), age("obd_t")).alias("obd_mismatch"), few.alias("few_satellites"), uniform.alias("uniform_signal"))


@_query(f"""WITH {FIX_SQL}, p AS (SELECT *, (t_ns - lag(t_ns) OVER w) / 1e9 AS dt, lag(bearing_deg) OVER w AS b0, lag(speed_mps) OVER w AS v0, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lag(h_acc_m) OVER w AS ac, radians((seq * 11 % 120 - 60) * 1.0::DOUBLE) AS turn, (seq % 9) * 1.0::DOUBLE AS still FROM fix WINDOW w AS (PARTITION BY drive_id, source ORDER BY t_ns, seq)),
    q AS (SELECT *, {_hav('la', 'lo', 'lat', 'lon')} AS d, radians({_wrap('lon - lo')}) * (6378137.0::DOUBLE / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(la)), 2)) * cos(radians(la))) AS e, radians(lat - la) * (6378137.0::DOUBLE / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(la)), 2)) * (1 - 6.69437999014e-3) / (1 - 6.69437999014e-3 * pow(sin(radians(la)), 2))) AS n, pow(ac / 1.5096::DOUBLE, 2) + pow(h_acc_m / 1.5096::DOUBLE, 2) + 0 AS s FROM p)
    SELECT drive_id, seq, coalesce(v0 >= 5 AND speed_mps >= 5 AND dt > 0 AND dt <= 5 AND abs({_wrap(f"{_wrap('bearing_deg - b0')} - degrees(turn)")}) > 25 + 10 * dt, false) AS course_mismatch, still >= 3 AND speed_mps > 3 AS moving_while_still, round((e * e + n * n) / s, 4) + 0 AS innovation,
    CAST(CASE WHEN (e * e + n * n) / s > 50 AND d * 20 >= 5000 THEN 2 WHEN (e * e + n * n) / s > 13.8 THEN 1 ELSE 0 END AS INTEGER) AS gate, coalesce(d <= 100 AND h_acc_m <= 30 AND (seq % 4 = 0 OR (seq % 4) * 6 > 10), false) AS agrees FROM q""")
def fix_against_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes against a turn, a time at rest, and a prediction: the fix of the source before stands for it, its distance taken twenty times for the gate."""
    from pyspark.sql import Window

    w = Window.partitionBy("drive_id", "source").orderBy("t_ns", "seq")
    before = {f"_{c}": F.lag(c).over(w) for c in ("t_ns", "bearing_deg", "speed_mps", "lat", "lon", "h_acc_m")}
    f = fix_view(spark, sf_dir).withColumns(before)
    dt, seq = (F.col("t_ns") - F.col("_t_ns")) / F.lit(1e9), F.col("seq")
    turn, still = F.radians((seq * 11 % 120 - 60).cast("double")), (seq % 9).cast("double")
    d = geo.haversine_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    e, n = geo.to_enu(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    s = F.pow(geo.sigma_of_r68(F.col("_h_acc_m")), 2) + F.pow(geo.sigma_of_r68(F.col("h_acc_m")), 2)
    value = geo.nis(e, n, s, F.lit(0.0), s)
    obd_age = F.when(seq % 4 != 0, (seq % 4 * 6).cast("double"))
    return f.select(
        "drive_id", "seq", trust.course_mismatch(F.col("_bearing_deg"), F.col("bearing_deg"), F.col("_speed_mps"), F.col("speed_mps"), dt, turn).alias("course_mismatch"), trust.moving_while_still(F.col("speed_mps"), still).alias("moving_while_still"),
        _r(value, 4).alias("innovation"), trust.innovation_hit(value, d * 20).alias("gate"), trust.agrees_with_estimate(d, F.col("h_acc_m"), obd_age).alias("agrees"),
    )


_SWITCH_SQL = "ev AS (SELECT *, event = 'OVERRIDDEN' AS o FROM v_provider_event WHERE event IN ('OVERRIDDEN', 'RESTORED')), ch AS (SELECT *, CASE WHEN o AND NOT coalesce(lag(o) OVER w, false) THEN 1 WHEN NOT o AND coalesce(lag(o) OVER w, false) THEN -1 ELSE 0 END AS d FROM ev WINDOW w AS (PARTITION BY drive_id, provider ORDER BY t_ns, seq))"


def _switched(rows: str, before: str) -> str:
    """Whether a row's provider is replaced (r), how many are (n), and when one was given back last (b), by events before (or at) it."""
    hit = f"FROM ch e WHERE e.drive_id = l.drive_id AND e.t_ns {before} l.t_ns"
    return f"SELECT l.*, coalesce((SELECT arg_max(o, {{'t': e.t_ns, 's': e.seq}}) {hit} AND e.provider = l.provider), false) AS r, coalesce((SELECT sum(d) {hit}), 0) AS n, (SELECT max(e.t_ns) {hit} AND d = -1) AS b FROM {rows} l"


@_query(f"""WITH {flat_sql('location', 'provider_event')}, {_SWITCH_SQL}, f AS ({_switched('v_location', '<=')}),
    v AS (SELECT drive_id, t_ns, seq, source, provider, CASE WHEN h_acc_m > 150 THEN 'REJECTED' WHEN h_acc_m > 30 THEN 'QUESTIONABLE' ELSE 'TRUSTED' END AS state FROM f WHERE NOT is_mock AND NOT r AND NOT (source = 'FUSED' AND (n > 0 OR coalesce(t_ns - b < 10000000000, false)))),
    o AS (SELECT * EXCLUDE (k), t_ns AS vt FROM (SELECT *, row_number() OVER (PARTITION BY drive_id, source, t_ns ORDER BY seq DESC) AS k FROM v) WHERE k = 1),
    t AS (SELECT drive_id, unnest(generate_series((a + 9999999999) // 10000000000 * 10000000000, b, 10000000000)) AS t_ns FROM (SELECT drive_id, min(t_ns) AS a, max(t_ns) AS b FROM v_location GROUP BY drive_id)),
    x AS (SELECT t.drive_id, t.t_ns, s.source FROM t JOIN (SELECT DISTINCT drive_id, source FROM v_location) s USING (drive_id)),
    y AS (SELECT x.*, o.provider, o.state, o.vt FROM x ASOF LEFT JOIN o ON x.drive_id = o.drive_id AND x.source = o.source AND x.t_ns > o.t_ns), z AS ({_switched('y', '<')})
    SELECT drive_id, t_ns, source, CASE WHEN t_ns - vt <= 5000000000 AND NOT r AND NOT (source = 'FUSED' AND (n > 0 OR coalesce(t_ns - b < 10000000000, false))) THEN state ELSE 'UNAVAILABLE' END AS state FROM z""")
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's state each ten seconds, by accuracy, with synthetic fixes and replaced providers."""
    f = flat_view(spark, sf_dir, "location")
    v = f.select("drive_id", "t_ns", "seq", "source", "provider", F.col("is_mock").alias("synthetic"), F.when(F.col("h_acc_m") > 150, "REJECTED").when(F.col("h_acc_m") > 30, "QUESTIONABLE").otherwise("TRUSTED").alias("state"))
    return trust.source_states(tracks.tick_grid(f, 10.0), v, flat_view(spark, sf_dir, "provider_event"))


@_query(f"""WITH {flat_sql('power', 'wifi_scan', 'wifi_ap')}, w AS (SELECT drive_id, t_ns, seq, seen_ns, max(seen_ns) OVER (PARTITION BY drive_id ORDER BY t_ns RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (SELECT drive_id, t_ns, seq, t_ns - (seq % 1000) * 40000000000 AS seen_ns FROM v_wifi_ap)) SELECT drive_id, t_ns, seq, 'wifi' AS type FROM w WHERE p IS NULL OR seen_ns > p""")
def newly_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access points that were seen since the last scan told of."""
    ap = flat_view(spark, sf_dir, "wifi_ap").withColumn("seen_ns", F.col("t_ns") - F.col("seq") % 1000 * 40_000_000_000)
    return throttle.newly_seen(ap).select("drive_id", "t_ns", "seq", F.lit("wifi").alias("type"))


def fold_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Record tables of all drives for the folds: fixes with a latency, recorded speeds, satellite statuses, provider events. drive_id is a number."""
    fixes = fix_view(spark, sf_dir).select("drive_id", "seq", "t_ns", "source", F.lower("source").alias("provider"), "lat", "lon", "h_acc_m", "speed_mps", "bearing_deg", F.col("is_mock").alias("synthetic"), ((F.col("seq") * 13 % 140) / F.lit(10.0)).alias("latency_s"))
    number = lambda df: df.withColumn("drive_id", F.col("drive_id").cast("long"))
    return {
        "location": fixes, "vehicle_speed": number(flat_view(spark, sf_dir, "vehicle_speed")), "gnss_status": number(satellites.chip_health(record_tables(spark, sf_dir)["gnss_status"])),
        "provider_event": number(flat_view(spark, sf_dir, "provider_event").filter("seq % 5 = 0")),
    }


def fold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as events."""
    t = fold_tables(spark, sf_dir)
    return events_of(t["location"], t["vehicle_speed"], t["gnss_status"], t["provider_event"])


@_query()
def trust_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full fold over every drive; tests hold it against its stream twin and against hand-made cases."""
    return trust_batch(fold_events(spark, sf_dir))


@_query()
def throttled_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power states that a recorder keeps: changes, and one each minute."""
    return throttle.at_most_every(flat_view(spark, sf_dir, "power"), ["plug", "charging"], 60.0).select("drive_id", "seq")


@_query()
def probe_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When windows open and close under the full fold's verdicts, with short times, as the fix view's rows are far apart."""
    from drivelake.streaming.probe import ProbeRules, probe_actions

    number = lambda df: df.withColumn("drive_id", F.col("drive_id").cast("long"))
    status = number(satellites.chip_health(record_tables(spark, sf_dir)["gnss_status"]))
    rules = ProbeRules(healthy_s=0.0, pause_s=20.0, window_s=60.0, no_fix_s=40.0, status_age_s=60.0, loss_s=60.0, unhealthy_s=60.0)
    return probe_actions(status.select("drive_id", "t_ns", "seq", "healthy"), trust_batch(fold_events(spark, sf_dir)), tracks.tick_grid(fix_view(spark, sf_dir)), rules)
