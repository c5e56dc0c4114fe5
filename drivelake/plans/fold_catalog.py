"""Queries on motion from a phone's sensors, votes of coarse fixes, and whole drives under the filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivelake.operators import metrics, motion, retiming, rigid, tracks, trust
from drivelake.plans.motion_catalog import _RECKON_SQL, _reckoned
from drivelake.plans.registry import _hav, _query, _r, _wrap
from drivelake.sources.fixes import FIX_SQL, fix_view
from drivelake.sources.views import flat_sql, flat_view, phone_samples, phone_sql
from drivelake.streaming import compass, tracker


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    speeds = flat_view(spark, sf_dir, "vehicle_speed").withColumn("drive_id", F.col("drive_id").cast("long"))
    return tracker.samples_of(phone_samples(spark, sf_dir), speeds=speeds)


@_query()
def motion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tracker makes of every drive's sensors; tests hold it against hand-made drives and plain windows."""
    out = tracker.motion_batch(_samples(spark, sf_dir))
    scalars = ("yaw_rate", "still_s", "gyro_mean", "accel_std", "tilt_rms", "horizontal_accel", "bearing", "east_m", "north_m", "way_m")
    return out.select("drive_id", "t_ns", *(_r(c).alias(c) for c in scalars), "still", "still_loose", "mount", "gaps")


@_query(f"""WITH RECURSIVE {phone_sql()}, a AS (SELECT drive_id, t_ns, seq, x, y, z, row_number() OVER w AS n, coalesce((t_ns - lag(t_ns) OVER w) / 1e9, 0) AS dt FROM phone WHERE kind = 'ACCEL' WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns, seq)),
    s AS (SELECT *, 1 - exp(-least(dt, 0.5) / 5.0::DOUBLE) AS k FROM a), y AS (SELECT drive_id, n, seq, x AS sx, y AS sy, z AS sz FROM s WHERE n = 1 UNION ALL
    SELECT s.drive_id, s.n, s.seq, y.sx + (s.x - y.sx) * s.k, y.sy + (s.y - y.sy) * s.k, y.sz + (s.z - y.sz) * s.k FROM y JOIN s ON s.drive_id = y.drive_id AND s.n = y.n + 1)
    SELECT drive_id, seq, round(sx, 6) + 0 AS gx, round(sy, 6) + 0 AS gy, round(sz, 6) + 0 AS gz FROM y""")
def low_pass_gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gravity in the phone's frame by a low pass of five seconds."""
    g = motion.low_pass(phone_samples(spark, sf_dir).filter("kind = 'ACCEL'"), ["x", "y", "z"], 5.0)
    return g.select("drive_id", "seq", *(_r(f"smooth_{c}").alias(f"g{c}") for c in "xyz"))


@_query(f"""WITH {phone_sql()}, g AS (SELECT *, least(coalesce((t_ns - lag(t_ns) OVER w) / 1e9, 0), 0.2) AS dt FROM phone WHERE kind = 'GYRO' WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns, seq)),
    s AS (SELECT drive_id, seq, sum(x * dt) OVER w AS sx, sum(y * dt) OVER w AS sy FROM g WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns RANGE BETWEEN 3000000000 PRECEDING AND CURRENT ROW)) SELECT drive_id, seq, round(sqrt(sx * sx + sy * sy), 6) + 0 AS tilt_rad FROM s""")
def net_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net rotation about horizontal axes over three seconds, with the phone's own axes."""
    return motion.net_tilt(phone_samples(spark, sf_dir).filter("kind = 'GYRO'")).select("drive_id", "seq", _r("tilt_rad").alias("tilt_rad"))


_AT = "{0} + CASE WHEN f > 0 THEN f * ({1} - {0}) ELSE 0 END"


@_query(f"""WITH {_RECKON_SQL}, one AS (SELECT *, row_number() OVER (PARTITION BY drive_id, t_ns ORDER BY seq DESC) AS k FROM r),
    br AS (SELECT drive_id, t_ns AS ta, lead(t_ns) OVER w AS tb, east, lead(east) OVER w AS e1, north, lead(north) OVER w AS n1, way, lead(way) OVER w AS w1, gaps, lead(gaps) OVER w AS g1 FROM one WHERE k = 1 WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns)),
    nf AS (SELECT drive_id, t_ns, seq, lat, lon, h_acc_m, h_acc_m <= 30 AS trusted FROM fix WHERE source = 'NETWORK'), tr AS (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY t_ns, seq) AS n FROM nf WHERE trusted),
    tq AS (SELECT drive_id, t_ns AS tt, max(n) AS n FROM tr GROUP BY ALL), ak AS (SELECT nf.*, tq.n AS ln FROM nf ASOF JOIN tq ON nf.drive_id = tq.drive_id AND nf.t_ns > tq.tt),
    pr AS (SELECT ak.drive_id, ak.seq, ak.t_ns AS t2, ak.lat, ak.lon, ak.h_acc_m, v.n, v.t_ns AS t1, v.lat AS va, v.lon AS vo, v.h_acc_m AS vh FROM ak JOIN tr v ON v.drive_id = ak.drive_id AND v.n > ak.ln - 3 AND v.n <= ak.ln WHERE (ak.t_ns - v.t_ns) / 1e9 <= 180),
    mo AS (SELECT drive_id, seq, n, 1 AS w, t1 AS t FROM pr UNION ALL SELECT drive_id, seq, n, 2, t2 FROM pr), h AS (SELECT mo.*, br.* EXCLUDE (drive_id), CASE WHEN tb IS NULL THEN 0 ELSE (mo.t - ta) / (tb - ta)::DOUBLE END AS f FROM mo ASOF JOIN br ON mo.drive_id = br.drive_id AND mo.t >= ta),
    q AS (SELECT drive_id, seq, n, w, {_AT.format('east', 'e1')} AS e, {_AT.format('north', 'n1')} AS nn, {_AT.format('way', 'w1')} AS d, gaps AS ga, coalesce(g1, gaps) AS gb FROM h WHERE tb IS NOT NULL OR t <= ta + 200000000),
    o AS (SELECT a.drive_id, a.seq, a.n, b.d - a.d AS way, sqrt(pow(b.e - a.e, 2) + pow(b.nn - a.nn, 2)) AS chord FROM q a JOIN q b ON a.drive_id = b.drive_id AND a.seq = b.seq AND a.n = b.n AND a.w = 1 AND b.w = 2 WHERE a.ga = b.gb),
    vt AS (SELECT pr.*, abs({_hav('va', 'vo', 'lat', 'lon')} - chord) <= 3 * sqrt(pow(vh / 1.5096::DOUBLE, 2) + pow(h_acc_m / 1.5096::DOUBLE, 2)) + 0.05 * way + 10 AS ok, 1 / (pow(greatest(vh / 1.5096::DOUBLE, 50), 2) + pow(greatest(h_acc_m / 1.5096::DOUBLE, 50), 2)) AS wt FROM pr JOIN o USING (drive_id, seq, n)),
    sm AS (SELECT drive_id, seq, count(*) AS nv, sum(CASE WHEN ok THEN wt ELSE 0 END) AS wf, sum(CASE WHEN ok THEN 0 ELSE wt END) AS wa FROM vt WHERE ok IS NOT NULL GROUP BY drive_id, seq)
    SELECT nf.drive_id, nf.seq, coalesce(nv, 0) + 0 AS n_votes, round(1e6 * coalesce(wf, 0), 6) + 0 AS weight_for, round(1e6 * coalesce(wa, 0), 6) + 0 AS weight_against, coalesce(wa > wf, false) AS disputed FROM nf LEFT JOIN sm USING (drive_id, seq)""")
def coarse_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights (in millionths) for and against each network fix, those of 30 m accuracy being trusted."""
    f = fix_view(spark, sf_dir).filter("source = 'NETWORK'").withColumn("trusted", F.col("h_acc_m") <= 30)
    v = trust.coarse_votes(f, _reckoned(spark, sf_dir))
    return v.select("drive_id", "seq", "n_votes", _r(F.col("weight_for") * 1e6).alias("weight_for"), _r(F.col("weight_against") * 1e6).alias("weight_against"), "disputed")


@_query(f"""WITH {FIX_SQL}, v AS (SELECT drive_id, t_ns, source, arg_max(CASE WHEN h_acc_m > 150 THEN 'REJECTED' WHEN h_acc_m > 30 THEN 'QUESTIONABLE' ELSE 'TRUSTED' END, seq) AS state FROM fix WHERE NOT is_mock GROUP BY ALL),
    f AS (SELECT *, row_number() OVER (PARTITION BY drive_id, t_ns, source ORDER BY seq DESC) AS k FROM fix) SELECT f.drive_id, f.seq, CASE WHEN k = 1 THEN v.state END AS state FROM f LEFT JOIN v ON f.drive_id = v.drive_id AND f.t_ns = v.t_ns AND f.source = v.source""")
def verdict_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fix with its verdict's state by accuracy; synthetic ones have no verdict."""
    f = fix_view(spark, sf_dir)
    v = f.filter("NOT is_mock").select("drive_id", "t_ns", "seq", "source", F.when(F.col("h_acc_m") > 150, "REJECTED").when(F.col("h_acc_m") > 30, "QUESTIONABLE").otherwise("TRUSTED").alias("state"))
    return trust.verdict_fixes(v, f).select("drive_id", "seq", "state")


def _ellipse_sql() -> str:
    """Sums of monomials of v_imu by drive, Gauss-Jordan elimination of the five normal equations, and the ellipse; one CTE a step."""
    basis = ["u * u", "u * v", "v * v", "u", "v", "1"]
    steps = ["p AS (SELECT drive_id, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM v_imu GROUP BY drive_id)", "q AS (SELECT i.drive_id, n, mx, my, x - mx AS u, y - my AS v FROM v_imu i JOIN p USING (drive_id))"]
    steps.append("g0 AS (SELECT drive_id, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, " + ", ".join(f"sum({basis[i]} * {basis[j]}) AS m{i}{j}" for i in range(5) for j in range(6)) + " FROM q GROUP BY drive_id)")
    for k in range(5):
        row = lambda i, j: f"m{k}{j} / m{k}{k}" if i == k else f"m{i}{j} - m{i}{k} * (m{k}{j} / m{k}{k})"  # noqa: B023, E731
        steps.append(f"g{k + 1} AS (SELECT drive_id, n, mx, my, " + ", ".join(f"{row(i, j)} AS m{i}{j}" for i in range(5) for j in range(6)) + f" FROM g{k})")
    steps.append("e AS (SELECT *, m05 AS a, m15 AS b, m25 AS c, m35 AS d, m45 AS e, 4 * m05 * m25 - m15 * m15 AS det FROM g5)")
    steps.append("f AS (SELECT *, (b * e - 2 * c * d) / det AS cx, (b * d - 2 * a * e) / det AS cy FROM e)")
    steps.append("h AS (SELECT *, 1 + a * cx * cx + b * cx * cy + c * cy * cy AS k FROM f)")
    steps.append("r AS (SELECT *, a / k AS p11, b / 2 / k AS p12, c / k AS p22 FROM h WHERE n >= 6 AND a > 0 AND c > 0 AND det > 0 AND k > 0)")
    steps.append("w AS (SELECT *, sqrt((p11 + p22) / 2 + sqrt(pow((p11 - p22) / 2, 2) + p12 * p12)) AS s1, sqrt(greatest((p11 + p22) / 2 - sqrt(pow((p11 - p22) / 2, 2) + p12 * p12), 0)) AS s2, atan2(2 * p12, p11 - p22) / 2 AS t FROM r)")
    return ", ".join(steps)


@_query(f"""WITH {flat_sql('imu')}, {_ellipse_sql()}, z AS (SELECT *, 1 / sqrt(s1 * s2) AS rad FROM w WHERE s2 > 0 AND s1 <= 2 * s2)
    SELECT p.drive_id, p.n, round(z.mx + cx, 4) + 0 AS a, round(z.my + cy, 4) + 0 AS b, round(rad * (pow(cos(t), 2) * s1 + pow(sin(t), 2) * s2), 5) + 0 AS w11, round(rad * cos(t) * sin(t) * (s1 - s2), 5) + 0 AS w12,
    round(rad * (pow(sin(t), 2) * s1 + pow(cos(t), 2) * s2), 5) + 0 AS w22, round(rad, 4) + 0 AS radius FROM p LEFT JOIN z USING (drive_id)""")
def ellipse_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = motion.ellipse_fit(flat_view(spark, sf_dir, "imu").select("drive_id", "x", "y"), ["drive_id"])
    return e.select("drive_id", "n", *(_r(c, 4).alias(c) for c in ("a", "b")), *(_r(c, 5).alias(c) for c in ("w11", "w12", "w22")), _r("radius", 4).alias("radius"))


@_query(f"""WITH {flat_sql('imu')}, c AS (SELECT drive_id, t_ns // 60000000000 AS m, avg(x) AS x, avg(y) AS y FROM v_imu GROUP BY ALL) SELECT a.drive_id, CAST(count(DISTINCT a.m) AS INTEGER) AS n, round(max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) + 0 AS widest FROM c a JOIN c b ON a.drive_id = b.drive_id GROUP BY a.drive_id""")
def centre_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the centres of a drive's minutes are apart."""
    c = flat_view(spark, sf_dir, "imu").groupBy("drive_id", F.expr("t_ns div 60000000000").alias("m")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return motion.widest(c, ["drive_id"]).withColumn("widest", _r("widest"))


@_query(f"""WITH RECURSIVE {flat_sql('imu')}, a AS (SELECT drive_id, seq, z, row_number() OVER (PARTITION BY drive_id ORDER BY t_ns, seq) AS n FROM v_imu), y AS (SELECT drive_id, n, seq, z AS r FROM a WHERE n = 1 UNION ALL
    SELECT a.drive_id, a.n, a.seq, CASE WHEN a.n <= 20 THEN y.r + (a.z - y.r) / a.n ELSE y.r + 0.02::DOUBLE * sign(a.z - y.r) END FROM y JOIN a ON a.drive_id = y.drive_id AND a.n = y.n + 1) SELECT drive_id, seq, round(r, 6) + 0 AS running FROM y""")
def vertical_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed median of the sensors' vertical part, from the mean of twenty rows."""
    return motion.signed_median(flat_view(spark, sf_dir, "imu").select("drive_id", "t_ns", "seq", "z"), "z", 20).select("drive_id", "seq", _r("running").alias("running"))


@_query()
def compass_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the compass of each drive is worth; tests hold it against drives through a known field."""
    number = lambda df: df.withColumn("drive_id", F.col("drive_id").cast("long"))
    magnet = number(flat_view(spark, sf_dir, "imu")).filter("kind = 'MAG_UNCAL'").select("drive_id", "t_ns", "kind", "x", "y", "z")
    every = phone_samples(spark, sf_dir).select("drive_id", "t_ns", "kind", "x", "y", "z").unionByName(magnet)
    truth = fix_view(spark, sf_dir).filter("source = 'GNSS' AND h_acc_m <= 30").select("drive_id", "t_ns", "bearing_deg", "speed_mps")
    rows = compass.compass_rows(every, truth, number(flat_view(spark, sf_dir, "geomag")), number(flat_view(spark, sf_dir, "power")), max_gap_s=60.0)
    return compass.compass_summary(rows).select("drive_id", "verdict", "reasons", "fit", "octants", "mounts", "n_errors", _r("p50_deg").alias("p50_deg"))


_Z = ("(radians({lon} - lo0) * (6378137.0::DOUBLE / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(la0)), 2)) * cos(radians(la0))))", "(radians({lat} - la0) * (6378137.0::DOUBLE / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(la0)), 2)) * (1 - 6.69437999014e-3) / (1 - 6.69437999014e-3 * pow(sin(radians(la0)), 2))))")


def _rounds() -> str:
    """Five rounds of weighted turn and shift over the fixes (zx, zy, px, py, acc) of each tick (drive_id, t)."""
    out = ["p0 AS (SELECT *, 1 / (acc * acc) AS w FROM ok)"]
    for k in range(5):
        out.append(f"m{k} AS (SELECT drive_id, t, sum(w * zx) / sum(w) AS zmx, sum(w * zy) / sum(w) AS zmy, sum(w * px) / sum(w) AS pmx, sum(w * py) / sum(w) AS pmy FROM p{k} GROUP BY ALL)")
        out.append(f"h{k} AS (SELECT drive_id, t, any_value(zmx) AS zmx, any_value(zmy) AS zmy, any_value(pmx) AS pmx, any_value(pmy) AS pmy, sum(w * ((zx - zmx) * (px - pmx) + (zy - zmy) * (py - pmy))) AS hx, sum(w * ((zy - zmy) * (px - pmx) - (zx - zmx) * (py - pmy))) AS hy FROM p{k} JOIN m{k} USING (drive_id, t) GROUP BY ALL)")
        out.append(f"r{k} AS (SELECT *, hx / sqrt(hx * hx + hy * hy) AS c, hy / sqrt(hx * hx + hy * hy) AS s FROM h{k})")
        out.append(f"f{k} AS (SELECT drive_id, t, c, s, zmx - (c * pmx - s * pmy) AS tx, zmy - (s * pmx + c * pmy) AS ty FROM r{k})")
        if k < 4:
            out.append(f"p{k + 1} AS (SELECT ok.*, least(1, 2 * acc / greatest(sqrt(pow(zx - (c * px - s * py + tx), 2) + pow(zy - (s * px + c * py + ty), 2)), 1e-6)) / (acc * acc) AS w FROM ok JOIN f{k} USING (drive_id, t))")
    return ", ".join(out)


@_query(f"""WITH {_RECKON_SQL}, one AS (SELECT * EXCLUDE (k) FROM (SELECT drive_id, t_ns AS pt, east, north, row_number() OVER (PARTITION BY drive_id, t_ns ORDER BY seq DESC) AS k FROM r) WHERE k = 1),
    g AS (SELECT f.drive_id, f.t_ns, f.seq, f.lat, f.lon, f.h_acc_m AS acc, o.east AS px, o.north AS py FROM (SELECT * FROM fix WHERE source = 'GNSS' AND h_acc_m > 0) f ASOF JOIN one o ON f.drive_id = o.drive_id AND f.t_ns >= o.pt),
    a AS (SELECT drive_id, avg(lat) AS la0, avg(lon) AS lo0 FROM g GROUP BY drive_id), z AS (SELECT g.*, la0, lo0, {_Z[0].format(lon='lon')} AS zx, {_Z[1].format(lat='lat')} AS zy FROM g JOIN a USING (drive_id)),
    tk AS (SELECT drive_id, unnest(generate_series((lo + 9999999999) // 10000000000 * 10000000000, hi, 10000000000)) AS t FROM (SELECT drive_id, min(t_ns) AS lo, max(t_ns) AS hi FROM fix GROUP BY drive_id)),
    tp AS (SELECT tk.drive_id, tk.t, o.east AS qx, o.north AS qy FROM tk ASOF JOIN one o ON tk.drive_id = o.drive_id AND tk.t >= o.pt), w AS (SELECT tp.drive_id, tp.t, z.* EXCLUDE (drive_id), count(*) OVER v AS n, arg_max(px, (t_ns, seq)) OVER v AS lx, arg_max(py, (t_ns, seq)) OVER v AS ly FROM tp JOIN z ON z.drive_id = tp.drive_id AND z.t_ns BETWEEN tp.t - 300000000000 AND tp.t WINDOW v AS (PARTITION BY tp.drive_id, tp.t)),
    ok AS (SELECT * FROM w WHERE n >= 6 QUALIFY max(sqrt(pow(px - lx, 2) + pow(py - ly, 2))) OVER (PARTITION BY drive_id, t) >= 150), {_rounds()}, e AS (SELECT f4.*, c * qx - s * qy + tx AS x, s * qx + c * qy + ty AS y, la0, lo0 FROM f4 JOIN tp USING (drive_id, t) JOIN a USING (drive_id))
    SELECT e.drive_id, e.t AS t_ns, CAST(n AS INTEGER) AS n, round(la0 + degrees(y / (6378137.0::DOUBLE / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(la0)), 2)) * (1 - 6.69437999014e-3) / (1 - 6.69437999014e-3 * pow(sin(radians(la0)), 2)))), 6) + 0 AS lat,
    round(lo0 + degrees(x / (6378137.0::DOUBLE / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(la0)), 2)) * cos(radians(la0)))), 6) + 0 AS lon, round(atan2(s, c), 5) + 0 AS turn_rad FROM e JOIN (SELECT DISTINCT drive_id, t, n FROM ok) USING (drive_id, t)""")
def rigid_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead-reckoned path over satellite fixes of five minutes, each ten seconds."""
    f = fix_view(spark, sf_dir)
    out = rigid.rigid_places(tracks.tick_grid(f, 10.0), f.filter("source = 'GNSS'"), _reckoned(spark, sf_dir))
    return out.select("drive_id", "t_ns", "n", _r("lat", 6).alias("lat"), _r("lon", 6).alias("lon"), _r("turn_rad", 5).alias("turn_rad"))


@_query()
def retimed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each drive's satellite fixes moved along their route by the corners of the dead-reckoned bearing; tests hold it against tracks of known delay."""
    f = fix_view(spark, sf_dir).filter("source = 'GNSS'")
    turns = _reckoned(spark, sf_dir).select("drive_id", "t_ns", "seq", F.degrees("bearing").alias("heading_deg"))
    return retiming.retime_tracks(f, turns, retiming.RetimingRules(step_s=0.25)).select("drive_id", "seq", _r("lat", 7).alias("lat"), _r("lon", 7).alias("lon"), "corners")


@_query(f"""WITH {FIX_SQL}, m AS (SELECT drive_id, degrees(atan2(sum(speed_mps * sin(radians(bearing_deg))), sum(speed_mps * cos(radians(bearing_deg))))) AS b FROM fix GROUP BY drive_id)
    SELECT drive_id, round(sqrt(avg(pow({_wrap('bearing_deg - b')}, 2))), 5) + 0 AS rms_deg FROM fix JOIN m USING (drive_id) GROUP BY drive_id""")
def circular_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far bearings lie from their mean, weighted by speed."""
    return metrics.circular_residual(fix_view(spark, sf_dir), ["drive_id"], "bearing_deg", F.col("speed_mps")).select("drive_id", _r("rms_deg", 5).alias("rms_deg"))
