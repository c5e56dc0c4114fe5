"""Queries on replays: truth, estimates, labels, metrics and reports, under stateless verdicts (with SQL) and under the full fold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivelake.functions import geo
from drivelake.operators import metrics, replay, scenario, tracks
from drivelake.plans.registry import _hav, _query, _r, _wrap
from drivelake.plans.trust_catalog import fold_tables
from drivelake.sources.fixes import FIX_SQL, fix_view
from drivelake.sources.scratch import scratch_folder, stored
from drivelake.sources.views import phone_samples
from drivelake.streaming.drive_fold import estimates_of, fold_batch, fold_events_of, verdicts_of
from drivelake.streaming.trust_fold import trust_batch

_STEPS = [scenario.Step("drop_source", 100, 60, drop_raw=False), scenario.Step("offset", 250, 200, east_m=600, ramp_s=30)]
#: Fixes are far apart in the fix view, so truth may bridge a minute.
_GAP_S = 60
_REP_SQL = f"""{FIX_SQL}, sp AS (SELECT drive_id, min(t_ns) AS t0, max(t_ns) AS e FROM fix GROUP BY drive_id), fx AS (SELECT f.*, lower(f.source) AS provider, (t_ns - t0) / 1e9 AS rel FROM fix f JOIN sp USING (drive_id)),
    mv AS (SELECT *, source IN ('GNSS', 'FUSED') AND rel >= 250 AND rel < 450 AS act FROM fx WHERE NOT (source = 'GNSS' AND rel >= 100 AND rel < 160)),
    pf AS (SELECT * REPLACE (CASE WHEN act THEN {_wrap("lon + degrees(600 * least(greatest((rel - 250) / 30, 0), 1) / (6378137.0::DOUBLE / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(lat)), 2)) * cos(radians(lat))))")} ELSE lon END AS lon), lon AS lon0 FROM mv),
    vd AS (SELECT *, CASE WHEN is_mock OR h_acc_m > 150 THEN 'REJECTED' WHEN h_acc_m > 30 OR h_acc_m IS NULL THEN 'QUESTIONABLE' ELSE 'TRUSTED' END AS state FROM pf),
    vo AS (SELECT *, CASE WHEN is_mock OR h_acc_m > 150 THEN 'REJECTED' WHEN h_acc_m > 30 OR h_acc_m IS NULL THEN 'QUESTIONABLE' ELSE 'TRUSTED' END AS state FROM fx),
    g1 AS (SELECT *, row_number() OVER (PARTITION BY drive_id, t_ns ORDER BY seq DESC) AS n FROM fx WHERE source = 'GNSS'), tv AS (SELECT v.drive_id, v.t_ns, v.seq, g.lat, g.lon, g.bearing_deg, g.speed_mps FROM vo v JOIN g1 g ON v.drive_id = g.drive_id AND v.t_ns = g.t_ns AND g.n = 1 AND g.h_acc_m <= 30 WHERE v.source = 'GNSS' AND v.state = 'TRUSTED'),
    t1 AS (SELECT *, row_number() OVER (PARTITION BY drive_id, t_ns ORDER BY seq DESC) AS n FROM tv), tb AS (SELECT drive_id AS td, t_ns AS ta, lead(t_ns) OVER w AS tz, lat AS la, lead(lat) OVER w AS lz, lon AS oa, lead(lon) OVER w AS oz, bearing_deg AS ba, lead(bearing_deg) OVER w AS bz, speed_mps AS va, lead(speed_mps) OVER w AS vz FROM t1 WHERE n = 1 WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns)),
    tk AS (SELECT drive_id, unnest(generate_series((a + 999999999) // 1000000000 * 1000000000, b, 1000000000)) AS t_ns FROM (SELECT drive_id, min(t_ns) AS a, max(t_ns) AS b FROM pf GROUP BY drive_id)),
    tr AS (SELECT * FROM vd WHERE source = 'GNSS' AND state = 'TRUSTED'), tq AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY drive_id, t_ns ORDER BY seq DESC) AS n FROM tr) WHERE n = 1),
    es AS (SELECT k.drive_id, k.t_ns, q.lat, q.lon, q.bearing_deg, q.speed_mps, (k.t_ns - q.t_ns) / 1e9 AS age, coalesce(q.h_acc_m, 10) + 20 * ((k.t_ns - q.t_ns) / 1e9) AS r68 FROM tk k ASOF JOIN tq q ON k.drive_id = q.drive_id AND k.t_ns > q.t_ns),
    wn AS (SELECT drive_id AS wd, i AS step_idx, kind, t0 + s AS ws, least(t0 + s + n, e) AS we FROM sp, (VALUES (0, 'gnss_outage', 100000000000, 60000000000), (1, 'gnss_offset', 250000000000, 200000000000)) AS v(i, kind, s, n)),
    et AS (SELECT es.*, tb.*, CASE WHEN ta = t_ns THEN 0 ELSE (t_ns - ta) / (tz - ta)::DOUBLE END AS u FROM es LEFT JOIN tb ON drive_id = td AND (t_ns = ta OR (t_ns > ta AND t_ns < tz AND tz - ta <= {_GAP_S}000000000))),
    ex AS (SELECT *, CASE WHEN u = 0 THEN la ELSE la + u * (lz - la) END AS tla, CASE WHEN u = 0 THEN oa ELSE oa + u * (oz - oa) END AS tlo, CASE WHEN u = 0 THEN va ELSE va + u * (vz - va) END AS tsp, CASE WHEN u = 0 THEN ba ELSE (ba + u * {_wrap('bz - ba')}) - 360 * floor((ba + u * {_wrap('bz - ba')}) / 360) END AS tbe FROM et),
    tx AS (SELECT ex.*, {_hav('tla', 'tlo', 'lat', 'lon')} AS err_m, CASE WHEN tsp > 3 THEN abs({_wrap('bearing_deg - tbe')}) END AS herr, (SELECT min(step_idx) FROM wn WHERE wd = drive_id AND t_ns >= ws AND t_ns < we) AS wi FROM ex),
    lb AS (SELECT drive_id, t_ns, provider, arg_max({_hav('lat', 'lon0', 'lat', 'lon')}, seq) AS offset_m FROM pf WHERE source IN ('GNSS', 'FUSED') GROUP BY ALL),
    lv AS (SELECT v.drive_id, v.seq, v.t_ns, v.state, l.offset_m, exists (SELECT 1 FROM tb WHERE td = v.drive_id AND (v.t_ns = ta OR (v.t_ns > ta AND v.t_ns < tz AND tz - ta <= 3000000000))) AS has_truth FROM vd v LEFT JOIN lb l ON l.drive_id = v.drive_id AND l.t_ns = v.t_ns AND l.provider = v.provider WHERE v.source = 'GNSS')"""


def _parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Everything of a replay under the steps, with verdicts by accuracy only."""
    f = fix_view(spark, sf_dir).withColumn("provider", F.lower("source"))
    spans = f.groupBy("drive_id").agg(F.min("t_ns").alias("t0_ns"), F.max("t_ns").alias("end_ns"))
    state = F.when(F.col("is_mock") | (F.col("h_acc_m") > 150), "REJECTED").when((F.col("h_acc_m") > 30) | F.col("h_acc_m").isNull(), "QUESTIONABLE").otherwise("TRUSTED")
    moved = scenario.apply_steps(f, _STEPS)
    labels = moved.filter("source IN ('GNSS', 'FUSED')").select("drive_id", "t_ns", "seq", "provider", scenario.injected_offset(moved).alias("offset_m"))
    verdicts = lambda x: x.select("drive_id", "t_ns", "seq", "source", "provider", state.alias("state"))
    truth = replay.truth_track(verdicts(f), f, 30.0)
    estimates = replay.hold_last_fix(tracks.tick_grid(moved), verdicts(moved), moved)
    return {"spans": spans, "truth": truth, "estimates": estimates, "windows": scenario.degraded_windows(spans, _STEPS), "verdicts": verdicts(moved), "labels": labels}


def _tick_rows(p: dict[str, DataFrame]) -> DataFrame:
    e = tracks.interpolate(p["estimates"].withColumn("seq", F.col("t_ns")), p["truth"], _GAP_S)
    e = e.withColumn("err_m", geo.haversine_m(F.col("truth_lat"), F.col("truth_lon"), F.col("lat"), F.col("lon")))
    e = e.withColumn("heading_err_deg", F.when(F.col("truth_speed") > 3, F.abs(geo.wrap_deg(F.col("heading_deg") - F.col("truth_bearing")))))
    return metrics.with_first_window(e, p["windows"])


@_query(f"WITH {_REP_SQL} SELECT drive_id, t_ns, seq, round(lat, 7) + 0 AS lat, round(lon, 7) + 0 AS lon, speed_mps FROM tv")
def replay_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _parts(spark, sf_dir)["truth"]
    return t.select("drive_id", "t_ns", "seq", _r("lat", 7).alias("lat"), _r("lon", 7).alias("lon"), "speed_mps")


@_query(f"WITH {_REP_SQL} SELECT drive_id, t_ns, round(lat, 7) + 0 AS lat, round(lon, 7) + 0 AS lon, round(r68, 6) + 0 AS r68, CASE WHEN age <= 3 THEN 'GNSS_TRACKING' ELSE 'COARSE_ONLY' END AS mode, round(1 / (1 + r68 / 50), 6) + 0 AS confidence FROM es")
def hold_last_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _parts(spark, sf_dir)["estimates"]
    return e.select("drive_id", "t_ns", _r("lat", 7).alias("lat"), _r("lon", 7).alias("lon"), _r("r68").alias("r68"), "mode", _r("confidence").alias("confidence"))


@_query(f"WITH {_REP_SQL} SELECT drive_id, t_ns, round(err_m, 4) + 0 AS err_m, round(herr, 4) + 0 AS heading_err_deg, CAST(wi AS INTEGER) AS step_idx FROM tx")
def replay_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tick_rows(_parts(spark, sf_dir))
    return t.select("drive_id", "t_ns", _r("err_m", 4).alias("err_m"), _r("heading_err_deg", 4).alias("heading_err_deg"), "step_idx")


@_query(f"WITH {_REP_SQL} SELECT drive_id, seq, state, round(offset_m, 4) + 0 AS offset_m, has_truth FROM lv")
def trust_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    return replay.labelled(p["verdicts"], p["labels"], p["truth"]).select("drive_id", "seq", "state", _r("offset_m", 4).alias("offset_m"), "has_truth")


@_query(f"""WITH {_REP_SQL} SELECT drive_id, CAST(step_idx AS INTEGER) AS step_idx, round((min(t_ns) - any_value(ws)) / 1e9, 6) + 0 AS latency_s FROM (SELECT wd AS drive_id, step_idx, ws, we FROM wn WHERE kind <> 'gnss_outage') w
    LEFT JOIN (SELECT drive_id AS vd2, t_ns FROM lv WHERE state <> 'TRUSTED' AND offset_m >= 50) v ON vd2 = drive_id AND t_ns >= ws AND t_ns < we GROUP BY drive_id, step_idx""")
def detection_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    v = replay.labelled(p["verdicts"], p["labels"], p["truth"])
    return replay.detection_latency(v, p["windows"]).withColumn("latency_s", _r("latency_s"))


_FRACTION = "count(*) FILTER (age {}) / count(*)::DOUBLE"


@_query(f"""WITH {_REP_SQL}, a AS (SELECT drive_id, count(*) AS n, count(err_m) AS nt, sqrt(avg(err_m * err_m)) AS rmse, quantile_cont(err_m, 0.5) AS p50, quantile_cont(err_m, 0.95) AS p95, max(err_m) AS mx, sqrt(avg(CASE WHEN wi IS NOT NULL THEN err_m * err_m END)) AS dr, quantile_cont(CASE WHEN wi IS NOT NULL THEN err_m END, 0.95) AS dp,
    quantile_cont(herr, 0.5) AS h50, quantile_cont(herr, 0.95) AS h95, avg(CASE WHEN err_m <= r68 THEN 1.0 WHEN err_m > r68 THEN 0.0 END) AS w68, avg(CASE WHEN err_m <= r68 * 2.4477::DOUBLE / 1.5096::DOUBLE THEN 1.0 WHEN err_m > r68 * 2.4477::DOUBLE / 1.5096::DOUBLE THEN 0.0 END) AS w95, {_FRACTION.format('<= 3')} AS tracking FROM tx GROUP BY drive_id),
    c AS (SELECT drive_id, count(*) FILTER (offset_m < 1 AND has_truth) AS clean, count(*) FILTER (offset_m < 1 AND has_truth AND state <> 'TRUSTED') AS fr, count(*) FILTER (offset_m >= 50) AS pert, count(*) FILTER (offset_m >= 50 AND state = 'TRUSTED') AS md FROM lv GROUP BY drive_id)
    SELECT sp.drive_id, round((e - t0) / 1e9, 6) + 0 AS duration_s, CAST(floor((e - t0) / 1e9) AS INTEGER) AS ticks, coalesce(n, 0) + 0 AS ticks_with_estimate, coalesce(nt, 0) + 0 AS ticks_with_truth, round(rmse, 4) + 0 AS rmse_m, round(p50, 4) + 0 AS p50_m, round(p95, 4) + 0 AS p95_m, round(mx, 4) + 0 AS max_m, round(dr, 4) + 0 AS degraded_rmse_m, round(dp, 4) + 0 AS degraded_p95_m,
    round(h50, 4) + 0 AS heading_p50_deg, round(h95, 4) + 0 AS heading_p95_deg, round(w68, 6) + 0 AS within68, round(w95, 6) + 0 AS within95, round(CASE WHEN tracking > 0 THEN tracking END, 6) + 0 AS tracking, coalesce(clean, 0) + 0 AS clean_fixes, coalesce(fr, 0) + 0 AS false_rejections, coalesce(pert, 0) + 0 AS perturbed_fixes, coalesce(md, 0) + 0 AS missed_detections, CAST(2 AS INTEGER) AS n_windows
    FROM sp LEFT JOIN a USING (drive_id) LEFT JOIN c USING (drive_id)""")
def replay_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole summary of each drive's replay."""
    work = scratch_folder(spark)
    p = _parts(spark, sf_dir)
    p["truth"] = stored(p["truth"], work, "truth")
    # A summary reads ticks three times and verdicts twice; what it doesn't read isn't written.
    ticks = stored(_tick_rows(p).select(*replay.SUMMARIZED), work, "ticks")
    v = stored(replay.labelled(p["verdicts"], p["labels"], p["truth"]).select("drive_id", "t_ns", "state", "offset_m", "has_truth"), work, "labelled")
    s = replay.summarize(ticks, v, p["windows"], p["spans"])
    meters = ("rmse_m", "p50_m", "p95_m", "max_m", "degraded_rmse_m", "degraded_p95_m", "heading_p50_deg", "heading_p95_deg")
    return s.select(
        "drive_id", _r("duration_s").alias("duration_s"), "ticks", "ticks_with_estimate", "ticks_with_truth", *(_r(c, 4).alias(c) for c in meters), _r("within68").alias("within68"), _r("within95").alias("within95"),
        _r(F.try_element_at("mode_fractions", F.lit("GNSS_TRACKING"))).alias("tracking"), "clean_fixes", "false_rejections", "perturbed_fixes", "missed_detections", F.size("windows").alias("n_windows"),
    )


def replay_runs(spark: SparkSession, sf_dir: str, cells: list[tuple[str, str]], whole: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ticks, verdicts and summaries of every drive in cells (scenario, variant), with drive, scenario and variant. Not whole: ticks have what a summary reads only.

    A run's key is "drive|scenario|variant". The steps of both act on fixes and on the other records (a dropped source takes its statuses along),
    so a run's events are made from tables that are read once, without a join. Each run is folded for itself: runs are spread over all tasks.
    Held fixes come from the fold of trust and an as-of join at ticks; the filter's estimates come from the fold of whole drives.
    """
    work = scratch_folder(spark)
    tables = {t: stored(df, work, t) for t, df in fold_tables(spark, sf_dir).items()}
    imu = phone_samples(spark, sf_dir)
    fixes = tables["location"]
    truth = stored(replay.truth_track(trust_batch(fold_events_of(tables)), fixes, 30.0), work, "truth")
    spans = fixes.groupBy("drive_id").agg(F.min("t_ns").alias("t0_ns"), F.max("t_ns").alias("end_ns"))
    starts = stored(spans, work, "spans")
    parts: dict[str, DataFrame] = {}
    for name, variant in cells:
        run = lambda df: df.withColumn("drive_id", F.concat_ws("|", F.col("drive_id").cast("string"), F.lit(name), F.lit(variant)))  # noqa: B023, E731
        v = scenario.VARIANTS[variant]
        steps = [*scenario.SCENARIOS[name], *v.steps]
        moved = scenario.apply_steps(fixes, steps)
        kept = {t: scenario.apply_to_records(df, t, steps, starts.select("drive_id", "t0_ns")) for t, df in tables.items() if t != "location"} | {"location": moved}
        held = v.estimator == "passthrough"
        if not held:
            kept["imu"] = scenario.apply_to_records(imu, "imu", steps, starts.select("drive_id", "t0_ns"))
        labels = moved.filter("source IN ('GNSS', 'FUSED')").select("drive_id", "t_ns", "seq", "provider", scenario.injected_offset(moved).alias("offset_m"))
        made = {f"events {held}": fold_events_of(kept), f"fixes {held}": moved, "labels": labels, "truth": truth, "spans": starts, "windows": scenario.degraded_windows(starts, steps)}
        for key, df in made.items():
            parts[key] = run(df) if key not in parts else parts[key].unionByName(run(df))
    verdicts, estimates = [], []
    if "events True" in parts:
        moved = stored(parts["fixes True"], work, "moved")
        verdicts.append(stored(trust_batch(parts["events True"]), work, "held_verdicts"))
        estimates.append(replay.hold_last_fix(tracks.tick_grid(moved), verdicts[0], moved))
    if "events False" in parts:
        rows = stored(fold_batch(parts["events False"], {n: "baseline" if scenario.VARIANTS[n].compass else "baseline-no-compass" for _, n in cells}), work, "folded")
        verdicts.append(verdicts_of(rows))
        estimates.append(estimates_of(rows))
    names = ("drive_id", "t_ns", "lat", "lon", "r68", "heading_deg", "speed_mps", "mode", "confidence")
    every = lambda dfs, columns: reduce(DataFrame.unionByName, (df.select(*columns) for df in dfs))
    made = _tick_rows(parts | {"estimates": every(estimates, names)})
    ticks = stored(made if whole else made.select(*replay.SUMMARIZED), work, "ticks")
    labelled = stored(replay.labelled(every(verdicts, verdicts[0].columns), parts["labels"], parts["truth"]), work, "labelled")
    summaries = replay.summarize(ticks, labelled, parts["windows"], parts["spans"])
    key = lambda i: F.regexp_extract("drive_id", r"(?s)^(.*)\|([^|]*)\|([^|]*)$", i)
    split = lambda df: df.select(key(1).alias("drive"), key(2).alias("scenario"), key(3).alias("variant"), *[c for c in df.columns if c != "drive_id"])
    return split(ticks), split(labelled), split(summaries)


_KEYS = ["drive", "scenario", "variant"]


@_query()
def replay_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison table of every drive under four scenarios, through the full trust fold; a test holds its parts against each other."""
    cells = [(n, "hold-last-fix") for n in ("clean", "gnss_drop_2min", "gnss_jump_5km", "gnss_teleport_country")]
    return replay.comparison(replay_runs(spark, sf_dir, cells, whole=False)[2], _KEYS)


@_query()
def filter_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison table of every drive without satellites for two minutes: the held fix against the filter on the gyroscope alone."""
    return replay.comparison(replay_runs(spark, sf_dir, [("gnss_drop_2min", "hold-last-fix"), ("gnss_drop_2min", "gyro-only")], whole=False)[2], _KEYS)
