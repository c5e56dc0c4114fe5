"""Replays of recorded drives: truth, estimates of the estimator that holds the last trusted fix, labels, metrics, and comparison tables.

A run is a drive under a scenario and a variant; its key (drive_id) is whatever tells runs apart. Verdicts have drive_id, t_ns, seq, source, provider,
state; fixes are location tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivelake.functions import geo
from drivelake.operators import metrics, tracks

#: Accuracy of a fix that doesn't tell its own, growth of the radius a second, age up to which the mode is tracking.
HOLD_ACC_M, GROWTH_MPS, TRACKING_S = 10.0, 20.0, 3.0
#: Truth takes fixes of this accuracy; an offset up to the first is clean, from the second on perturbed.
TRUTH_ACC_M, CLEAN_M, PERTURBED_M = 10.0, 1.0, 50.0


def truth_track(verdicts: DataFrame, fixes: DataFrame, max_acc_m: float = TRUTH_ACC_M) -> DataFrame:
    """Trusted satellite fixes of at most max_acc_m as truth samples: drive_id, t_ns, seq, lat, lon, bearing_deg (null: unknown), speed_mps (0: unknown).

    A verdict takes the last satellite fix of its time. Fixes without accuracy are no truth.
    """
    last = Window.partitionBy("drive_id", "t_ns").orderBy(F.desc("seq"))
    f = fixes.filter("source = 'GNSS'").withColumn("_n", F.row_number().over(last)).filter(f"_n = 1 AND h_acc_m <= {max_acc_m}")
    ok = verdicts.filter("source = 'GNSS' AND state = 'TRUSTED'").select("drive_id", "t_ns", F.col("seq").alias("_vseq"))
    return ok.join(f, ["drive_id", "t_ns"]).select("drive_id", "t_ns", F.col("_vseq").alias("seq"), "lat", "lon", "bearing_deg", F.coalesce("speed_mps", F.lit(0.0)).alias("speed_mps"))


def hold_last_fix(ticks: DataFrame, verdicts: DataFrame, fixes: DataFrame) -> DataFrame:
    """Estimates at ticks (drive_id, t_ns): the last trusted satellite fix before the tick, with a radius that grows. Ticks before the first one have none.

    drive_id, t_ns, lat, lon, r68, heading_deg, speed_mps, mode, confidence.
    """
    trusted = fixes.join(verdicts.filter("source = 'GNSS' AND state = 'TRUSTED'").select("drive_id", "seq"), ["drive_id", "seq"])
    names = ("lat", "lon", "h_acc_m", "bearing_deg", "speed_mps")
    at = tracks.as_of(ticks.select("drive_id", "t_ns", F.col("t_ns").alias("seq")), trusted, {n: F.col(n) for n in names} | {"_t": F.col("t_ns")}, strict=True).filter("_t IS NOT NULL")
    age = (F.col("t_ns") - F.col("_t")) / F.lit(1e9)
    r68 = F.coalesce("h_acc_m", F.lit(HOLD_ACC_M)) + GROWTH_MPS * age
    mode = F.when(age <= TRACKING_S, "GNSS_TRACKING").otherwise("COARSE_ONLY")
    return at.select("drive_id", "t_ns", "lat", "lon", r68.alias("r68"), F.col("bearing_deg").alias("heading_deg"), "speed_mps", mode.alias("mode"), geo.confidence_of_r68(r68).alias("confidence"))


def tick_rows(estimates: DataFrame, truth: DataFrame, windows: DataFrame, spans: DataFrame) -> DataFrame:
    """Estimates with t_s, truth at their time, err_m, heading_err_deg (truth faster than 3 m/s, both bearings known), and the first window that holds them."""
    e = tracks.interpolate(estimates.withColumn("seq", F.col("t_ns")), truth)
    e = e.withColumn("err_m", geo.haversine_m(F.col("truth_lat"), F.col("truth_lon"), F.col("lat"), F.col("lon")))
    turn = F.abs(geo.wrap_deg(F.col("heading_deg") - F.col("truth_bearing")))
    e = e.withColumn("heading_err_deg", F.when(F.col("truth_speed") > 3, turn))
    e = metrics.with_first_window(e, windows)
    return e.join(spans.select("drive_id", "t0_ns"), "drive_id").withColumn("t_s", (F.col("t_ns") - F.col("t0_ns")) / F.lit(1e9)).drop("seq", "t0_ns")


def labelled(verdicts: DataFrame, labels: DataFrame, truth: DataFrame) -> DataFrame:
    """Satellite verdicts with offset_m of the last label of their time and provider, and has_truth; verdicts without a label have null.

    labels: drive_id, t_ns, seq, provider, offset_m.
    """
    g = verdicts.filter("source = 'GNSS'")
    one = labels.groupBy("drive_id", "t_ns", "provider").agg(F.max_by("offset_m", "seq").alias("offset_m"))
    g = g.join(one, ["drive_id", "t_ns", "provider"], "left")
    return tracks.interpolate(g, truth).withColumn("has_truth", F.col("truth_lat").isNotNull()).select(*g.columns, "has_truth")


def detection_latency(verdicts: DataFrame, windows: DataFrame) -> DataFrame:
    """For each window that moves fixes: drive_id, step_idx, latency_s until the first perturbed satellite fix in it that isn't trusted; null if none is.

    verdicts: drive_id, t_ns, state, offset_m. A drive's windows come as one array by an equi-join.
    """
    moved = windows.filter("kind <> 'gnss_outage'")
    t = F.col("t_ns")
    seen = verdicts.filter((F.col("state") != "TRUSTED") & (F.col("offset_m") >= PERTURBED_M)).join(metrics.windows_of_drives(moved), "drive_id")
    seen = seen.select("drive_id", "t_ns", F.explode(F.filter("windows", lambda w: (t >= w["start_ns"]) & (t < w["end_ns"]))).alias("_w")).groupBy("drive_id", F.col("_w.step_idx").alias("step_idx")).agg(F.min("t_ns").alias("_first"))
    return moved.join(seen, ["drive_id", "step_idx"], "left").select("drive_id", "step_idx", ((F.col("_first") - F.col("start_ns")) / F.lit(1e9)).alias("latency_s"))


#: What summarize reads of ticks.
SUMMARIZED = ("drive_id", "t_ns", "r68", "mode", "err_m", "heading_err_deg", "kind")


def summarize(ticks: DataFrame, verdicts: DataFrame, windows: DataFrame, spans: DataFrame) -> DataFrame:
    """One row a run: durations, ticks, errors, heading errors, calibration, mode fractions (a map), trust rates, and an array of windows with their metrics.

    Runs without an estimate have ticks_with_estimate 0 and null errors. ticks as tick_rows, verdicts as labelled gives them.
    """
    degraded = F.when(F.col("kind").isNotNull(), F.col("err_m"))
    t = ticks.withColumn("_deg", degraded)
    out = t.groupBy("drive_id").agg(
        F.count("*").alias("ticks_with_estimate"), *metrics.error_stats(), F.sqrt(F.avg(F.col("_deg") * F.col("_deg"))).alias("degraded_rmse_m"), F.percentile("_deg", 0.95).alias("degraded_p95_m"),
        F.percentile("heading_err_deg", 0.5).alias("heading_p50_deg"), F.percentile("heading_err_deg", 0.95).alias("heading_p95_deg"),
    ).withColumnRenamed("n", "ticks_with_truth")
    counts = ticks.groupBy("drive_id", "mode").count()
    modes = counts.groupBy("drive_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "count")))).alias("_m"), F.sum("count").alias("_all"))
    modes = modes.select("drive_id", F.transform_values("_m", lambda _, n: n / F.col("_all")).alias("mode_fractions"))
    trust = verdicts.groupBy("drive_id").agg(*metrics.trust_confusion())
    per_window = windows.select("drive_id", "step_idx", "kind", "start_ns", "end_ns").join(metrics.window_metrics(ticks.withColumn("seq", F.col("t_ns")), windows, spans).drop("kind"), ["drive_id", "step_idx"], "left").join(detection_latency(verdicts, windows), ["drive_id", "step_idx"], "left")
    names = [c for c in per_window.columns if c != "drive_id"]
    listed = per_window.groupBy("drive_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("windows"))
    kind = listed.schema["windows"].dataType
    duration = (F.col("end_ns") - F.col("t0_ns")) / F.lit(1e9)
    s = spans.select("drive_id", duration.alias("duration_s"), F.floor(duration).cast("int").alias("ticks"))
    s = s.join(out, "drive_id", "left").join(modes, "drive_id", "left").join(trust, "drive_id", "left").join(listed, "drive_id", "left")
    zero = ("ticks_with_estimate", "ticks_with_truth", "clean_fixes", "false_rejections", "perturbed_fixes", "missed_detections")
    return s.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero} | {"windows": F.coalesce("windows", F.array().cast(kind)), "mode_fractions": F.coalesce("mode_fractions", F.create_map().cast("map<string,double>"))})


def _shown(c: Column, digits: int = 1) -> Column:
    """A number with a fixed count of digits, halves away from zero; a dash for null."""
    return F.coalesce(F.regexp_replace(F.format_number(c, digits), ",", ""), F.lit("\u2013"))


#: The columns of a comparison table.
COMPARISON = (
    "rmse_m", "p50_m", "p95_m", "max_m", "degraded_rmse_m", "degraded_p95_m", "heading_p95_deg", "within68", "within95", "t_exceed_100m_s", "t_exceed_500m_s", "recovery_s", "false_reject_rate", "missed_detect_rate", "detect_latency_s",
)


def comparison(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the columns of COMPARISON as texts; of several windows and latencies the first one counts."""
    w = F.get("windows", F.lit(0))
    moved = F.get(F.filter("windows", lambda x: x["kind"] != "gnss_outage"), F.lit(0))
    values = {c: (F.col(c), 1) for c in COMPARISON[:7]} | {c: (F.col(c), 2) for c in COMPARISON[7:9]}
    values |= {"t_exceed_100m_s": (w["exceed_100m_s"], 1), "t_exceed_500m_s": (w["exceed_500m_s"], 1), "recovery_s": (w["recovery_s"], 1)}
    values |= {"false_reject_rate": (F.col("false_rejection_rate"), 3), "missed_detect_rate": (F.col("missed_detection_rate"), 3), "detect_latency_s": (moved["latency_s"], 1)}
    return summaries.select(*keys, *(_shown(*values[c]).alias(c) for c in COMPARISON))


def comparison_lines(table: DataFrame, keys: list[str], markdown: bool = False) -> DataFrame:
    """line (1: header) and value of a comparison table, as CSV or Markdown: a report of one row a run, so its order is made in one place."""
    names = [*keys, *COMPARISON]
    join = (lambda cs: F.concat(F.lit("| "), F.concat_ws(" | ", *cs), F.lit(" |"))) if markdown else (lambda cs: F.concat_ws(",", *cs))
    head = [f"| {' | '.join(names)} |", f"|{'|'.join('---' for _ in names)}|"] if markdown else [",".join(names)]
    w = Window.orderBy(*keys)
    rows = table.select((F.row_number().over(w) + len(head)).alias("line"), join([F.col(n).cast("string") for n in names]).alias("value"))
    return table.sparkSession.createDataFrame(list(enumerate(head, 1)), "line int, value string").unionByName(rows)


def write_reports(path: str, ticks: DataFrame, verdicts: DataFrame, summaries: DataFrame, keys: list[str]) -> None:
    """Folders below a path: ticks, trust, error_vs_time (each partitioned by the keys), summaries (JSON), comparison_csv and comparison_md."""
    ticks.write.mode("overwrite").partitionBy(*keys).option("header", "true").csv(f"{path}/ticks")
    verdicts.write.mode("overwrite").partitionBy(*keys).option("header", "true").csv(f"{path}/trust")
    bins = ticks.filter("since_s IS NOT NULL AND err_m IS NOT NULL").groupBy(*keys, (F.floor(F.col("since_s") / 10) * 10.0).alias("since_degraded_s"))
    bins = bins.agg(F.percentile("err_m", 0.5).alias("p50_err_m"), F.percentile("err_m", 0.95).alias("p95_err_m"), F.count("*").alias("n"))
    bins.write.mode("overwrite").partitionBy(*keys).option("header", "true").csv(f"{path}/error_vs_time")
    summaries.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/summaries")
    for name, markdown in (("comparison_csv", False), ("comparison_md", True)):
        comparison_lines(comparison(summaries, keys), keys, markdown).orderBy("line").select("value").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
