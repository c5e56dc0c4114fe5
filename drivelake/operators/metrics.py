"""Accuracy, calibration, window and trust metrics over ticks. Percentiles are exact, linear between ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivelake.functions import geo
from drivelake.functions.geo import R68_PER_SIGMA, R95_PER_SIGMA

THRESHOLDS_M = (50, 100, 250, 500, 1000)
RECOVERED_M, RECOVERY_S = 20.0, 300.0


def share(condition: Column) -> Column:
    """The fraction of the rows with a value where it holds."""
    return F.avg(F.when(condition, 1.0).when(~condition, 0.0))


def error_stats(err: str = "err_m", r68: str = "r68") -> list[Column]:
    """n, rmse_m, p50_m, p95_m, max_m, within68, within95 of an error column."""
    e, r = F.col(err), F.col(r68)
    return [
        F.count(err).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse_m"),
        F.percentile(err, 0.5).alias("p50_m"),
        F.percentile(err, 0.95).alias("p95_m"),
        F.max(err).alias("max_m"),
        share(e <= r).alias("within68"),
        share(e <= r * R95_PER_SIGMA / R68_PER_SIGMA).alias("within95"),
    ]


def windows_of_drives(windows: DataFrame) -> DataFrame:
    """drive_id, windows: an array of each drive's windows in order of step_idx, one element for each step of a scenario."""
    w = F.struct("step_idx", "kind", "start_ns", "end_ns")
    return windows.groupBy("drive_id").agg(F.array_sort(F.collect_list(w)).alias("windows"))


def with_first_window(ticks: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds step_idx, kind and since_s of the first window (by step_idx) that holds each tick: null outside all.

    windows: drive_id, step_idx, kind, start_ns, end_ns. A drive's windows come to its ticks as one array by an equi-join, so ticks are
    neither multiplied nor sorted. Ticks with null time or drive have no window.
    """
    both = ticks.join(windows_of_drives(windows), "drive_id", "left")
    t = F.col("t_ns")
    first = F.get(F.filter("windows", lambda w: (t >= w["start_ns"]) & (t < w["end_ns"])), F.lit(0))
    both = both.withColumn("_w", first)
    return both.select(*ticks.columns, "_w.step_idx", "_w.kind", ((t - F.col("_w.start_ns")) / F.lit(1e9)).alias("since_s"))


def time_bins(ticks: DataFrame, bin_s: float = 10.0) -> DataFrame:
    """bin_s, p50_m, p95_m, n of the error by time since the degradation began."""
    rows = ticks.filter(F.col("since_s").isNotNull() & F.col("err_m").isNotNull())
    by = (F.floor(F.col("since_s") / bin_s) * bin_s).cast("double").alias("bin_s")
    return rows.groupBy(by).agg(F.percentile("err_m", 0.5).alias("p50_m"), F.percentile("err_m", 0.95).alias("p95_m"), F.count("*").alias("n"))


def window_metrics(ticks: DataFrame, windows: DataFrame, ends: DataFrame) -> DataFrame:
    """For each drive and window: max and last error inside, seconds until each threshold is exceeded, seconds to recovery.

    ticks: drive_id, t_ns, seq, err_m. windows: drive_id, step_idx, kind, start_ns, end_ns. ends: drive_id, end_ns; no recovery is told
    where the window ends less than a second before the drive. Windows without a tick inside or after them give no row.
    """
    t, inside = F.col("t_ns"), (F.col("t_ns") >= F.col("start_ns")) & (F.col("t_ns") < F.col("end_ns"))
    after = (t >= F.col("end_ns")) & (t < F.col("end_ns") + int(RECOVERY_S * 1e9))
    holds = lambda w: ((t >= w["start_ns"]) & (t < w["end_ns"])) | ((t >= w["end_ns"]) & (t < w["end_ns"] + int(RECOVERY_S * 1e9)))
    both = ticks.filter("err_m IS NOT NULL").join(windows_of_drives(windows), "drive_id")
    both = both.select("drive_id", "t_ns", "seq", "err_m", F.explode(F.filter("windows", holds)).alias("_w")).select("drive_id", "t_ns", "seq", "err_m", "_w.*")
    exceed = [(F.min(F.when(inside & (F.col("err_m") > x), t - F.col("start_ns"))) / F.lit(1e9)).alias(f"exceed_{x}m_s") for x in THRESHOLDS_M]
    out = both.groupBy("drive_id", "step_idx", "kind", "start_ns", "end_ns").agg(
        F.max(F.when(inside, F.col("err_m"))).alias("max_err_m"),
        F.max_by("err_m", F.when(inside, F.struct("t_ns", "seq"))).alias("err_at_end_m"),
        *exceed,
        F.min(F.when(after & (F.col("err_m") < RECOVERED_M), t)).alias("_back"),
    )
    out = out.join(ends.select("drive_id", F.col("end_ns").alias("_end")), "drive_id")
    recovery = F.when(F.col("end_ns") < F.col("_end") - 1_000_000_000, (F.col("_back") - F.col("end_ns")) / F.lit(1e9))
    return out.withColumn("recovery_s", recovery).drop("_back", "_end", "start_ns", "end_ns")


def trust_confusion() -> list[Column]:
    """Aggregates over state, offset_m and has_truth of GNSS verdicts: clean is an offset under 1 m with truth, perturbed 50 m or more."""
    clean, bad = (F.col("offset_m") < 1) & F.col("has_truth"), F.col("offset_m") >= 50
    trusted = F.col("state") == "TRUSTED"
    n_clean, rejected, n_bad, missed = (F.count_if(c) for c in (clean, clean & ~trusted, bad, bad & trusted))
    return [
        n_clean.alias("clean_fixes"),
        rejected.alias("false_rejections"),
        F.when(n_clean > 0, rejected.cast("double") / n_clean).alias("false_rejection_rate"),
        n_bad.alias("perturbed_fixes"),
        missed.alias("missed_detections"),
        F.when(n_bad > 0, missed.cast("double") / n_bad).alias("missed_detection_rate"),
    ]


def circular_mean_deg(angle: str, weight: Column | None = None) -> Column:
    """Weighted mean direction in [0, 360)."""
    w = F.lit(1.0) if weight is None else weight
    return F.pmod(F.degrees(F.atan2(F.sum(w * F.sin(F.radians(angle))), F.sum(w * F.cos(F.radians(angle))))) + 360, F.lit(360.0))


def circular_residual(rows: DataFrame, keys: list[str], angle: str, weight: Column) -> DataFrame:
    """keys and rms_deg: root of the mean square by which angles (degrees) differ from their weighted circular mean. Rows without an angle don't count; groups without any have null."""
    mean = rows.groupBy(*keys).agg(circular_mean_deg(angle, weight).alias("_mean"))
    off = geo.wrap_deg(F.col(angle) - F.col("_mean"))
    return rows.join(mean, keys).groupBy(*keys).agg(F.sqrt(F.avg(off * off)).alias("rms_deg"))
