"""Satellite signals: statistics of a status' satellites and the health of the receiver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivelake.operators.tracks import by_drive

#: A healthy receiver uses so many satellites of such a mean signal, whose spread reaches this among the last statuses.
MIN_USED, MIN_MEAN_DB, MIN_STD_DB, STATUSES = 5, 20.0, 1.0, 5


def signal_stats(sats: Column) -> tuple[Column, Column, Column]:
    """Number of satellites in use, mean of their signal (null without any), and its sample deviation (null below two)."""
    used = F.transform(F.filter(sats, lambda s: s["used_in_fix"]), lambda s: s["cn0_dbhz"])
    n = F.size(used)
    total = F.aggregate(used, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(n > 0, total / n)
    squares = F.aggregate(used, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return n, mean, F.when(n > 1, F.sqrt(squares / (n - 1)))


def chip_health(status: DataFrame) -> DataFrame:
    """Adds used, mean_db, std_db and healthy to satellite statuses (drive_id, t_ns, seq, sats): an unknown spread counts as 0. Empty lists are unhealthy."""
    used, mean, std = signal_stats(F.col("sats"))
    out = status.withColumns({"used": used, "mean_db": mean, "std_db": std})
    spread = F.max(F.coalesce("std_db", F.lit(0.0))).over(by_drive().rowsBetween(1 - STATUSES, 0))
    return out.withColumn("healthy", F.coalesce((F.col("used") >= MIN_USED) & (F.col("mean_db") >= MIN_MEAN_DB) & (spread >= MIN_STD_DB), F.lit(False)))
