"""Live status of recording drives as streaming aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_counts(records: DataFrame) -> DataFrame:
    """drive_id, type, n, first_ns, last_ns and per_s of a stream (or table) of records (drive_id, type, t_ns): counts of each kind so far, for a sink in update or complete mode.

    State is one row a drive and kind. Records without a time count, but move neither end.
    """
    out = records.groupBy("drive_id", "type").agg(F.count("*").alias("n"), F.min("t_ns").alias("first_ns"), F.max("t_ns").alias("last_ns"))
    seconds = (F.col("last_ns") - F.col("first_ns")) / F.lit(1e9)
    return out.withColumn("per_s", F.when(seconds > 0, F.col("n") / seconds))


def latest(records: DataFrame, values: list[str]) -> DataFrame:
    """The last values of each source: drive_id, source and the values of its latest row by time."""
    return records.groupBy("drive_id", "source").agg(F.max_by(F.struct("t_ns", *values), F.col("t_ns")).alias("_v")).select("drive_id", "source", "_v.*")
