"""A table of location fixes from the generic events table: one drive for each user, one hour of events a second of drive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kind of source by event type; anything else is PASSIVE.
SOURCE_OF = {"view": "GNSS", "click": "GNSS", "purchase": "NETWORK", "signup": "FUSED"}


def fix_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drive_id, seq, t_ns, source, lat, lon, h_acc_m, speed_mps, bearing_deg, is_mock, extras (a JSON text)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.min(us).over(Window.partitionBy("user_id"))
    source = F.lit("PASSIVE")
    for kind, name in SOURCE_OF.items():
        source = F.when(F.col("event_type") == kind, name).otherwise(source)
    i = F.col("event_id")
    return events.select(
        F.col("user_id").alias("drive_id"),
        i.alias("seq"),
        F.floor((us - first) * F.lit(1000.0) / F.lit(3600.0)).cast("long").alias("t_ns"),
        source.alias("source"),
        (F.lit(50.45) + (i * 7919 % 1009) / F.lit(1e5)).alias("lat"),
        (F.lit(30.52) + (i * 104729 % 1013) / F.lit(1e5)).alias("lon"),
        F.col("value").alias("h_acc_m"),
        ((i * 31 % 200) / F.lit(10.0)).alias("speed_mps"),
        ((i * 37 % 3600) / F.lit(10.0)).alias("bearing_deg"),
        (i % 17 == 0).alias("is_mock"),
        F.col("props").alias("extras"),
    )


FIX_SQL = """fix AS (SELECT user_id AS drive_id, event_id AS seq,
    CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) * 1000.0::DOUBLE / 3600.0::DOUBLE) AS BIGINT) AS t_ns,
    CASE event_type WHEN 'view' THEN 'GNSS' WHEN 'click' THEN 'GNSS' WHEN 'purchase' THEN 'NETWORK' WHEN 'signup' THEN 'FUSED' ELSE 'PASSIVE' END AS source,
    50.45::DOUBLE + (event_id * 7919 % 1009) / 1e5 AS lat, 30.52::DOUBLE + (event_id * 104729 % 1013) / 1e5 AS lon,
    value AS h_acc_m, (event_id * 31 % 200) / 10.0::DOUBLE AS speed_mps, (event_id * 37 % 3600) / 10.0::DOUBLE AS bearing_deg,
    event_id % 17 = 0 AS is_mock, props AS extras FROM events)"""
