"""Record tables of drives as views of the generic events table, for queries and tests: flat, as a bundle stores them.

Each view is a filter on i = event_id and a list of columns, in the part of SQL that Spark and the second engine share, so one text makes
the input of both. base is the fix view (drive_id, seq = i, t_ns, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivelake.operators.tables import nest_by_time
from drivelake.sources.fixes import FIX_SQL, fix_view
from drivelake.sources.schema import KINDS, split_columns

_MAX = "2147483647"
#: table -> (filter, number of rows for each event as an expression or None, columns). j counts from 1 where there are several.
VIEWS: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "provider_event": ("i % 11 = 5", None, {"provider": "CASE i % 3 WHEN 0 THEN 'gps' WHEN 1 THEN 'network' ELSE 'fused' END", "event": "CASE i % 4 WHEN 0 THEN 'OVERRIDDEN' WHEN 1 THEN 'RESTORED' WHEN 2 THEN 'ENABLED' ELSE 'DISABLED' END"}),
    "imu": ("i % 2 = 0", None, {
        "kind": "CASE i % 6 WHEN 0 THEN 'ACCEL' WHEN 2 THEN 'GYRO' ELSE 'MAG_UNCAL' END", "x": "(i * 17 % 401) / 20.0::DOUBLE - 10", "y": "(i * 29 % 401) / 20.0::DOUBLE - 10", "z": "(i * 43 % 401) / 20.0::DOUBLE - 10",
        "bx": "CASE WHEN i % 6 = 4 THEN (i % 7) / 10.0::DOUBLE END", "by": "CASE WHEN i % 6 = 4 THEN (i % 5) / 10.0::DOUBLE END", "bz": "CASE WHEN i % 12 = 4 THEN (i % 3) / 10.0::DOUBLE END", "accuracy": "CAST(i % 4 AS INT)"}),
    "phone_imu": ("true", "16", {
        "kind": "CASE WHEN j % 2 = 1 THEN 'ACCEL' ELSE 'GYRO' END", "x": "CASE WHEN j % 2 = 1 THEN (i * 17 + j * 5) % 21 / 100.0::DOUBLE - 0.1::DOUBLE ELSE ((i * 7 + j) % 11 - 5) / 1000.0::DOUBLE END",
        "y": "CASE WHEN j % 2 = 1 THEN (i * 29 + j * 3) % 21 / 100.0::DOUBLE - 0.1::DOUBLE ELSE ((i * 5 + j) % 11 - 5) / 1000.0::DOUBLE END",
        "z": "CASE WHEN j % 2 = 1 THEN 9.75::DOUBLE + (i * 13 + j * 7) % 13 / 100.0::DOUBLE ELSE (i * 11 % 41 - 20) / 100.0::DOUBLE END"}),
    "orientation": ("i % 5 = 0", None, {
        "kind": "CASE i % 3 WHEN 0 THEN 'ROTATION_VECTOR' ELSE 'GAME_ROTATION_VECTOR' END", "qw": "cos(i % 628 / 100.0::DOUBLE)", "qx": "sin(i % 628 / 100.0::DOUBLE) * 0.6::DOUBLE", "qy": "sin(i % 628 / 100.0::DOUBLE) * 0.48::DOUBLE",
        "qz": "sin(i % 628 / 100.0::DOUBLE) * 0.64::DOUBLE", "heading_acc_rad": "CASE WHEN i % 10 = 0 THEN 0.2::DOUBLE END"}),
    "gnss_status": ("i % 4 = 1", None, {}),
    "gnss_sat": ("i % 4 = 1", "i % 9", {
        "svid": "CAST(j AS INT)", "constellation": "CAST(j % 5 + 1 AS INT)", "cn0_dbhz": "20.0::DOUBLE + i * j * 7 % 23", "elev_deg": "j * 7.0::DOUBLE", "az_deg": "(i * j % 360) * 1.0::DOUBLE", "used_in_fix": "(i + j) % 3 <> 0",
        "has_ephemeris": "j % 2 = 0", "has_almanac": "j % 3 = 0", "carrier_hz": "CASE WHEN j % 3 <> 0 THEN 1575420030.0::DOUBLE END", "baseband_cn0_dbhz": "CASE WHEN j % 4 = 0 THEN 18.5::DOUBLE END"}),
    "nmea": ("i % 9 = 4", None, {"text": "concat('$GPGGA,', CAST(i AS STRING))"}),
    "cell_scan": ("i % 13 = 1", None, {}),
    "cell": ("i % 13 = 1", "i % 4", {
        "rat": "'LTE'", "registered": "j = 1", "mcc": "255", "mnc": "CAST(j AS INT)", "area": "i + 7000000000", "cid": "CASE WHEN j = 2 THEN i END", "pci": f"CASE WHEN j = 3 THEN {_MAX} ELSE CAST(i % 504 AS INT) END", "arfcn": "CAST(NULL AS INT)",
        "bandwidth_khz": "CAST(NULL AS INT)", "rssi_dbm": f"CASE WHEN i % 3 = 0 THEN {_MAX} ELSE -70 END", "rsrp_dbm": "CAST(-80 - j AS INT)", "rsrq_db": "-9", "sinr_db": f"{_MAX}", "timing_advance": "CAST(NULL AS INT)", "asu_level": "30",
        "measured_ns": "t_ns - 5", "connection_status": "1"}),
    "wifi_scan": ("i % 13 = 2", None, {}),
    "wifi_ap": ("i % 13 = 2", "i % 3", {"bssid": "concat('02:00:00:00:00:0', CAST(j AS STRING))", "rssi_dbm": "CAST(-40 - j AS INT)", "freq_mhz": "2412", "channel_width": "CAST(NULL AS INT)", "seen_ns": "t_ns - j", "standard": "4"}),
    "geomag": ("i % 60 = 11", None, {"lat": "lat", "lon": "lon", "declination_deg": "7.5::DOUBLE", "inclination_deg": "66.0::DOUBLE", "field_ut": "50.1::DOUBLE", "source": "CASE WHEN i % 120 = 11 THEN 'WMM' ELSE 'FILE' END"}),
    "power": ("i % 10 = 7", None, {"plug": "CASE i % 3 WHEN 0 THEN 'USB' WHEN 1 THEN 'WIRELESS' ELSE 'NONE' END", "charging": "i % 3 < 2", "current_ua": "i * 1000 - 5000000", "voltage_mv": "CAST(3800 + i % 300 AS INT)", "level_pct": "CAST(i % 101 AS INT)", "temperature_c": "CASE WHEN i % 20 = 7 THEN 31.5::DOUBLE END"}),
    "vehicle_speed": ("i % 7 = 3", None, {"speed_mps": "(i * 31 % 200) / 10.0::DOUBLE + (i % 5) / 2.0::DOUBLE", "std_mps": "0.3::DOUBLE", "source": "CASE WHEN i % 14 = 3 THEN 'obd' ELSE 'synthetic' END"}),
    "location": ("true", None, {
        "recv_ns": "t_ns + 100000000", "source": "source", "provider": "CASE source WHEN 'GNSS' THEN 'gps' ELSE lower(source) END", "lat": "lat", "lon": "lon", "alt_m": "CAST(NULL AS DOUBLE)", "h_acc_m": "CASE WHEN i % 19 <> 0 THEN h_acc_m END",
        "v_acc_m": "CAST(NULL AS DOUBLE)", "speed_mps": "CASE WHEN i % 23 <> 0 THEN speed_mps END", "speed_acc_mps": "CAST(NULL AS DOUBLE)", "bearing_deg": "bearing_deg", "bearing_acc_deg": "CAST(NULL AS DOUBLE)",
        "wall_time_ms": "CASE WHEN i % 2 = 0 THEN 0 ELSE i END", "is_mock": "is_mock", "sats_used": "CASE WHEN i % 3 = 0 THEN CAST(i % 12 AS INT) END"}),
    "annotation": ("i % 50 = 9", None, {"label": "CASE i % 100 WHEN 9 THEN 'tunnel, \"north\"' ELSE 'stop' END", "note": "CASE i % 3 WHEN 0 THEN '' ELSE 'n' END"}),
    "obd_raw": ("i % 7 = 3", None, {"request": "'010D'", "response": "CASE WHEN i % 14 = 3 THEN '41 0D 2A' END", "latency_ms": "CAST(i % 200 AS INT)"}),
}


def flat_view(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """drive_id (text), seq, t_ns and the columns of a view; of list members seq is 1000 i + j."""
    where, several, columns = VIEWS[table]
    b = fix_view(spark, sf_dir).selectExpr("*", "seq AS i").filter(where)
    if several:
        b = b.selectExpr("*", f"explode(CASE WHEN {several} > 0 THEN sequence(1, int({several})) ELSE array() END) AS j")
    seq = "i * 1000 + j" if several else "i"
    return b.selectExpr("CAST(drive_id AS STRING) AS drive_id", f"{seq} AS seq", "t_ns", *(f"{e} AS {n}" for n, e in columns.items()))


def flat_sql(*tables: str) -> str:
    """The same views as CTEs for the second engine, after the one of fixes; named as the tables, with v_ in front."""
    out = [FIX_SQL]
    for t in tables:
        where, several, columns = VIEWS[t]
        source = f"(SELECT *, seq AS i{f', unnest(range(1, CAST({several} AS BIGINT) + 1)) AS j' if several else ''} FROM fix WHERE {where.replace('i %', 'seq %')}{f' AND ({several}) > 0'.replace('i %', 'seq %') if several else ''})"
        if several:
            source = source.replace(f"CAST({several}", f"CAST({several.replace('i %', 'seq %')}")
        cols = "".join(f", {e} AS {n}" for n, e in columns.items())
        out.append(f"v_{t} AS (SELECT CAST(drive_id AS VARCHAR) AS drive_id, {'i * 1000 + j' if several else 'i'} AS seq, t_ns{cols} FROM {source})")
    return ", ".join(out)


#: Samples of a phone's sensors: eight of each kind from each row on, 20 ms apart.
PHONE_TIME = "t_ns + (seq % 1000 - 1) {div} 2 * 20000000 + (seq + 1) % 2 * 1000"


def phone_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drive_id (a number), seq, t_ns, kind, x, y, z."""
    return flat_view(spark, sf_dir, "phone_imu").selectExpr("CAST(drive_id AS BIGINT) AS drive_id", "seq", f"{PHONE_TIME.format(div='div')} AS t_ns", "kind", "x", "y", "z")


def phone_sql() -> str:
    return flat_sql("phone_imu") + f", phone AS (SELECT CAST(drive_id AS BIGINT) AS drive_id, seq, {PHONE_TIME.format(div='//')} AS t_ns, kind, x, y, z FROM v_phone_imu)"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session for each drive, begun at its first row."""
    s = fix_view(spark, sf_dir).groupBy("drive_id").agg(F.min("t_ns").alias("t_ns"))
    texts = {"device": "d", "manufacturer": "", "model": "m", "app_version": "1", "mode": "", "notes": "", "config_json": ""}
    return s.select(F.col("drive_id").cast("string").alias("drive_id"), F.lit(0).cast("long").alias("seq"), "t_ns", F.concat(F.lit("s"), F.col("drive_id")).alias("session_id"), F.col("t_ns").alias("anchor_elapsed_ns"), F.lit(1_700_000_000_000).alias("anchor_wall_ms"),
                    *(F.lit(texts[n]).alias(n) if n in texts else F.lit(34).alias(n) for n in KINDS["session"].names[3:]))


def record_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A set of record tables: lists nested, extras parsed."""
    out = {t: flat_view(spark, sf_dir, t) for t in VIEWS if t in KINDS and not KINDS[t].children}
    for t in ("gnss_status", "cell_scan", "wifi_scan"):
        column, (child, fields, _) = next(iter(KINDS[t].children.items()))
        out[t] = nest_by_time(flat_view(spark, sf_dir, t), flat_view(spark, sf_dir, child), [c.split(" ")[0] for c in fields.split(", ")], column)
    extras = fix_view(spark, sf_dir).select("seq", F.from_json("extras", "map<string,string>").alias("extras"))
    out["location"] = out["location"].join(extras, "seq").select("drive_id", *[c for c in out["location"].columns if c != "drive_id"], "extras")
    out["session"] = sessions(spark, sf_dir)
    return {t: df.select("drive_id", "seq", "t_ns", *(F.col(c.split(" ", 1)[0]).cast(c.split(" ", 1)[1]) for c in split_columns(KINDS[t].columns))) for t, df in out.items()}
