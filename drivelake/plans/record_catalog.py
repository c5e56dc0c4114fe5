"""Queries on record tables: nesting, the canonical union, JSON lines, CSV, logger text, and predicates on records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drivelake.functions import geo
from drivelake.operators import satellites, scenario
from drivelake.plans.registry import _query, _r
from drivelake.sources import records
from drivelake.sources.fixes import FIX_SQL, fix_view
from drivelake.sources.schema import is_synthetic, source_of_provider, without_sentinels
from drivelake.sources.scratch import scratch_folder
from drivelake.sources.views import VIEWS, flat_sql, flat_view, record_tables

#: Ranks of record kinds among equal times, as the second engine gets them.
_RANKS = {"provider_event": ("provider", 2), "imu": ("imu", 3), "orientation": ("orientation", 4), "gnss_status": ("gnss_status", 5), "nmea": ("nmea", 7), "cell_scan": ("cell_scan", 8), "wifi_scan": ("wifi_scan", 9),
          "geomag": ("geomag", 10), "power": ("power", 11), "vehicle_speed": ("vehicle_speed", 12), "location": ("location", 13), "annotation": ("annotation", 14)}
_MEASUREMENTS_SQL = flat_sql(*_RANKS) + ", m AS (" + " UNION ALL ".join(f"SELECT drive_id, t_ns, {rank} AS rank, seq, '{name}' AS type FROM v_{t}" for t, (name, rank) in _RANKS.items()) + ")"



@_query(f"WITH {_MEASUREMENTS_SQL} SELECT drive_id, t_ns, type, seq, row_number() OVER (PARTITION BY drive_id ORDER BY t_ns, rank, seq) AS place FROM m")
def measurement_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records.measurements(record_tables(spark, sf_dir))
    return m.select("drive_id", "t_ns", "type", "seq", F.row_number().over(Window.partitionBy("drive_id").orderBy("t_ns", "rank", "seq")).cast("long").alias("place"))


@_query(f"""WITH {_MEASUREMENTS_SQL}, {flat_sql('obd_raw').split(FIX_SQL + ', ')[1]}, a AS (SELECT *, 2 AS head FROM m UNION ALL SELECT drive_id, t_ns, 15, seq, 'obd_raw', 2 FROM v_obd_raw
    UNION ALL SELECT CAST(drive_id AS VARCHAR), min(t_ns), 0, 0, 'session', 0 FROM fix GROUP BY drive_id)
    SELECT drive_id, type, seq, row_number() OVER (PARTITION BY drive_id ORDER BY head, t_ns, rank, seq) AS place FROM a""")
def all_record_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("drive_id").orderBy("head", "t_ns", "rank", "seq"))
    return records.all_records(record_tables(spark, sf_dir)).select("drive_id", "type", "seq", place.cast("long").alias("place"))


@_query(f"""WITH {flat_sql('gnss_status', 'gnss_sat')} SELECT p.drive_id, p.seq, count(s.svid) AS n, count(*) FILTER (s.used_in_fix) AS used, coalesce(string_agg(CAST(s.svid AS VARCHAR) || ':' || CAST(CAST(s.cn0_dbhz AS BIGINT) AS VARCHAR), ',' ORDER BY s.seq), '') AS listed,
    round(avg(CASE WHEN s.used_in_fix THEN s.cn0_dbhz END), 6) + 0 AS mean_cn0, round(CASE WHEN count(*) FILTER (s.used_in_fix) > 1 THEN stddev_samp(CASE WHEN s.used_in_fix THEN s.cn0_dbhz END) END, 6) + 0 AS std_cn0
    FROM v_gnss_status p LEFT JOIN v_gnss_sat s ON p.drive_id = s.drive_id AND p.t_ns = s.t_ns GROUP BY p.drive_id, p.seq""")
def satellite_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satellites nested by drive and time, with the number used and mean and spread of their signal."""
    status = record_tables(spark, sf_dir)["gnss_status"]
    used, mean, std = satellites.signal_stats(F.col("sats"))
    text = F.array_join(F.transform("sats", lambda s: F.concat(s["svid"].cast("string"), F.lit(":"), s["cn0_dbhz"].cast("long").cast("string"))), ",")
    return status.select("drive_id", "seq", F.size("sats").cast("long").alias("n"), used.cast("long").alias("used"), text.alias("listed"), _r(mean).alias("mean_cn0"), _r(std).alias("std_cn0"))


@_query(f"""WITH {flat_sql('gnss_status', 'gnss_sat')}, g AS (SELECT p.drive_id, p.t_ns, p.seq, count(*) FILTER (s.used_in_fix) AS used, avg(CASE WHEN s.used_in_fix THEN s.cn0_dbhz END) AS mean, coalesce(CASE WHEN count(*) FILTER (s.used_in_fix) > 1 THEN stddev_samp(CASE WHEN s.used_in_fix THEN s.cn0_dbhz END) END, 0) + 0 AS std
    FROM v_gnss_status p LEFT JOIN v_gnss_sat s ON p.drive_id = s.drive_id AND p.t_ns = s.t_ns GROUP BY ALL)
    SELECT drive_id, seq, coalesce(used >= 5 AND mean >= 20 AND max(std) OVER (PARTITION BY drive_id ORDER BY t_ns, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 1, false) AS healthy FROM g""")
def satellite_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return satellites.chip_health(record_tables(spark, sf_dir)["gnss_status"]).select("drive_id", "seq", "healthy")


@_query(f"""WITH {flat_sql('location', 'imu', 'annotation', 'geomag', 'power', 'vehicle_speed')}
    SELECT drive_id, t_ns, 'location' AS type, concat_ws('|', source, provider, round(lat, 6), round(coalesce(h_acc_m, -1), 6), round(coalesce(speed_mps, -1), 6), wall_time_ms, CAST(is_mock AS VARCHAR), coalesce(sats_used, -1)) AS v FROM v_location
    UNION ALL SELECT drive_id, t_ns, 'imu', concat_ws('|', kind, round(x, 6), round(coalesce(bx, -1), 6), round(coalesce(bz, -1), 6), accuracy) FROM v_imu
    UNION ALL SELECT drive_id, t_ns, 'annotation', concat_ws('|', label, note, '-') FROM v_annotation
    UNION ALL SELECT drive_id, t_ns, 'geomag', concat_ws('|', round(lat, 6), source) FROM v_geomag
    UNION ALL SELECT drive_id, t_ns, 'power', concat_ws('|', plug, CAST(charging AS VARCHAR), current_ua, round(coalesce(temperature_c, -1), 6)) FROM v_power
    UNION ALL SELECT drive_id, t_ns, 'vehicle_speed', concat_ws('|', round(speed_mps, 6), source) FROM v_vehicle_speed""")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines (defaults and nulls left out) and read again."""
    path = f"{scratch_folder(spark)}/drives.jsonl"
    tables = record_tables(spark, sf_dir)
    records.save(tables, path, packed=True)
    back = records.load(spark, path)
    n = lambda c: F.round(F.coalesce(F.col(c), F.lit(-1.0)), 6)
    views = {
        "location": ("source", "provider", n("lat"), n("h_acc_m"), n("speed_mps"), "wall_time_ms", F.col("is_mock").cast("string"), F.coalesce("sats_used", F.lit(-1))),
        "imu": ("kind", n("x"), n("bx"), n("bz"), "accuracy"),
        "annotation": ("label", "note", F.lit("-")),
        "geomag": (n("lat"), "source"),
        "power": ("plug", F.col("charging").cast("string"), "current_ua", n("temperature_c")),
        "vehicle_speed": (n("speed_mps"), "source"),
    }
    out = None
    for t, columns in views.items():
        rows = back[t].select("drive_id", "t_ns", F.lit(t).alias("type"), F.concat_ws("|", *columns).alias("v"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_query(f"""WITH {flat_sql('gnss_status', 'gnss_sat', 'cell_scan', 'cell')} SELECT p.drive_id, p.t_ns, 'gnss_status' AS type, coalesce(string_agg(concat_ws('|', s.svid, CAST(s.used_in_fix AS VARCHAR), CAST(s.has_ephemeris AS VARCHAR), CAST(s.has_almanac AS VARCHAR), CAST(coalesce(s.carrier_hz, -1) AS BIGINT)), ',' ORDER BY s.seq) FILTER (s.seq IS NOT NULL), '') AS v
    FROM v_gnss_status p LEFT JOIN v_gnss_sat s ON p.drive_id = s.drive_id AND p.t_ns = s.t_ns GROUP BY p.drive_id, p.t_ns, p.seq
    UNION ALL SELECT p.drive_id, p.t_ns, 'cell_scan', coalesce(string_agg(concat_ws('|', s.rat, s.area, coalesce(s.cid, -1), s.rsrp_dbm), ',' ORDER BY s.seq) FILTER (s.seq IS NOT NULL), '') FROM v_cell_scan p LEFT JOIN v_cell s ON p.drive_id = s.drive_id AND p.t_ns = s.t_ns GROUP BY p.drive_id, p.t_ns, p.seq""")
def json_lists_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists inside JSON lines, their members' defaults left out."""
    path = f"{scratch_folder(spark)}/drives.jsonl"
    tables = record_tables(spark, sf_dir)
    records.save({t: tables[t] for t in ("gnss_status", "cell_scan")}, path, packed=True)
    back = records.load(spark, path)
    sat = F.transform("sats", lambda s: F.concat_ws("|", s["svid"], s["used_in_fix"].cast("string"), s["has_ephemeris"].cast("string"), s["has_almanac"].cast("string"), F.coalesce(s["carrier_hz"], F.lit(-1.0)).cast("long")))
    cell = F.transform("cells", lambda s: F.concat_ws("|", s["rat"], s["area"], F.coalesce(s["cid"], F.lit(-1)), s["rsrp_dbm"]))
    one = back["gnss_status"].select("drive_id", "t_ns", F.lit("gnss_status").alias("type"), F.array_join(sat, ",").alias("v"))
    return one.unionByName(back["cell_scan"].select("drive_id", "t_ns", F.lit("cell_scan").alias("type"), F.array_join(cell, ",").alias("v")))


_CSV_SQL = flat_sql("gnss_sat", "annotation", "power", "wifi_ap", "obd_raw")


@_query(f"""WITH {_CSV_SQL} SELECT 'annotation' AS name, drive_id, concat_ws(',', t_ns, CASE WHEN label LIKE '%,%' THEN '"' || replace(label, '"', '""') || '"' ELSE label END, note) AS value FROM v_annotation
    UNION ALL SELECT 'power', drive_id, concat_ws(',', t_ns, plug, CASE WHEN charging THEN 1 ELSE 0 END, current_ua, voltage_mv, level_pct, coalesce(CAST(temperature_c AS VARCHAR), '')) FROM v_power
    UNION ALL SELECT 'wifi', drive_id, concat_ws(',', t_ns, bssid, rssi_dbm, freq_mhz, '', seen_ns, standard) FROM v_wifi_ap
    UNION ALL SELECT 'obd_raw', drive_id, concat_ws(',', t_ns, request, coalesce(response, ''), latency_ms) FROM v_obd_raw
    UNION ALL SELECT 'gnss_sat', drive_id, concat_ws(',', t_ns, svid, constellation, cn0_dbhz, elev_deg, az_deg, CASE WHEN used_in_fix THEN 1 ELSE 0 END, CASE WHEN carrier_hz IS NULL THEN '' ELSE '1.57542003E9' END) FROM v_gnss_sat""")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of five of the CSV exports."""
    out = None
    for name, (_, lines) in records.csv_tables(record_tables(spark, sf_dir)).items():
        if name in ("annotation", "power", "wifi", "obd_raw", "gnss_sat"):
            rows = lines.select(F.lit(name).alias("name"), "drive_id", "value")
            out = rows if out is None else out.unionByName(rows)
    return out


@_query(f"""WITH {flat_sql('gnss_status', 'gnss_sat', 'imu')}, s AS (SELECT CAST(drive_id AS VARCHAR) AS drive_id, min(t_ns) AS a FROM fix GROUP BY drive_id), n AS (SELECT drive_id, t_ns, count(*) AS n FROM v_gnss_sat GROUP BY drive_id, t_ns)
    SELECT v.drive_id, t_ns, 'imu' AS type, concat_ws(',', 'UncalMag', 1700000000000 + (t_ns - a) // 1000000, t_ns, x, y, z, coalesce(bx, 0), coalesce("by", 0), coalesce(bz, 0)) AS value FROM v_imu v JOIN s USING (drive_id) WHERE kind = 'MAG_UNCAL'
    UNION ALL SELECT v.drive_id, t_ns, 'sat', concat_ws(',', 'Status', 1700000000000 + (t_ns - a) // 1000000, n, svid - 1, constellation, svid, CASE WHEN carrier_hz IS NULL THEN '' ELSE '1.57542003E9' END, cn0_dbhz, az_deg, elev_deg, CAST(used_in_fix AS INT), CAST(has_almanac AS INT), CAST(has_ephemeris AS INT), coalesce(CAST(baseband_cn0_dbhz AS VARCHAR), ''))
    FROM v_gnss_sat v JOIN s USING (drive_id) JOIN n USING (drive_id, t_ns)""")
def logger_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of satellites and uncalibrated sensors in the logger format, with wall times of the drive's session."""
    tables = record_tables(spark, sf_dir)
    lines = records.logger_lines({t: tables[t] for t in ("session", "gnss_status", "imu")})
    return lines.select("drive_id", "t_ns", F.when(F.col("rank") == 3, "imu").otherwise("sat").alias("type"), "value")


@_query(f"WITH {flat_sql('orientation')} SELECT drive_id, seq, round(degrees(atan2(2 * (qx * qy - qw * qz), 1 - 2 * (qx * qx + qz * qz))), 6) + 0 AS azimuth, round(degrees(atan2(-2 * (qx * qz - qw * qy), 1 - 2 * (qx * qx + qy * qy))), 6) + 0 AS roll, round(degrees(asin(least(greatest(-2 * (qy * qz + qw * qx), -1), 1))), 6) + 0 AS pitch FROM v_orientation")
def orientation_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, r, p = geo.euler_deg(*(F.col(f"q{x}") for x in "wxyz"))
    return flat_view(spark, sf_dir, "orientation").select("drive_id", "seq", _r(a).alias("azimuth"), _r(r).alias("roll"), _r(p).alias("pitch"))


@_query("""SELECT event_id, CASE p WHEN 'gps' THEN 'GNSS' WHEN 'network' THEN 'NETWORK' WHEN 'fused' THEN 'FUSED' WHEN 'passive' THEN 'PASSIVE' ELSE 'OTHER' END AS source, event_id % 17 = 0 OR event_id % 5 = 1 AS synthetic,
    CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 100 AS INTEGER) END AS rssi, CASE WHEN event_id % 4 <> 0 THEN event_id END AS cid FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'gps' WHEN 1 THEN 'network' WHEN 2 THEN 'fused' WHEN 3 THEN 'passive' WHEN 4 THEN 'GPS' ELSE '' END AS p FROM events)""")
def record_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source by provider, synthetic fixes by flag or note, and unavailable values as null."""
    i = F.col("event_id")
    provider = F.element_at(F.array(*map(F.lit, ("gps", "network", "fused", "passive", "GPS", ""))), (i % 6 + 1).cast("int"))
    extras = F.when(i % 5 == 1, F.create_map(F.lit("synthetic"), F.lit("1"))).when(i % 5 == 2, F.create_map(F.lit("synthetic"), F.lit("0"))).when(i % 5 == 3, F.create_map(F.lit("k"), F.lit("1")))
    rssi = F.when(i % 3 == 0, F.lit((1 << 31) - 1)).otherwise((i % 100).cast("int"))
    cid = F.when(i % 4 == 0, F.lit((1 << 63) - 1)).otherwise(i)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", source_of_provider(provider).alias("source"), is_synthetic(i % 17 == 0, extras).alias("synthetic"), without_sentinels(rssi).alias("rssi"), without_sentinels(cid, "long").alias("cid"))


_STEPS = [scenario.Step("drop_source", 100, 200), scenario.Step("drop_sensor", 50, 100, sensor="GYRO"), scenario.Step("drop_sensor", 400, 100, orientation=True), scenario.Step("drop_vehicle_speed", 0, 300), scenario.Step("drop_source", 500, None, drop_raw=False)]


@_query(f"""WITH {flat_sql('imu', 'orientation', 'gnss_status', 'nmea', 'vehicle_speed')}, z AS (SELECT CAST(drive_id AS VARCHAR) AS drive_id, min(t_ns) AS t0 FROM fix GROUP BY drive_id),
    r AS (SELECT 'imu' AS t, drive_id, t_ns, seq, kind AS k FROM v_imu UNION ALL SELECT 'orientation', drive_id, t_ns, seq, '' FROM v_orientation UNION ALL SELECT 'gnss_status', drive_id, t_ns, seq, '' FROM v_gnss_status
        UNION ALL SELECT 'nmea', drive_id, t_ns, seq, '' FROM v_nmea UNION ALL SELECT 'vehicle_speed', drive_id, t_ns, seq, source FROM v_vehicle_speed)
    SELECT t AS type, drive_id, seq FROM r JOIN z USING (drive_id) WHERE NOT (t IN ('gnss_status', 'nmea') AND t_ns - t0 >= 100000000000 AND t_ns - t0 < 300000000000) AND NOT (t = 'imu' AND k = 'GYRO' AND t_ns - t0 >= 50000000000 AND t_ns - t0 < 150000000000)
    AND NOT (t IN ('imu', 'orientation') AND t_ns - t0 >= 400000000000 AND t_ns - t0 < 500000000000) AND NOT (t = 'vehicle_speed' AND k <> 'synthetic' AND t_ns - t0 < 300000000000)""")
def scenario_drop_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults on records other than fixes: raw satellites go with their source, sensors by kind, recorded speed but not synthetic one."""
    t0 = fix_view(spark, sf_dir).groupBy(F.col("drive_id").cast("string").alias("drive_id")).agg(F.min("t_ns").alias("t0_ns"))
    out = None
    for t in ("imu", "orientation", "gnss_status", "nmea", "vehicle_speed"):
        rows = scenario.apply_to_records(flat_view(spark, sf_dir, t), t, _STEPS, t0).select(F.lit(t).alias("type"), "drive_id", "seq")
        out = rows if out is None else out.unionByName(rows)
    return out


@_query(f"""WITH {flat_sql('location')}, e AS (SELECT drive_id, t_ns, seq, lat, lon FROM v_location WHERE source = 'PASSIVE' AND CAST(drive_id AS BIGINT) % 3 = 0), f AS (SELECT * FROM v_location WHERE source IN ('GNSS', 'FUSED') AND NOT is_mock AND (h_acc_m IS NULL OR h_acc_m <= 100))
    SELECT drive_id, t_ns, seq, round(lat, 7) + 0 AS lat, round(lon, 7) + 0 AS lon, true AS from_estimates FROM e UNION ALL SELECT drive_id, t_ns, seq, round(lat, 7), round(lon, 7), false FROM f WHERE drive_id NOT IN (SELECT drive_id FROM e)""")
def route_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passive fixes of every third drive stand for estimates; the other drives fall back to their fixes."""
    loc = flat_view(spark, sf_dir, "location")
    out = records.route(loc.filter("source = 'PASSIVE' AND CAST(drive_id AS BIGINT) % 3 = 0"), loc)
    return out.withColumns({"lat": _r("lat", 7), "lon": _r("lon", 7)})


@_query(f"WITH {_MEASUREMENTS_SQL}, c AS (SELECT drive_id, type, count(*) AS n, (max(t_ns) - min(t_ns)) / 1e9 AS s FROM m GROUP BY drive_id, type) SELECT drive_id, type, n, round(CASE WHEN s > 0 THEN n / s END, 6) + 0 AS per_s FROM c")
def record_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count of each kind of record in a drive, and its rate over the time that it covers."""
    m = records.tagged(record_tables(spark, sf_dir), [k for k in records.KINDS.values() if k.measurement])
    out = m.groupBy("drive_id", "type").agg(F.count("*").alias("n"), ((F.max("t_ns") - F.min("t_ns")) / F.lit(1e9)).alias("_s"))
    return out.select("drive_id", "type", "n", _r(F.when(F.col("_s") > 0, F.col("n") / F.col("_s"))).alias("per_s"))


_ANCHOR = 1_000_000_123


@_query(f"SELECT event_id, 1700000000000 + CAST(trunc((event_id * 1234567 - {_ANCHOR}) / 1000000) AS BIGINT) AS wall_ms, (event_id * 10 + event_id * 13 + 7) // 2 AS mid_ns, CASE WHEN event_id % 2 = 0 THEN 'A,B' ELSE 'A|B' END AS reasons FROM events")
def record_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall clock by a drive's anchor (towards zero before it), midpoints of requests and answers, reasons as text and back."""
    i = F.col("event_id")
    from drivelake.sources.bundle import reasons_of_text

    back = reasons_of_text(F.when(i % 2 == 0, F.lit("A,,B")).otherwise(F.lit(" A, B ,")))
    text = F.when(i % 2 == 0, F.array_join(back, ",")).otherwise(F.array_join(back, "|"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", records.wall_ms(i * 1234567, F.lit(_ANCHOR), F.lit(1_700_000_000_000)).alias("wall_ms"), geo.midpoint_ns(i * 10, i * 13 + 7).alias("mid_ns"), text.alias("reasons"))


assert set(_RANKS) <= set(VIEWS)
