"""Queries on trips: summaries, thinned and simplified routes, texts, matched roads, sets of reasons, live values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivelake.operators import roads, tracks, trips
from drivelake.plans.registry import _hav, _query, _r, _wrap
from drivelake.plans.road_catalog import _PROJECT_SQL, _projected, _ways
from drivelake.sources import records
from drivelake.sources.fixes import FIX_SQL, fix_view
from drivelake.sources.views import flat_sql, flat_view, record_tables
from drivelake.streaming import live

_ROUTE_SQL = f"""{flat_sql('location')}, e AS (SELECT drive_id, t_ns, seq, lat, lon, true AS ours FROM v_location WHERE source = 'PASSIVE' AND CAST(drive_id AS BIGINT) % 3 = 0), f AS (SELECT drive_id, t_ns, seq, lat, lon, false AS ours FROM v_location WHERE source IN ('GNSS', 'FUSED') AND NOT is_mock AND (h_acc_m IS NULL OR h_acc_m <= 100) AND drive_id NOT IN (SELECT drive_id FROM e)),
    r AS (SELECT * FROM e UNION ALL SELECT * FROM f)"""


def _route(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = flat_view(spark, sf_dir, "location")
    return records.route(loc.filter("source = 'PASSIVE' AND CAST(drive_id AS BIGINT) % 3 = 0"), loc)


@_query(f"""WITH {_ROUTE_SQL}, s AS (SELECT *, {_hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d FROM r WINDOW w AS (PARTITION BY drive_id ORDER BY t_ns, seq)), g AS (SELECT drive_id, count(*) AS points, bool_or(ours) AS from_estimates, coalesce(sum(d), 0) AS len, (max(t_ns) - min(t_ns)) / 1e9 AS s FROM s GROUP BY drive_id)
    SELECT drive_id, points, from_estimates, round(len, 3) + 0 AS length_m, round(s, 6) + 0 AS duration_s, CASE WHEN s * 9 < 60 THEN '< 1 min' WHEN floor((floor(s * 9) + 30) / 60) < 60 THEN CAST(CAST(floor((floor(s * 9) + 30) / 60) AS BIGINT) AS VARCHAR) || ' min'
    ELSE CAST(CAST(floor((floor(s * 9) + 30) / 3600) AS BIGINT) AS VARCHAR) || ' h ' || lpad(CAST(CAST(floor((floor(s * 9) + 30) / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ' min' END AS text FROM g""")
def trip_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and duration of each drive's route; the text is that of nine times the duration."""
    s = trips.summaries(_route(spark, sf_dir))
    return s.select("drive_id", "points", "from_estimates", _r("length_m", 3).alias("length_m"), _r("duration_s").alias("duration_s"), trips.duration_text(F.col("duration_s") * 9).alias("text"))


@_query()
def simplified_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of twenty points at most; a test holds simplification against a plain recursion."""
    return trips.simplified(_route(spark, sf_dir), 20)


@_query(f"""WITH RECURSIVE {_ROUTE_SQL}, o AS (SELECT drive_id, seq, lat, lon, row_number() OVER (PARTITION BY drive_id ORDER BY t_ns, seq) AS i FROM r), k AS (SELECT drive_id, seq, i, lat, lon, true AS keep FROM o WHERE i = 1
    UNION ALL SELECT o.drive_id, CASE WHEN {_hav('k.lat', 'k.lon', 'o.lat', 'o.lon')} >= 400 THEN o.seq ELSE k.seq END, o.i, CASE WHEN {_hav('k.lat', 'k.lon', 'o.lat', 'o.lon')} >= 400 THEN o.lat ELSE k.lat END, CASE WHEN {_hav('k.lat', 'k.lon', 'o.lat', 'o.lon')} >= 400 THEN o.lon ELSE k.lon END, {_hav('k.lat', 'k.lon', 'o.lat', 'o.lon')} >= 400 FROM k JOIN o ON o.drive_id = k.drive_id AND o.i = k.i + 1)
    SELECT drive_id, seq FROM k WHERE keep""")
def thinned_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points 400 m or more from the last one kept."""
    return trips.thinned(_route(spark, sf_dir), 400.0).select("drive_id", "seq")


@_query(f"""WITH {flat_sql('cell')} SELECT drive_id, seq, rat || ' ' || mcc || '-' || mnc || ' area ' || area || CASE WHEN cid IS NOT NULL THEN ' cid ' || cid ELSE '' END || ' ' || CASE WHEN seq % 2 = 0 THEN rsrp_dbm ELSE rssi_dbm END || ' dBm' AS text FROM v_cell""")
def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second cell lacks its reference power, so the plain one is shown."""
    c = flat_view(spark, sf_dir, "cell").withColumn("rsrp_dbm", F.when(F.col("seq") % 2 == 0, F.col("rsrp_dbm")))
    names = ("rat", "mcc", "mnc", "area", "cid", "rsrp_dbm", "rssi_dbm", "timing_advance")
    return c.select("drive_id", "seq", trips.cell_text(F.struct(*names)).alias("text"))


@_query(f"""WITH {_PROJECT_SQL}, rk AS (SELECT seq, way_id, piece, deg, row_number() OVER (PARTITION BY seq ORDER BY round(d, 6), way_id, piece) AS place FROM pj), st AS (SELECT * FROM rk WHERE place = 3), nr AS (SELECT seq, way_id, piece, deg FROM pj WHERE d <= 10),
    ex AS (SELECT way_id, piece, b AS node FROM seg UNION ALL SELECT way_id, piece, a FROM seg WHERE NOT oneway), en AS (SELECT way_id, piece, a AS node FROM seg UNION ALL SELECT way_id, piece, b FROM seg WHERE NOT oneway),
    lk AS (SELECT DISTINCT ex.way_id AS w1, ex.piece AS p1, en.way_id AS w2, en.piece AS p2 FROM ex JOIN en USING (node) WHERE ex.way_id <> en.way_id OR ex.piece <> en.piece), bk AS (SELECT w1, p1, w2, p2 FROM lk UNION SELECT w2, p2, w1, p1 FROM lk)
    SELECT st.seq, bool_or(coalesce(nr.way_id = st.way_id OR (bk.w1 IS NOT NULL AND abs({_wrap('nr.deg - st.deg')}) % 180 < 30), false)) AS "right" FROM st LEFT JOIN nr ON nr.seq = st.seq LEFT JOIN bk ON bk.w1 = st.way_id AND bk.p1 = st.piece AND bk.w2 = nr.way_id AND bk.p2 = nr.piece GROUP BY st.seq""")
def matched_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third nearest segment of each fix stands for its match, the fix itself for the truth."""
    p = _projected(spark, sf_dir)
    third = roads.nearest(p.withColumn("distance_m", F.round("distance_m", 6)), ["seq"], 3).filter("place = 3")
    names = (F.col("seq").alias("id"), "way_id", "piece", "bearing_deg")
    out = roads.matched_right(third.select(*names), p.filter("distance_m <= 10").select(*names), roads.successors(roads.segments(_ways(spark, sf_dir))))
    return out.select(F.col("id").alias("seq"), "right")


_SOME = ["STALE", "POOR_ACCURACY", "INNOVATION_GATE", "CN0_UNIFORM", "RECOVERING"]


@_query(f"""WITH x AS (SELECT event_id, list_filter({_SOME!r}, lambda r: (event_id // (len(r) - 3)) % 3 = 0) AS rs FROM events) SELECT event_id, array_to_string(list_sort(rs), ',') AS reasons, len(list_filter(rs, lambda r: r NOT IN ('INNOVATION_GATE', 'CN0_UNIFORM', 'RECOVERING'))) = 0 AS resettable,
    len(list_filter(rs, lambda r: r IN ('STALE', 'POOR_ACCURACY'))) > 0 AS stale_or_poor, array_to_string(list_sort(list_filter(rs, lambda r: r <> 'INNOVATION_GATE')), ',') AS without_gate, len(rs) = 1 AND list_contains(rs, 'INNOVATION_GATE') AS gate_only FROM x""")
def reason_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership, difference and equality of sets of reasons."""
    i = F.col("event_id")
    rs = F.filter(F.array(*map(F.lit, _SOME)), lambda r: F.floor(i / (F.length(r) - 3)) % 3 == 0)
    resettable, gate = F.array(*map(F.lit, _SOME[2:])), F.array(F.lit("INNOVATION_GATE"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", rs.alias("rs"))
    return e.select(
        "event_id", F.array_join(F.array_sort("rs"), ",").alias("reasons"), F.forall("rs", lambda r: F.array_contains(resettable, r)).alias("resettable"), F.arrays_overlap("rs", F.array(F.lit("STALE"), F.lit("POOR_ACCURACY"))).alias("stale_or_poor"),
        F.array_join(F.array_sort(F.array_except("rs", gate)), ",").alias("without_gate"), (F.col("rs") == gate).alias("gate_only"),
    )


@_query(f"""WITH {FIX_SQL}, v AS (SELECT *, h_acc_m <= 30 AND NOT is_mock AS ok FROM fix), l AS (SELECT drive_id, source, seq, last(CASE WHEN ok THEN seq END IGNORE NULLS) OVER (PARTITION BY drive_id, source ORDER BY t_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_trusted FROM v) SELECT drive_id, source, seq, last_trusted FROM l""")
def last_trusted_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each fix the last trusted one of its source, by stored states."""
    f = fix_view(spark, sf_dir).withColumn("key", F.concat_ws("|", "drive_id", "source"))
    keyed = f.select(F.col("key").alias("drive_id"), "t_ns", "seq", F.col("drive_id").alias("drive"), "source")
    trusted = f.filter("h_acc_m <= 30 AND NOT is_mock").select(F.col("key").alias("drive_id"), "t_ns", F.col("seq"))
    out = tracks.before(keyed, trusted, {"last_trusted": F.col("seq")})
    return out.select(F.col("drive").alias("drive_id"), "source", "seq", "last_trusted")


@_query(f"""WITH {flat_sql('location')} SELECT drive_id, source, max(t_ns) AS t_ns, arg_max(round(lat, 7) + 0, t_ns) AS lat FROM (SELECT * FROM v_location QUALIFY row_number() OVER (PARTITION BY drive_id, source, t_ns ORDER BY seq) = 1) GROUP BY drive_id, source""")
def live_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last place of each source."""
    out = live.latest(flat_view(spark, sf_dir, "location"), ["lat"])
    return out.select("drive_id", "source", "t_ns", _r("lat", 7).alias("lat"))


@_query(f"WITH {flat_sql('power', 'nmea', 'annotation')}, m AS (SELECT drive_id, t_ns, 'power' AS type FROM v_power UNION ALL SELECT drive_id, t_ns, 'nmea' FROM v_nmea UNION ALL SELECT drive_id, t_ns, 'annotation' FROM v_annotation) SELECT drive_id, type, count(*) AS n, round(CASE WHEN max(t_ns) > min(t_ns) THEN count(*) / ((max(t_ns) - min(t_ns)) / 1e9) END, 6) + 0 AS per_s FROM m GROUP BY drive_id, type")
def live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = record_tables(spark, sf_dir)
    rows = records.tagged({t: tables[t] for t in ("power", "nmea", "annotation")}, list(records.KINDS.values()))
    return live.live_counts(rows).select("drive_id", "type", "n", _r("per_s").alias("per_s"))
