"""Queries on roads: a network of ways made from orders, its segments, tiles, projections and edits; import of map elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drivelake.functions import geo
from drivelake.operators import roads
from drivelake.plans.registry import _hav, _query, _r, _wrap
from drivelake.sources import tiles
from drivelake.sources.fixes import FIX_SQL, fix_view
from drivelake.sources.scratch import scratch_folder, stored
from drivelake.streaming import offline_match, road_matcher

#: The plane that the queries measure in.
LAT0, LON0 = 50.455, 30.525
_NODE = "CASE WHEN j % 2 = 0 THEN w + {d} ELSE 1000000000 + w * 10 + j END"
_BASE = "(CASE WHEN j % 2 = 0 THEN w + {d} ELSE w + {e} END)"
_CLASS = "CASE w % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'service' WHEN 3 THEN 'motorway' ELSE 'tertiary' END"
#: Nodes of the way of order w, j from 0 to 2 + w % 3: even ones are shared with the next ways and lie on a grid, odd ones are its own.
_NODES_SQL = f"""rw AS (SELECT DISTINCT o_orderkey AS w FROM orders), nd AS (SELECT w AS way_id, j AS pos, {_NODE.format(d='j // 2')} AS node, 50.45::DOUBLE + ({_BASE.format(d='j // 2', e='(j - 1) // 2')} // 32) * 0.0003::DOUBLE + CASE WHEN j % 2 = 1 THEN 0.000113::DOUBLE ELSE 0 END AS lat,
    30.52::DOUBLE + ({_BASE.format(d='j // 2', e='(j - 1) // 2')} % 32) * 0.0003::DOUBLE + CASE WHEN j % 2 = 1 THEN 0.000171::DOUBLE ELSE 0 END AS lon FROM (SELECT w, unnest(range(0, 3 + w % 3)) AS j FROM rw))"""


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("w")).distinct()
    base = _BASE.format(d="j DIV 2", e="(j - 1) DIV 2")
    row = f"""struct({_NODE.format(d='j DIV 2')} AS node, 50.45D + ({base} DIV 32) * 0.0003D + CASE WHEN j % 2 = 1 THEN 0.000113D ELSE 0 END AS lat, 30.52D + ({base} % 32) * 0.0003D + CASE WHEN j % 2 = 1 THEN 0.000171D ELSE 0 END AS lon)"""
    p = o.selectExpr("w", f"transform(sequence(0L, 2 + w % 3), j -> {row}) AS p")
    return p.selectExpr("w AS way_id", "p.node AS node_ids", "p.lat AS lats", "p.lon AS lons", f"{_CLASS} AS road_class", "w % 4 = 0 AS oneway", "CAST(w % 3 AS INT) AS lanes", "CAST(w % 2 AS INT) AS layer", "concat('r', w % 10) AS name")


_SEG_SQL = f"""{_NODES_SQL}, nu AS (SELECT node, count(*) AS u FROM nd GROUP BY node), nc AS (SELECT nd.*, CASE WHEN u > 1 AND pos > 0 AND pos < max(pos) OVER (PARTITION BY way_id) THEN 1 ELSE 0 END AS cut FROM nd JOIN nu USING (node)),
    nb AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0 AS before FROM nc), ne AS (SELECT way_id, pos, node, lat, lon, CAST(before AS BIGINT) AS piece FROM nb UNION ALL SELECT way_id, pos, node, lat, lon, CAST(before + 1 AS BIGINT) FROM nb WHERE cut = 1),
    nl AS (SELECT *, {_hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d FROM ne WINDOW w AS (PARTITION BY way_id, piece ORDER BY pos)),
    seg AS (SELECT way_id, piece, arg_min(node, pos) AS a, arg_max(node, pos) AS b, count(*) AS n, sum(d) AS len, way_id % 4 = 0 AS oneway FROM nl GROUP BY way_id, piece)"""
_E, _N = "(6378137.0::DOUBLE / sqrt(1 - 6.69437999014e-3 * pow(sin(radians({0})), 2)) * cos(radians({0})))", "(6378137.0::DOUBLE / sqrt(1 - 6.69437999014e-3 * pow(sin(radians({0})), 2)) * (1 - 6.69437999014e-3) / (1 - 6.69437999014e-3 * pow(sin(radians({0})), 2)))"
_X, _Y = (lambda lon: f"(radians({_wrap(f'{lon} - {LON0}')}) * {_E.format(LAT0)})"), (lambda lat: f"(radians({lat} - {LAT0}) * {_N.format(LAT0)})")
_EDGE_SQL = f"""{_SEG_SQL}, xy AS (SELECT way_id, piece, pos, {_X('lon')} AS x0, {_Y('lat')} AS y0 FROM ne), ev AS (SELECT *, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1, row_number() OVER w - 1 AS k FROM xy WINDOW w AS (PARTITION BY way_id, piece ORDER BY pos)),
    el AS (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS len, (degrees(atan2(x1 - x0, y1 - y0)) + 360) - 360 * floor((degrees(atan2(x1 - x0, y1 - y0)) + 360) / 360) AS deg FROM ev WHERE x1 IS NOT NULL),
    ed AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY way_id, piece ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0 AS along FROM el)"""


@_query(f"WITH {_SEG_SQL} SELECT way_id, piece, a AS start_node, b AS end_node, n AS n_points, round(len, 4) + 0 AS length_m, CASE way_id % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'service' WHEN 3 THEN 'motorway' ELSE 'tertiary' END AS road_class, oneway FROM seg")
def road_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = roads.segments(_ways(spark, sf_dir))
    return s.select("way_id", "piece", "start_node", "end_node", F.size("points").cast("long").alias("n_points"), _r("length_m", 4).alias("length_m"), "road_class", "oneway")


@_query(f"""WITH {_SEG_SQL}, ex AS (SELECT way_id, piece, 'end' AS side, b AS node FROM seg UNION ALL SELECT way_id, piece, 'start', a FROM seg WHERE NOT oneway), en AS (SELECT way_id AS tw, piece AS tp, a AS node, true AS f FROM seg UNION ALL SELECT way_id, piece, b, false FROM seg WHERE NOT oneway)
    SELECT way_id, piece, side, tw AS to_way, tp AS to_piece, bool_or(f) AS forward FROM ex JOIN en USING (node) WHERE way_id <> tw OR piece <> tp GROUP BY way_id, piece, side, tw, tp""")
def road_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.successors(roads.segments(_ways(spark, sf_dir)))


@_query(f"WITH {_EDGE_SQL} SELECT way_id, piece, CAST(k AS INTEGER) AS k, round(len, 4) + 0 AS len_m, round(along, 4) + 0 AS along_m, round(deg, 5) + 0 AS bearing_deg FROM ed")
def road_edges_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = roads.edges_of_segments(roads.segments(_ways(spark, sf_dir)), LAT0, LON0)
    return e.select("way_id", "piece", "k", _r("len_m", 4).alias("len_m"), _r("along_m", 4).alias("along_m"), _r("bearing_deg", 5).alias("bearing_deg"))


_RADIUS = 12.0
_PROJECT_SQL = f"""{FIX_SQL}, {_EDGE_SQL}, pt AS (SELECT seq, {_X('lon')} AS px, {_Y('lat')} AS py FROM fix), pc AS (SELECT *, floor(px / 50) AS cx, floor(py / 50) AS cy FROM pt),
    ec AS (SELECT *, unnest(generate_series(CAST(floor((least(y0, y1) - {_RADIUS}) / 50) AS BIGINT), CAST(floor((greatest(y0, y1) + {_RADIUS}) / 50) AS BIGINT))) AS cy FROM (SELECT *, unnest(generate_series(CAST(floor((least(x0, x1) - {_RADIUS}) / 50) AS BIGINT), CAST(floor((greatest(x0, x1) + {_RADIUS}) / 50) AS BIGINT))) AS cx FROM ed)),
    pr AS (SELECT seq, px, py, ec.*, CASE WHEN len > 0 THEN least(greatest(((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / (len * len), 0), 1) ELSE 0 END AS t FROM pc JOIN ec ON pc.cx = ec.cx AND pc.cy = ec.cy),
    pd AS (SELECT *, sqrt(pow(px - x0 - t * (x1 - x0), 2) + pow(py - y0 - t * (y1 - y0), 2)) AS d FROM pr), ph AS (SELECT *, row_number() OVER (PARTITION BY seq, way_id, piece ORDER BY round(d, 9), k) AS i FROM pd WHERE d <= {_RADIUS}), pj AS (SELECT * FROM ph WHERE i = 1)"""


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = roads.edges_of_segments(roads.segments(_ways(spark, sf_dir)), LAT0, LON0)
    return roads.project(fix_view(spark, sf_dir).select("seq", "lat", "lon"), e, _RADIUS, LAT0, LON0, ["seq"])


@_query(f"WITH {_PROJECT_SQL} SELECT seq, way_id, piece, round(d, 4) + 0 AS distance_m, round(along + t * len, 3) + 0 AS along_m, round(CASE WHEN len > 0 THEN -((x1 - x0) * (py - y0 - t * (y1 - y0)) - (y1 - y0) * (px - x0 - t * (x1 - x0))) / len ELSE 0 END, 4) + 0.0 AS cross_m, round({LAT0} + degrees((y0 + t * (y1 - y0)) / {_N.format(LAT0)}), 7) + 0 AS lat_on FROM pj")
def road_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fix on every segment within 12 m."""
    p = _projected(spark, sf_dir)
    return p.select("seq", "way_id", "piece", _r("distance_m", 4).alias("distance_m"), _r("along_m", 3).alias("along_m"), (F.round("cross_m", 4) + 0.0).alias("cross_m"), _r("lat_on", 7).alias("lat_on"))


@_query(f"WITH {_PROJECT_SQL}, pk AS (SELECT seq, way_id, piece, row_number() OVER (PARTITION BY seq ORDER BY round(d, 6), way_id, piece) AS place FROM pj) SELECT seq, way_id, piece, CAST(place AS INTEGER) AS place FROM pk WHERE place <= 3")
def road_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _projected(spark, sf_dir).withColumn("distance_m", F.round("distance_m", 6))
    return roads.nearest(p, ["seq"], 3).select("seq", "way_id", "piece", "place")


@_query(f"WITH {_PROJECT_SQL} SELECT count(*) AS segments, count(DISTINCT way_id) AS ways, round(sum(len), 2) + 0 AS length_m FROM seg WHERE (way_id, piece) NOT IN (SELECT (way_id, piece) FROM pj WHERE seq % 2 = 0)")
def roads_without_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the network after the segments near every second fix are removed."""
    s = roads.segments(_ways(spark, sf_dir))
    out = roads.network_size(roads.without_near(s, _projected(spark, sf_dir).filter("seq % 2 = 0")))
    return out.withColumn("length_m", _r("length_m", 2))


@_query(f"""WITH {_EDGE_SQL}, q AS (SELECT s.way_id, s.piece, (s.way_id % 70 - 5) * 1.0::DOUBLE AS d0, sum(e.len) AS total FROM seg s JOIN ed e ON s.way_id = e.way_id AND s.piece = e.piece GROUP BY ALL), c AS (SELECT *, least(greatest(d0, 0), total) AS d FROM q),
    h AS (SELECT c.*, e.k, e.x0, e.y0, e.x1, e.y1, e.len, e.along, e.deg, row_number() OVER (PARTITION BY c.way_id, c.piece ORDER BY e.k) AS i, max(e.k) OVER (PARTITION BY c.way_id, c.piece) AS last FROM c JOIN ed e ON c.way_id = e.way_id AND c.piece = e.piece),
    g AS (SELECT *, row_number() OVER (PARTITION BY way_id, piece ORDER BY k) AS j FROM h WHERE d <= along + len OR k = last), v AS (SELECT c.way_id, c.piece, max(CASE WHEN e.along + e.len > 5 AND e.along < 45 THEN abs({_wrap('e.deg - 90')}) END) AS w FROM c JOIN ed e ON c.way_id = e.way_id AND c.piece = e.piece GROUP BY ALL)
    SELECT g.way_id, g.piece, round({LAT0} + degrees((y0 + (d - along) / len * (y1 - y0)) / {_N.format(LAT0)}), 7) + 0 AS lat, round({LON0} + degrees((x0 + (d - along) / len * (x1 - x0)) / {_E.format(LAT0)}), 7) + 0 AS lon, round(deg, 5) + 0 AS bearing_deg, round(coalesce(w, 0), 5) + 0 AS deviation_deg FROM g JOIN v ON g.way_id = v.way_id AND g.piece = v.piece WHERE j = 1""")
def road_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place along each segment, and how far its edges between 5 and 45 m turn away from east."""
    s = roads.segments(_ways(spark, sf_dir)).withColumn("id", F.struct("way_id", "piece"))
    e = roads.edges_of_segments(s, LAT0, LON0)
    at = roads.place_along(s.select("id", "way_id", "piece", (F.col("way_id") % 70 - 5).cast("double").alias("along_m")), e, LAT0, LON0)
    q = s.select("id", "way_id", "piece", F.lit(5.0).alias("from_m"), F.lit(45.0).alias("to_m"), F.lit(90.0).alias("reference_deg"))
    out = at.join(roads.max_deviation(q, e), "id")
    return out.select("id.way_id", "id.piece", _r("lat", 7).alias("lat"), _r("lon", 7).alias("lon"), _r("bearing_deg", 5).alias("bearing_deg"), _r("deviation_deg", 5).alias("deviation_deg"))


_DEST = f"(degrees(asin(least(greatest(sin(radians(lat)) * cos(700 / 6371008.8) + cos(radians(lat)) * sin(700 / 6371008.8), -1), 1))))"


@_query(f"""WITH {_SEG_SQL}, m AS (SELECT way_id, piece, pos, {_DEST} AS la, lon FROM ne), z AS (SELECT *, degrees(asin(sin(radians(la)) * cos(300 / 6371008.8))) AS lat2, lon + degrees(atan2(sin(300 / 6371008.8) * cos(radians(la)), cos(300 / 6371008.8) - sin(radians(la)) * sin(asin(sin(radians(la)) * cos(300 / 6371008.8))))) AS lon2 FROM m)
    SELECT way_id, piece, count(*) AS n, round(avg(lat2), 7) + 0 AS lat, round(avg(lon2), 7) + 0 AS lon FROM z GROUP BY way_id, piece""")
def shifted_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network 700 m north and 300 m east, segment by segment."""
    w = roads.to_ways(roads.segments(_ways(spark, sf_dir)), 300.0, 700.0)
    # The SQL adds the place where a way is cut after the others of the piece that begins there.
    order = lambda c: F.when(F.col("from_piece") > 0, F.concat(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1))).otherwise(F.col(c))
    mean = lambda c: F.aggregate(order(c), F.lit(0.0), lambda a, x: a + x) / F.size(c)
    return w.select(F.col("from_way").alias("way_id"), F.col("from_piece").alias("piece"), F.size("lats").cast("long").alias("n"), _r(mean("lats"), 7).alias("lat"), _r(mean("lons"), 7).alias("lon"))


_WIDE = "100"


@_query(f"""WITH {_NODES_SQL}, wd AS (SELECT way_id, pos, 50 + (lat - 50) * {_WIDE} AS lat, 30 + (lon - 30) * {_WIDE} AS lon FROM nd), pv AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM wd WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
    st AS (SELECT *, CAST(trunc(greatest(abs(lat - la) / 0.05::DOUBLE, abs(lon - lo) / 0.08::DOUBLE) * 6) AS BIGINT) AS n FROM pv), sm AS (SELECT way_id, lat, lon FROM wd UNION ALL SELECT way_id, la + k / (n + 1)::DOUBLE * (lat - la), lo + k / (n + 1)::DOUBLE * (lon - lo) FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM st WHERE n > 0))
    SELECT DISTINCT way_id, CAST(floor(lat / 0.05::DOUBLE) AS BIGINT) AS iy, CAST(floor(lon / 0.08::DOUBLE) AS BIGINT) AS ix FROM sm""")
def way_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of the network, a hundred times as large."""
    w = _ways(spark, sf_dir)
    wide = lambda c, o: F.transform(c, lambda x: o + (x - o) * int(_WIDE))
    return roads.tiles_of_ways(w.withColumns({"lats": wide("lats", 50), "lons": wide("lons", 30)}))


@_query("""WITH p AS (SELECT n_nationkey, n_nationkey * 3.3::DOUBLE - 30 AS lat, n_nationkey * 7.1::DOUBLE - 80 AS lon FROM nation), b AS (SELECT *, 12000 / 111195.0::DOUBLE AS dy, 12000 / (111195.0::DOUBLE * greatest(cos(radians(lat)), 0.01)) AS dx, CAST(floor(lat / 0.05::DOUBLE) AS BIGINT) AS cy, CAST(floor(lon / 0.08::DOUBLE) AS BIGINT) AS cx FROM p),
    y AS (SELECT *, unnest(generate_series(CAST(floor((lat - dy) / 0.05::DOUBLE) AS BIGINT), CAST(floor((lat + dy) / 0.05::DOUBLE) AS BIGINT))) AS iy FROM b), x AS (SELECT *, unnest(generate_series(CAST(floor((lon - dx) / 0.08::DOUBLE) AS BIGINT), CAST(floor((lon + dx) / 0.08::DOUBLE) AS BIGINT))) AS ix FROM y)
    SELECT n_nationkey, iy, ix, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY greatest(abs(ix - cx), abs(iy - cy)), iy, ix) AS INTEGER) AS place, n_nationkey % 4 = 0 OR n_nationkey % 3 = 2 AS stale FROM x""")
def tiles_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles within 12 km of places, nearest first, and whether a file of the given age is due."""
    k = F.col("n_nationkey")
    p = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", (k * F.lit(3.3) - 30).alias("lat"), (k * F.lit(7.1) - 80).alias("lon"))
    day = 24 * 3600 * 1000
    modified = F.when(k % 4 == 0, 0).when(k % 3 == 2, F.lit(1000 * day - 90 * day - 1)).when(k % 3 == 1, F.lit(1000 * day - 90 * day)).otherwise(F.lit(2000 * day))
    return roads.tiles_around(p, 12_000.0).withColumn("stale", roads.is_stale(modified, F.lit(1000 * day))).drop("lat", "lon")


_TAG = "CASE o_orderkey % {n} {cases} END"


def _tag_cases(n: int, values: list[str | None]) -> str:
    return _TAG.format(n=n, cases=" ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)))


_TAGS = {
    "highway": _tag_cases(11, ["residential", "service", "motorway", "footway", None, "primary", "service", "tertiary", "motorway_link", "cycleway", "road"]), "service": _tag_cases(3, ["parking_aisle", "alley", None]), "area": _tag_cases(13, ["yes"] + [None] * 12),
    "access": _tag_cases(7, ["no", "yes"] + [None] * 5), "motor_vehicle": _tag_cases(2, ["destination", None]), "oneway": _tag_cases(9, ["yes", "-1", "no", None, "reverse", "1", "false", "maybe", None]), "junction": _tag_cases(5, ["roundabout"] + [None] * 4),
    "lanes": _tag_cases(6, ["2", "3;2", " 4 ", "many", "99", None]), "layer": _tag_cases(8, ["1", "-1", "-9", "7", "x", None, None, None]), "name": _tag_cases(4, ["A", "B", None, ""]),
}
#: Ways of orders over nodes of parts: every seventh part has no place, every third order brings the places of its first lines.
_TAGS_SQL = ", ".join(f"{e} AS {n}" for n, e in _TAGS.items())


@_query(f"""WITH t AS (SELECT o_orderkey AS id, {_TAGS_SQL} FROM orders), n AS (SELECT l_orderkey AS id, l_linenumber AS pos, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem),
    k AS (SELECT id, i, node, m, (node % 7 <> 0) OR (id % 3 = 0 AND i <= 2) AS known FROM n), a AS (SELECT id, any_value(m) AS m, bool_and(known) AS ok, list(node ORDER BY i) AS nodes FROM k GROUP BY id),
    r AS (SELECT t.*, a.m, a.ok, a.nodes, CASE WHEN oneway IN ('yes', 'true', '1') THEN 1 WHEN oneway IN ('-1', 'reverse') THEN -1 WHEN oneway IN ('no', 'false', '0') THEN 0 WHEN coalesce(junction IN ('roundabout', 'circular'), false) OR highway IN ('motorway', 'motorway_link') THEN 1 ELSE 0 END AS dir FROM t JOIN a USING (id)
        WHERE highway IN ('residential', 'service', 'motorway', 'primary', 'tertiary', 'motorway_link', 'road') AND NOT (highway = 'service' AND coalesce(service = 'parking_aisle', false)) AND coalesce(area <> 'yes', true) AND NOT (coalesce(access = 'no', false) AND motor_vehicle IS NULL) AND m >= 2 AND ok)
    SELECT id AS way_id, array_to_string(CASE WHEN dir < 0 THEN list_reverse(nodes) ELSE nodes END, ',') AS nodes, highway AS road_class, dir <> 0 AS oneway, CAST(CASE WHEN lanes = '3;2' THEN 3 WHEN lanes = ' 4 ' THEN 4 WHEN lanes = '99' THEN 20 WHEN lanes = '2' THEN 2 ELSE 0 END AS INTEGER) AS lanes,
    CAST(CASE layer WHEN '1' THEN 1 WHEN '-1' THEN -1 WHEN '-9' THEN -5 WHEN '7' THEN 5 ELSE 0 END AS INTEGER) AS layer, coalesce(name, '') AS name FROM r""")
def map_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "part"))
    place = lambda k: F.struct((k * 1e-3).cast("double").alias("lat"), (k * 2e-3).cast("double").alias("lon"))
    packed = items.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    tags = F.expr("map_filter(map(" + ", ".join(f"'{n}', {e}" for n, e in _TAGS.items()) + "), (k, v) -> v IS NOT NULL)")
    w = orders.select(F.col("o_orderkey").alias("id"), tags.alias("tags")).join(packed, "id")
    geometry = F.when(F.col("id") % 3 == 0, F.transform(F.slice("s", 1, 2), lambda x: place(x["l_partkey"])))
    w = w.select(F.lit("way").alias("type"), "id", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.col("s.l_partkey").alias("nodes"), geometry.alias("geometry"), "tags")
    n = part.filter("p_partkey % 7 <> 0").select(F.lit("node").alias("type"), F.col("p_partkey").alias("id"), place(F.col("p_partkey")).alias("p")).select("type", "id", "p.lat", "p.lon")
    out = roads.ways_of_elements(w.unionByName(n, allowMissingColumns=True))
    return out.select("way_id", F.array_join(F.col("node_ids").cast("array<string>"), ",").alias("nodes"), "road_class", "oneway", "lanes", "layer", "name")


@_query(f"WITH {_NODES_SQL} SELECT way_id, count(*) AS n, array_to_string(list(node ORDER BY pos), ',') AS nodes, round(sum(lat), 5) + 0 AS lat, round(sum(lon), 5) + 0 AS lon, way_id % 4 = 0 AS oneway, CAST(way_id % 3 AS INTEGER) AS lanes, 'r' || way_id % 10 AS name FROM nd GROUP BY way_id")
def tile_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways written as tile files, some to two tiles, and read back once each."""
    path = scratch_folder(spark)
    tiles.write_tiles(_ways(spark, sf_dir), path)
    w = tiles.read_tiles(spark, path)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return w.select("way_id", F.size("node_ids").cast("long").alias("n"), F.array_join(F.col("node_ids").cast("array<string>"), ",").alias("nodes"), _r(total("lats"), 5).alias("lat"), _r(total("lons"), 5).alias("lon"), "oneway", "lanes", "name")


@_query(f"""WITH RECURSIVE {_SEG_SQL}, st AS (SELECT s.way_id AS w, s.piece AS p, true AS f, s.len, s.b AS node FROM seg s UNION ALL SELECT s.way_id, s.piece, false, s.len, s.a FROM seg s WHERE NOT s.oneway),
    en AS (SELECT way_id AS tw, piece AS tp, a AS node, true AS tf FROM seg UNION ALL SELECT way_id, piece, b, false FROM seg WHERE NOT oneway), sp AS (SELECT st.w, st.p, st.f, st.len, en.tw, en.tp, en.tf FROM st JOIN en USING (node) WHERE st.w <> en.tw OR st.p <> en.tp),
    r AS (SELECT w AS sw, p AS s_p, tw AS w, tp AS p, tf AS f, len / 2 AS d FROM sp WHERE f AND len / 2 <= 45 UNION SELECT r.sw, r.s_p, sp.tw, sp.tp, sp.tf, r.d + sp.len FROM r JOIN sp ON sp.w = r.w AND sp.p = r.p AND sp.f = r.f WHERE r.d + sp.len <= 45)
    SELECT sw AS from_way, s_p AS from_piece, w AS way_id, p AS piece, f AS forward, round(min(d), 3) + 0 AS way_m FROM r GROUP BY ALL""")
def reachable_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the middle of each segment, driven forward: what is at most 45 m away."""
    work = scratch_folder(spark)
    segs = stored(roads.segments(_ways(spark, sf_dir)), work, "segments")
    steps = stored(roads.directed_steps(segs), work, "steps")
    starts = segs.select(F.struct("way_id", "piece").alias("id"), "way_id", "piece", F.lit(True).alias("forward"), (F.col("length_m") / 2).alias("left_m"))
    out = roads.reachable(starts, steps, 45.0, lambda df, name: stored(df, work, name))
    return out.select(F.col("id.way_id").alias("from_way"), F.col("id.piece").alias("from_piece"), "way_id", "piece", "forward", _r("way_m", 3).alias("way_m"))


def _networks(spark: SparkSession, sf_dir: str, reach_m: float) -> tuple[DataFrame, DataFrame]:
    """Fixes with the name of their piece of the network, and these pieces."""
    work = scratch_folder(spark)
    f = fix_view(spark, sf_dir).select("drive_id", "t_ns", "seq", "lat", "lon", "speed_mps", "bearing_deg")
    ways = stored(_ways(spark, sf_dir), work, "ways")
    near = stored(roads.ways_near(ways, f, reach_m + 2 * roads.CELL_M + 2.0, LAT0, LON0), work, "near")
    segs = stored(roads.segments(near, ways), work, "segments")
    drives, networks = roads.networks_of_drives(f, segs, roads.edges_of_segments(segs, LAT0, LON0), reach_m, LAT0, LON0)
    return f.join(drives, "drive_id"), networks


@_query()
def matched_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each drive's fixes as steps of five metres on its piece of the network; tests hold the matcher against made drives."""
    f, networks = _networks(spark, sf_dir, 120.0)
    var, turn = F.lit(25.0), F.lit(0.0)
    steps = f.select("drive_id", "net_id", "t_ns", "seq", "lat", "lon", var.alias("cov_ee"), turn.alias("cov_en"), var.alias("cov_nn"), F.radians("bearing_deg").alias("heading_rad"), F.lit(0.2).alias("heading_std_rad"), F.lit(5.0).alias("way_m"), turn.alias("turn_rad"), "speed_mps")
    m = road_matcher.match_drives(steps, networks, road_matcher.MatchRules(candidates=4, hypotheses=8))
    return m.select("drive_id", "seq", "way_id", "piece", "forward", _r("along_m", 3).alias("along_m"), _r("probability").alias("probability"), _r("off_road").alias("off_road"), _r("axis_rad").alias("axis_rad"), "hypotheses")


@_query()
def offline_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest chain of each drive's fixes, twenty metres apart by the odometer; tests hold it against all chains.

    The rules are the fixed ones: all roads within 150 m, the 40 nearest of them, and ways of twice the odometer and 300 m. Pieces of the network reach
    half of such a way, and the radius, beyond the fixes.
    """
    f, networks = _networks(spark, sf_dir, 500.0)
    rows = f.withColumn("odo_m", F.row_number().over(Window.partitionBy("drive_id").orderBy("t_ns", "seq")) * 20.0).select("drive_id", "net_id", "t_ns", "seq", "odo_m", "lat", "lon")
    m = offline_match.match_whole_drives(rows, networks)
    return m.select("drive_id", "seq", _r("lat", 7).alias("lat"), _r("lon", 7).alias("lon"), _r("bearing_deg", 4).alias("bearing_deg"), "reliable", "matched", "way_id", "piece", _r("along_m", 3).alias("along_m"), "begins")
