"""Nesting, deduplication and road topology on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nest_children(parents: DataFrame, children: DataFrame, on: str, child_key: str, fields: list[str], order: str, name: str = "items") -> DataFrame:
    """Every parent with an array of its children's fields, in order; without children an empty array."""
    packed = children.groupBy(F.col(child_key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(order, *(f for f in fields if f != order)))).alias(name))
    kind = packed.schema[name].dataType
    return parents.join(packed, parents[on] == packed["_k"], "left").drop("_k").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def nest_by_time(parents: DataFrame, children: DataFrame, fields: list[str], name: str) -> DataFrame:
    """Every parent with an array of the children of its drive and time, in order of seq; without children an empty array."""
    packed = children.groupBy("drive_id", "t_ns").agg(F.array_sort(F.collect_list(F.struct("seq", *fields))).alias("_c"))
    packed = packed.select("drive_id", "t_ns", F.transform("_c", lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))
    kind = packed.schema[name].dataType
    return parents.join(packed, ["drive_id", "t_ns"], "left").select(*parents.columns, F.coalesce(name, F.array().cast(kind)).alias(name))


def unnest_children(nested: DataFrame, keys: list[str], name: str = "items") -> DataFrame:
    """The children again, one row each."""
    return nested.select(*keys, F.explode(name).alias("_c")).select(*keys, "_c.*")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that comes last."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def without_repeats(rows: DataFrame, value: Column) -> DataFrame:
    """Without rows that repeat the value of the row before them in their drive."""
    w = Window.partitionBy("drive_id").orderBy("t_ns", "seq")
    before = rows.withColumns({"_v": value, "_p": F.lag(value).over(w), "_i": F.row_number().over(w)})
    return before.filter((F.col("_i") == 1) | ~F.col("_v").eqNullSafe(F.col("_p"))).drop("_v", "_p", "_i")


#: Rows of one place in a bundle; rows of points and of others, at most about so many, that one key of the join of places holds.
BUNDLE, POINTS, OTHERS = 64, 4096, 16384


def _bundles(rows: DataFrame, lat: str, lon: str, name: str) -> DataFrame:
    """One row for each place and BUNDLE rows that lie there: lat, lon, _n (from 0), name (array of the rows' other columns)."""
    columns = [c for c in rows.columns if c not in (lat, lon)]
    w = Window.partitionBy(lat, lon).orderBy(F.xxhash64(*columns))
    numbered = rows.withColumn("_n", F.floor((F.row_number().over(w) - 1) / BUNDLE))
    return numbered.groupBy(lat, lon, "_n").agg(F.collect_list(F.struct(*columns)).alias(name))


def near_places(points: DataFrame, others: DataFrame, distance: Column, radius_m: float, cell_deg: float) -> DataFrame:
    """near_pairs before rows are paired: lat, lon, points (array), o_lat, o_lon, others (array), distance_m; each point of a row is near each other of it.

    The distance of two places is made once for up to BUNDLE rows at either. Every other lies in all cells that its radius reaches, a point in its own, so a
    pair meets once whatever the cells' size; cells go round the globe at 180 degrees. A dense cell is split into parts of its points and parts of its others,
    each part of one meets each of the other under a key of its own.
    """
    around = round(360 / cell_deg)
    row = lambda lat: F.floor((lat + 90) / cell_deg)
    column = lambda lon: F.floor((lon + 180) / cell_deg)
    d_lat = radius_m / 110_500.0 * 1.001  # a degree of latitude is longer everywhere
    lat, lon, d_lon = F.col("o_lat"), F.col("o_lon"), F.col("_d_lon")
    columns = F.array_distinct(F.transform(F.sequence(column(lon - d_lon), column(lon + d_lon)), lambda y: F.pmod(y, F.lit(around))))

    def in_cell(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"_x": row(F.col("lat")), "_y": F.pmod(column(F.col("lon")), F.lit(around))})

    def in_cells(rows: DataFrame) -> DataFrame:
        wide = rows.withColumn("_d_lon", F.least(d_lat / F.greatest(F.cos(F.radians(F.abs("o_lat") + d_lat)), F.lit(1e-6)), F.lit(180.0)))
        return wide.withColumn("_x", F.explode(F.sequence(row(lat - d_lat), row(lat + d_lat)))).withColumn("_y", F.explode(columns))

    points, others = points.filter("lat IS NOT NULL AND lon IS NOT NULL"), others.filter("o_lat IS NOT NULL AND o_lon IS NOT NULL")
    sizes = [cells.groupBy("_x", "_y").agg(F.ceil(F.count("*") / limit).alias(n)) for cells, limit, n in ((in_cell(points), POINTS, "_a"), (in_cells(others), OTHERS, "_b"))]
    dense = F.broadcast(sizes[0].join(sizes[1], ["_x", "_y"]).filter("_a > 1 OR _b > 1"))  # fewer than one for POINTS points or OTHERS others
    parts = lambda n: F.coalesce(n, F.lit(1).cast("long"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), parts(F.col(n)) - 1))
    one_of = lambda n, *place: F.pmod(F.xxhash64(*place, "_n"), parts(F.col(n)))

    left = in_cell(_bundles(points, "lat", "lon", "points")).join(dense, ["_x", "_y"], "left")
    left = left.select("_x", "_y", one_of("_a", "lat", "lon").alias("_i"), all_of("_b").alias("_j"), "lat", "lon", "points")
    right = in_cells(_bundles(others, "o_lat", "o_lon", "others")).join(dense, ["_x", "_y"], "left").withColumn("_k", one_of("_b", "o_lat", "o_lon"))
    right = right.select(F.col("_x").alias("_ox"), F.col("_y").alias("_oy"), all_of("_a").alias("_oi"), F.col("_k").alias("_oj"), "o_lat", "o_lon", "_d_lon", "others")
    same = (F.col("_x") == F.col("_ox")) & (F.col("_y") == F.col("_oy")) & (F.col("_i") == F.col("_oi")) & (F.col("_j") == F.col("_oj"))
    across = F.abs(F.col("lon") - lon)
    box = (F.abs(F.col("lat") - lat) <= d_lat) & ((across <= d_lon) | (across >= 360 - d_lon))  # spares most distances
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a count that is told stays: the work of a partition is its pairs, not its bytes
    left, right = left.repartition(n, "_x", "_y", "_i", "_j"), right.repartition(n, "_ox", "_oy", "_oi", "_oj")
    near = left.join(right.hint("merge"), same & box)
    near = near.select("lat", "lon", "points", "o_lat", "o_lon", "others", distance.alias("_d"))
    # The generator keeps the filter on this side of the join, whose condition would make each part of the distance as often as it is named.
    return near.withColumn("distance_m", F.explode(F.array("_d"))).drop("_d").filter(F.col("distance_m") <= radius_m)


def unpacked(near: DataFrame) -> DataFrame:
    """A row for each point and other of near_places; further columns stay."""
    rows = near.select(*(c for c in near.columns if c != "points"), F.inline("points"))
    return rows.select(*(c for c in rows.columns if c != "others"), F.inline("others"))


def near_pairs(points: DataFrame, others: DataFrame, distance: Column, radius_m: float, cell_deg: float) -> DataFrame:
    """Pairs of points (lat, lon) and others (o_id, o_lat, o_lon) within radius_m. distance is an expression over the two places. Rows without a place have no partner."""
    return unpacked(near_places(points, others, distance, radius_m, cell_deg)).select(*points.columns, *others.columns, "distance_m")


def split_ways(ways: DataFrame) -> DataFrame:
    """Segments of ways (way_id, nodes array): a way ends and begins anew at nodes that several way places share.

    way_id, piece (from 0), start_node, end_node, n_nodes. Null nodes belong to no way; ways without nodes have no segments. operators.roads.segments keeps
    places and traits as well.
    """
    places = ways.select("way_id", F.size("nodes").alias("n"), F.posexplode("nodes").alias("pos", "node"))
    shared = places.groupBy("node").agg((F.count("*") > 1).alias("shared"))
    cut = F.col("shared") & (F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1)
    p = places.join(shared, "node").select("way_id", F.struct("pos", "node", cut.alias("cut")).alias("place"))
    rows = p.groupBy("way_id").agg(F.array_sort(F.collect_list("place")).alias("s"))
    # Pieces are cut inside the row of their way. A node where the way is cut ends one piece and begins the next.
    last = F.size("s") - 1
    inner = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("s", i)["cut"])
    rows = rows.withColumn("b", F.concat(F.array(F.lit(0)), inner, F.array(last)))
    node = lambda i: F.get("s", F.get("b", i))["node"]
    piece = lambda i: F.struct(i.cast("long").alias("piece"), node(i).alias("start_node"), node(i + 1).alias("end_node"), (F.get("b", i + 1) - F.get("b", i) + 1).cast("long").alias("n_nodes"))
    return rows.select("way_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("b") - 2), piece)).alias("_p")).select("way_id", "_p.*")


def segment_edges(segments: DataFrame) -> DataFrame:
    """Pairs of segments where the second begins at the node that ends the first."""
    a = segments.select(F.col("way_id").alias("from_way"), F.col("piece").alias("from_piece"), F.col("end_node").alias("node"))
    b = segments.select(F.col("way_id").alias("to_way"), F.col("piece").alias("to_piece"), F.col("start_node").alias("node"))
    return a.join(b, "node").filter((F.col("from_way") != F.col("to_way")) | (F.col("from_piece") != F.col("to_piece")))
