import math
import random

import numpy as np
from pyspark.sql import functions as F

from drivelake.operators import trips
from drivelake.sources import records
from drivelake.streaming import live

POINTS = "drive_id long, t_ns long, seq long, lat double, lon double, from_estimates boolean"


def plain(points, tolerance):
    """Douglas and Peucker, recursively, in the plane of the first point."""
    k = trips.DEGREE_M * math.cos(math.radians(points[0][0]))
    xy = [((lon - points[0][1]) * k, (lat - points[0][0]) * trips.DEGREE_M) for lat, lon in points]

    def distance(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        square = dx * dx + dy * dy
        t = min(max(((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / square, 0), 1) if square else 0
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    def between(low, high):
        if high - low < 2:
            return []
        far = max(range(low + 1, high), key=lambda i: (distance(xy[i], xy[low], xy[high]), -i))
        if distance(xy[far], xy[low], xy[high]) <= tolerance:
            return []
        return [*between(low, far), far, *between(far, high)]

    return [0, *between(0, len(points) - 1), len(points) - 1]


def test_simplification_equals_a_plain_recursion():
    rng = random.Random(1)
    for _ in range(30):
        lat, lon, points = 50.0, 30.0, []
        for _ in range(rng.randrange(3, 120)):
            lat, lon = lat + rng.gauss(0, 1e-4), lon + rng.gauss(0, 1e-4)
            points.append((lat, lon))
        got = trips.kept(*(np.array(x) for x in zip(*points)), 8.0)
        assert got.tolist() == plain(points, 8.0)


def test_routes_of_drives(spark):
    rows = [(1, i, i, 50.0 + i * 1e-4, 30.0, True) for i in range(50)] + [(2, 5, 1, 50.0, 30.0, False)] + [(3, i, i, 50.0 + (i % 2) * 1e-2, 30.0 + i * 1e-3, False) for i in range(40)] + [(None, 0, 0, 1.0, 1.0, True), (4, 0, 0, None, 1.0, True)]
    table = spark.createDataFrame(rows, POINTS)
    out = trips.simplified(table, most=10)
    sizes = {r.drive_id: r["count"] for r in out.groupBy("drive_id").count().collect()}
    assert sizes[1] == 2 and sizes[2] == 1 and sizes[3] <= 10 and set(sizes) == {1, 2, 3}
    s = {r.drive_id: r for r in trips.summaries(table.filter("drive_id < 3"), out).collect()}
    assert abs(s[1].length_m - 49 * 11.12) < 1 and s[2].length_m == 0 and s[1].points == 50
    near = trips.thinned(table.filter("drive_id = 1"), 30.0)
    assert [r.seq for r in near.orderBy("seq").collect()] == list(range(0, 50, 3))
    assert trips.simplified(table.filter("false")).count() == 0
    texts = spark.createDataFrame([(59.0,), (89.0,), (90.0,), (3569.0,), (3570.0,), (3900.0,)], "s double").select(trips.duration_text(F.col("s")).alias("t")).collect()
    assert [r.t for r in texts] == ["< 1 min", "1 min", "2 min", "59 min", "1 h 00 min", "1 h 05 min"]


def test_truth_files(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"tNs": 5, "lat": 50.0, "lon": 30.0, "bearingDeg": NaN, "speedMps": 1.5}, {"tNs": 6, "lat": 50.0, "lon": 30.0, "bearingDeg": 90.0, "speedMps": 2.0}]')
    got = records.read_truth(spark, str(tmp_path)).orderBy("t_ns").collect()
    assert [(r.drive_id, r.t_ns, r.bearing_deg, r.speed_mps) for r in got] == [("d", 5, None, 1.5), ("d", 6, 90.0, 2.0)]
    records.register_views({"truth": records.read_truth(spark, str(tmp_path))})
    assert spark.sql("SELECT max(speed_mps) AS v FROM truth").first().v == 2.0


def test_live_counts_in_a_stream(spark, tmp_path):
    kind = "drive_id long, type string, t_ns long"
    for i in range(3):
        spark.createDataFrame([(1, "imu", i * 10**9), (1, "imu", i * 10**9 + 5), (2, "nmea", None)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.live_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.drive_id, r.type): (r.n, r.per_s) for r in spark.table("counts").collect()}
    assert got == {(1, "imu"): (6, 6 / 2.000000005), (2, "nmea"): (3, None)}
