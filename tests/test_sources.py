"""Bundles, JSON lines, CSV, map tiles: what is written comes back, what is absent is empty."""

import gzip
import sqlite3

import pytest

from drivelake.operators import roads
from drivelake.sources import bundle, records, tiles
from drivelake.sources.schema import KINDS


@pytest.fixture
def file(tmp_path):
    path = tmp_path / "d1.sqlite"
    con = sqlite3.connect(path)
    con.executescript("""
        CREATE TABLE location (t_ns INTEGER, recv_ns INTEGER, source TEXT, provider TEXT, lat REAL, lon REAL, alt_m REAL, h_acc_m REAL, v_acc_m REAL, speed_mps REAL, speed_acc_mps REAL, bearing_deg REAL, bearing_acc_deg REAL, wall_time_ms INTEGER, is_mock INTEGER, sats_used INTEGER, extras_json TEXT);
        CREATE TABLE gnss_status (t_ns INTEGER PRIMARY KEY, sat_count INTEGER);
        CREATE TABLE gnss_sat (t_ns INTEGER, svid INTEGER, constellation INTEGER, cn0_dbhz REAL, elev_deg REAL, az_deg REAL, used_in_fix INTEGER, has_ephemeris INTEGER, has_almanac INTEGER, carrier_hz REAL, baseband_cn0_dbhz REAL);
        CREATE TABLE gnss_clock (t_ns INTEGER PRIMARY KEY, time_nanos INTEGER, leap_second INTEGER, time_unc_nanos REAL, full_bias_nanos INTEGER, bias_nanos REAL, bias_unc_nanos REAL, drift_nsps REAL, drift_unc_nsps REAL, hw_clock_discontinuity_count INTEGER);
        CREATE TABLE gnss_agc (t_ns INTEGER, constellation INTEGER, carrier_hz REAL, level_db REAL);
        CREATE TABLE trust (t_ns INTEGER, source TEXT, provider TEXT, state TEXT, confidence REAL, reasons TEXT, innovation_nis REAL, implied_speed_mps REAL);
        CREATE TABLE estimate (t_ns INTEGER, estimator TEXT, lat REAL, lon REAL, cov_ee REAL, cov_en REAL, cov_nn REAL, accuracy_m REAL, heading_rad REAL, heading_std_rad REAL, speed_mps REAL, speed_std_mps REAL, mode TEXT, confidence REAL, hypotheses_json TEXT);
        INSERT INTO location VALUES (20, 21, 'GNSS', 'gps', 50, 30, NULL, 5, NULL, 10, NULL, 90, NULL, 0, 1, NULL, '{"k": "v"}'), (10, 11, 'NETWORK', 'network', 51, 31, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 0, 4, NULL);
        INSERT INTO gnss_status VALUES (10, 2), (20, 0);
        INSERT INTO gnss_sat VALUES (10, 7, 1, 30, 1, 2, 1, 0, 1, NULL, NULL), (10, 3, 1, 20, 1, 2, 0, 0, 0, 1.5e9, NULL), (99, 1, 1, 1, 1, 1, 1, 1, 1, NULL, NULL);
        INSERT INTO gnss_clock VALUES (10, 123, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 4);
        INSERT INTO gnss_agc VALUES (10, 1, 1.5e9, 2.5);
        INSERT INTO trust VALUES (20, 'GNSS', 'gps', 'REJECTED', 0.05, 'STALE, POOR_ACCURACY,', NULL, 3);
        INSERT INTO estimate VALUES (30, 'e', 50, 30, 1, 0, 2, 9, NULL, NULL, NULL, NULL, 'GNSS_TRACKING', 0.9, NULL);
    """)
    con.commit()
    con.close()
    return str(path)


def test_bundle(spark, file):
    t = records.load(spark, file)
    loc = t["location"].orderBy("t_ns").collect()
    assert [(r.drive_id, r.seq, r.t_ns, r.source, r.is_mock, r.sats_used, r.extras) for r in loc] == [("d1", 2, 10, "NETWORK", False, 4, {}), ("d1", 1, 20, "GNSS", True, None, {"k": "v"})]
    assert {r.t_ns: [s.svid for s in r.sats] for r in t["gnss_status"].collect()} == {10: [7, 3], 20: []}
    m = bundle.scan(spark, file, "gnss_clock", "t_ns BIGINT, time_nanos BIGINT, hw_clock_discontinuity_count INT").first()
    assert (m.time_nanos, m.hw_clock_discontinuity_count) == (123, 4)
    g = t["gnss_meas"].first()
    assert g.clock.time_nanos == 123 and g.meas == [] and g.agc[0].level_db == 2.5  # a table that old bundles lack is empty
    for absent in ("cell_scan", "wifi_scan", "geomag", "power", "obd_raw", "imu"):
        assert t[absent].count() == 0 and t[absent].columns[:3] == ["drive_id", "seq", "t_ns"]
    assert t["trust"].first().reasons == ["STALE", "POOR_ACCURACY"]
    h = t["estimate"].first().hypotheses
    assert len(h) == 1 and h[0].weight == 1.0 and h[0].cov.nn == 2.0
    assert [r.t_ns for r in bundle.read_kind(spark, file, "location", t_from="15").collect()] == [20]


def test_json_lines_of_others(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text("""
{"type":"imu","tNs":5,"kind":"ACCEL","x":1.0,"y":NaN,"z":-2,"unknown":{"a":1}}

{"type":"location","tNs":9,"receivedNs":10,"source":"GNSS","provider":"gps","lat":50,"lon":30}
{"type":"sensor_info","tNs":0,"sensorType":2,"stringType":"m","name":"n","vendor":"v","version":1,"resolution":0.1,"maxRange":10,"minDelayUs":1,"maxDelayUs":2,"fifoMaxEvents":0,"powerMa":0.5}
{"type":"gnss_status","tNs":7,"sats":[{"svid":1,"constellation":3,"cn0DbHz":20.5,"elevDeg":1,"azDeg":2,"usedInFix":true}]}
{"type":"future","tNs":1}
""")
    t = records.load(spark, str(tmp_path / "d.jsonl"))
    imu = t["imu"].first()
    assert (imu.drive_id, imu.t_ns, imu.accuracy, imu.bx, imu.z) == ("d", 5, 0, None, -2.0) and imu.y != imu.y
    loc = t["location"].first()
    assert (loc.wall_time_ms, loc.is_mock, loc.extras, loc.recv_ns) == (0, False, {}, 10)
    assert t["sensor_info"].first().type == 2
    assert (t["gnss_status"].first().sats[0].cn0_dbhz, t["gnss_status"].first().sats[0].has_almanac) == (20.5, False)
    assert [r.type for r in records.all_records({k: v for k, v in t.items() if k in ("imu", "location", "sensor_info", "gnss_status")}).collect()] == ["sensor_info", "imu", "gnss_status", "location"]


def test_every_kind_survives_json_and_parquet(spark, tmp_path):
    from drivelake.sources.views import record_tables

    tables = record_tables(spark, "/root/testdata/sf0.001")
    few = {t: df.limit(5) for t, df in tables.items()}
    few = {t: spark.createDataFrame(df.collect(), df.schema) for t, df in few.items()}
    for path in (str(tmp_path / "x.jsonl"), str(tmp_path / "parquet")):
        records.save(few, path)
        back = records.load(spark, path)
        for t, df in few.items():
            drop = ["seq"] if path.endswith("jsonl") else []  # the place in the file
            key = lambda rows: sorted(map(str, (r.asDict(recursive=True) for r in rows)))
            assert key(back[t].drop(*drop).collect()) == key(df.drop(*drop).collect()), t


def test_packed_json_lines_share_files(spark, tmp_path):
    """Many small drives: no file for each, and every drive comes back, one without a name and ones with signs that folders escape too."""
    rows = [(d, 1, t, label, "") for d in [None, "a/b", "c=d", *map(str, range(40))] for t, label in ((5, "imu"), (4, 'x "type":"location"'))]
    path = str(tmp_path / "x.jsonl")
    records.save({"annotation": spark.createDataFrame(rows, KINDS["annotation"].ddl)}, path, packed=True)
    assert not list((tmp_path / "x.jsonl").glob("drive_id=*")) and len(list((tmp_path / "x.jsonl").glob("part-*"))) < len(rows) / 2
    back = records.load(spark, path)
    key = lambda rows: sorted(((*r[:1], *r[2:]) for r in map(tuple, rows)), key=str)
    assert key(back["annotation"].collect()) == key(rows) and back["imu"].count() == back["location"].count() == 0
    lines = records.json_lines(spark, path).orderBy("drive_id", "seq").collect()
    assert [r.drive_id for r in lines if '"imu"' in r.value] == [r.drive_id for r in lines if "location" in r.value]
    assert all(a.value.count('"tNs":4') for a in lines[::2])  # in order inside a drive


def test_a_type_spelled_by_escapes(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"type":"\\u0069mu","tNs":5,"kind":"ACCEL","x":1.0,"y":2,"z":-2}\n{"tNs":6,"drive":{"id":"e"},"type" : "annotation","label":"imu","note":""}\n')
    t = records.load(spark, str(tmp_path / "d.jsonl"))
    assert [(r.drive_id, r.t_ns) for r in t["imu"].collect()] == [("d", 5)] and [(r.drive_id, r.label) for r in t["annotation"].collect()] == [("d", "imu")]


def test_folders_of_some_kinds_and_saving_what_was_loaded(spark, tmp_path):
    rows = [("a", 1, 5, "start", ""), ("b", 2, 6, "x", "n"), (None, 3, 7, None, None)]
    path = str(tmp_path / "lake")
    with pytest.raises(FileNotFoundError):
        records.load(spark, path)
    records.save({"annotation": spark.createDataFrame(rows, KINDS["annotation"].ddl)}, path)
    assert (tmp_path / "lake" / "annotation" / "drive_id=a").is_dir()
    back = records.load(spark, path)
    assert sorted(map(tuple, back["annotation"].collect()), key=str) == sorted(rows, key=str) and back["imu"].count() == 0 and set(back) == set(KINDS)
    records.save({"annotation": back["annotation"].filter("drive_id = 'b'")}, path)
    assert list(map(tuple, records.load(spark, path)["annotation"].collect())) == [rows[1]]
    assert sorted(p.name for p in (tmp_path / "lake").iterdir()) == ["annotation"]


def test_csv_files_have_headers_and_quotes(spark, tmp_path):
    from drivelake.sources.views import record_tables

    tables = record_tables(spark, "/root/testdata/sf0.001")
    names = records.write_csv({"annotation": tables["annotation"], "imu": tables["imu"].filter("false")}, str(tmp_path))
    assert names == ["annotation"]
    text = "".join(p.read_text() for p in (tmp_path / "annotation").rglob("*.txt"))
    assert text.startswith("t_ns,label,note\n") and '"tunnel, ""north"""' in text


def test_tile_files(spark, tmp_path):
    way = {"way_id": 9, "node_ids": [1, -2], "lats": [50.0, 50.00000005], "lons": [30.0, -30.1], "road_class": "primary", "oneway": True, "lanes": 3, "layer": -1, "name": "\u0412\u0443\u043b"}
    raw = tiles.encode_tile([way, way | {"way_id": 4, "name": ""}])
    back = tiles.decode_tile(raw)
    assert [w["way_id"] for w in back] == [4, 9] and back[1] == way | {"lats": [50.0, 50.0000001]}
    for bad in (gzip.compress(b"\0" * 12), gzip.compress(raw and bytes.fromhex("47505244") + b"\0\0\0\2" + b"\0" * 4)):
        with pytest.raises(ValueError):
            tiles.decode_tile(bad)
    (tmp_path / "r1_1.roads").write_bytes(raw)
    (tmp_path / "r1_2.roads").write_bytes(tiles.encode_tile([way | {"name": "last"}]))
    got = {r.way_id: r.name for r in tiles.read_tile_files(spark, str(tmp_path)).collect()}
    assert got == {4: "", 9: "last"}


def test_ways_against_their_nodes_are_turned(spark):
    e = spark.createDataFrame(
        [("node", 1, 1.0, 1.0, None, None, None), ("node", 2, 2.0, 2.0, None, None, None), ("way", 5, None, None, [1, 2], None, {"highway": "primary", "oneway": "-1", "lanes": "2;3", "layer": "9"}), ("way", 6, None, None, [1, 3], None, {"highway": "primary"}),
         ("way", 7, None, None, [1, 3], [(8.0, 9.0), (7.0, 6.0)], {"highway": "motorway"}), ("way", 8, None, None, [1], None, {"highway": "primary"}), ("way", 9, None, None, [1, 2], None, None)],
        "type string, id long, lat double, lon double, nodes array<long>, geometry array<struct<lat:double,lon:double>>, tags map<string,string>",
    )
    got = {r.way_id: r for r in roads.ways_of_elements(e).collect()}
    assert set(got) == {5, 7} and got[5].node_ids == [2, 1] and got[5].lats == [2.0, 1.0] and (got[5].oneway, got[5].lanes, got[5].layer, got[5].name) == (True, 2, 5, "")
    assert got[7].lats == [8.0, 7.0] and got[7].oneway


def test_tiles_are_decoded_way_by_way(spark):
    """A task holds a batch of ways, not all tiles that came with one batch of files."""
    made = [{"way_id": i, "node_ids": [i, i + 1], "lats": [50.01, 50.02], "lons": [30.01, 30.02], "road_class": "road", "oneway": False, "lanes": 0, "layer": 0, "name": f"n{i}"} for i in range(2 * tiles.BATCH + 1)]
    raw = tiles.encode_tile(made)
    cut = gzip.compress(gzip.decompress(raw)[:-4])
    assert next(tiles.ways_of_tile(cut)) == made[0]  # before the broken end is reached
    files = spark.createDataFrame([("r1_1", raw), ("r1_2", tiles.encode_tile([]))], "tile string, content binary")
    assert [r.asDict() for r in tiles.decode_tiles(files).orderBy("way_id").collect()] == made
