"""Keyed streams against their batch twins, on rows that come late and over several micro-batches; state that goes."""

import random
import time

from drivelake.operators import throttle
from drivelake.streaming.keyed import keyed_stream
from drivelake.streaming.probe import ProbeRules, probe_actions, probe_stream

S = 1_000_000_000


def streamed(spark, tmp_path, df, make, name, n, parts=3):
    """What a stream of df's rows, late by up to 0.4 s, gives."""
    rng = random.Random(1)
    rows = sorted(df.collect(), key=lambda r: r.t_ns + rng.randrange(400_000_000))
    size = len(rows) // parts + 1
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table(name).count() < n:
            time.sleep(0.5)
        time.sleep(1)
    finally:
        q.stop()
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def test_probe_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(d, "status", t * S, t, rng.random() < 0.9, None, None, None) for d in (1, 2) for t in range(0, 200, 2)]
    rows += [(d, "verdict", t * S + 5, 1000 + t, None, "GNSS", rng.choice(("TRUSTED", "REJECTED")), rng.choice(("", "IMPOSSIBLE_VELOCITY"))) for d in (1, 2) for t in range(0, 200, 3)]
    rows += [(d, "tick", t * S, t, None, None, None, None) for d in (1, 2) for t in range(200)]
    df = spark.createDataFrame(rows, "drive_id long, what string, t_ns long, seq long, healthy boolean, source string, state string, reasons string")
    split = lambda x: (x.filter("what = 'status'"), x.filter("what = 'verdict'"), x.filter("what = 'tick'"))
    rules = ProbeRules(healthy_s=3.0, pause_s=6.0, window_s=10.0, no_fix_s=5.0)
    want = sorted(map(tuple, probe_actions(*split(df), rules).collect()), key=str)
    assert len(want) > 6
    assert streamed(spark, tmp_path, df, lambda s: probe_stream(*split(s), rules, flush_ms=500), "probe_rows", len(want)) == want


def test_throttle_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(d, t * S // 4, t, rng.choice("ab"), rng.random() < 0.5) for d in (1, 2) for t in range(120)]
    df = spark.createDataFrame(rows, "drive_id long, t_ns long, seq long, plug string, charging boolean")
    want = sorted(map(tuple, throttle.at_most_every(df, ["plug", "charging"], 3.0, 0.5).select("drive_id", "t_ns", "seq", "plug", "charging").collect()), key=str)
    assert streamed(spark, tmp_path, df, lambda s: throttle.at_most_every_stream(s, ["plug", "charging"], 3.0, 0.5, flush_ms=500), "kept_rows", len(want)) == want


def test_late_rows_are_taken_and_silent_drives_forgotten(spark, tmp_path):
    schema = "drive_id long, t_ns long, rank int, seq long"
    every = lambda: throttle._Kept(0, -(1 << 62))
    parts = [[(1, 0, 0, 0), (1, 2 * S, 0, 1), (1, 4 * S, 0, 2)], [(1, S, 0, 3), (1, 5 * S, 0, 4)]]
    q = None
    try:
        for i, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
            if q is None:
                stream = spark.readStream.schema(schema).parquet(str(tmp_path / "late"))
                q = keyed_stream(stream, ["t_ns", "rank", "seq"], every, "t_ns long, seq long", flush_ms=60_000).writeStream.format("memory").queryName("late_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "late-state")).start()
            end = time.time() + 40
            while time.time() < end and spark.table("late_rows").count() < (2, 3)[i]:
                time.sleep(0.3)
        got = sorted(map(tuple, spark.table("late_rows").collect()))
        assert got == [(1, 0, 0), (1, 2 * S, 1), (1, 4 * S, 2)]  # the row at five seconds waits, the late one is no row after the last kept
    finally:
        q.stop()
    # With short times the drive is flushed and then forgotten.
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "late"))
    q = keyed_stream(stream, ["t_ns", "rank", "seq"], every, "t_ns long, seq long", flush_ms=500, forget_ms=500).writeStream.format("memory").queryName("gone_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "gone-state")).start()
    try:
        end = time.time() + 60
        left = 1
        while time.time() < end and not (spark.table("gone_rows").count() == 5 and left == 0):
            time.sleep(0.5)
            left = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress and q.lastProgress["stateOperators"] else 1
        assert left == 0 and [r.seq for r in spark.table("gone_rows").orderBy("t_ns").collect()] == [0, 3, 1, 2, 4]
    finally:
        q.stop()
