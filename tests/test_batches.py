"""Rows of Arrow batches as Python values."""

import math

import pyarrow as pa

from drivelake.streaming import tracker
from drivelake.streaming.batches import rows_of, values


def test_values_are_those_of_pylist():
    columns = [pa.array([1, None, 1 << 62]), pa.array([1, 2, 3], pa.int32()), pa.array([0.1, None, -0.0]), pa.array(["a", None, "a"]), pa.array([True, None, False]), pa.array([None] * 3, pa.float64()), pa.array([], pa.int64()), pa.array([[1.0], None, []])]
    for c in columns:
        got = values(c)
        assert got == c.to_pylist() and list(map(type, got)) == list(map(type, c.to_pylist()))
    assert math.isnan(values(pa.array([math.nan]))[0])
    assert list(rows_of(pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["x", None])], ["a", "b"]))) == [(1, "x"), (2, None)]
    assert list(rows_of(pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["a"]))) == []


def test_sizes_of_forces_are_taken_once(monkeypatch):
    """An acceleration's size is asked for once a sample, and rows reach the fold without their ranks."""
    asked, norm = [], tracker._norm
    monkeypatch.setattr(tracker, "_norm", lambda a: asked.append(a) or norm(a))
    tracker.Tracker().take("imu", 0, "ACCEL", 0.1, 0.2, 9.8)
    assert asked.count((0.1, 0.2, 9.8)) == 1
