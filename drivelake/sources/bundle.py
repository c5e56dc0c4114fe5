"""Recorded drives in SQLite files as a Spark data source: one task a file, rows in batches, absent tables are empty."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, StructType

from drivelake.sources.schema import KINDS

#: Rows that a batch holds.
BATCH = 8192
#: Columns that a bundle stores under another name, as text, or not at all.
_STORED = {
    "session": "CAST(anchor_elapsed_ns AS INTEGER) AS t_ns, session_id, anchor_elapsed_ns, anchor_wall_ms, device, manufacturer, model, android_sdk, app_version, mode, notes, config_json",
    "location": "t_ns, recv_ns, source, provider, lat, lon, alt_m, h_acc_m, v_acc_m, speed_mps, speed_acc_mps, bearing_deg, bearing_acc_deg, wall_time_ms, is_mock, sats_used, extras_json",
    "estimate": "t_ns, estimator, lat, lon, cov_ee, cov_en, cov_nn, heading_rad, heading_std_rad, speed_mps, speed_std_mps, mode, confidence, hypotheses_json",
}


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class BundleReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        return [_File(p) for p in sorted(glob.glob(path))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        import sqlite3

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, table = to_arrow_schema(self.fields), self.options["table"]
        drive = os.path.basename(partition.path).rsplit(".", 1)[0]
        names = [f.name for f in self.fields][2:]
        columns = _STORED.get(table, ", ".join(names))
        bounds = [(f"t_ns {op} ?", int(self.options[o])) for o, op in (("t_from", ">="), ("t_until", "<")) if o in self.options]
        con = sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)
        try:
            if not con.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone():
                return
            where = f" WHERE {' AND '.join(b for b, _ in bounds)}" if bounds else ""
            rows = con.execute(f"SELECT rowid AS seq, {columns} FROM {table}{where} ORDER BY t_ns, rowid", [v for _, v in bounds])
            flags = [isinstance(f.dataType, BooleanType) for f in self.fields][1:]
            while found := rows.fetchmany(BATCH):
                values = [[drive] * len(found), *(([None if v is None else v != 0 for v in c] if flag else list(c)) for c, flag in zip(zip(*found), flags))]
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(values, arrow)], schema=arrow)
        finally:
            con.close()


class BundleSource(DataSource):
    """format("drive_bundle"): options path (a file or pattern that every executor sees), table, and t_from, t_until (nanoseconds) to read a part."""

    @classmethod
    def name(cls) -> str:
        return "drive_bundle"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return BundleReader(schema, dict(self.options))


def scan(spark: SparkSession, path: str, table: str, columns: str, **options: str) -> DataFrame:
    """One table of all bundles: drive_id (the file's name), seq (the row's place in its table) and the columns asked for."""
    spark.dataSource.register(BundleSource)
    return spark.read.format("drive_bundle").options(table=table, columns=f"drive_id STRING, seq BIGINT, {columns}", **options).option("path", path).load()


def read_kind(spark: SparkSession, path: str, table: str, **options: str) -> DataFrame:
    """The rows of one record kind, with lists nested and texts parsed. Bundles that lack its table have none."""
    from drivelake.sources import records

    k = KINDS[table]
    if k.children:
        parent = {"gnss_meas": "gnss_clock"}.get(table, table)
        clock = k.columns.split("STRUCT<", 1)[1].split(">", 1)[0].replace(":", "") if table == "gnss_meas" else ""
        parents = scan(spark, path, parent, f"t_ns BIGINT{', ' + clock if clock else ''}", **options)
        if clock:
            names = [c.split(" ")[0] for c in clock.split(", ")]
            parents = parents.select("drive_id", "seq", "t_ns", F.struct(*names).alias("clock"))
        children = {c: scan(spark, path, t, f"t_ns BIGINT, {fields}", **options) for c, (t, fields, _) in k.children.items()}
        return records.nested(table, parents, children)
    if table == "location":
        stored = k.columns.replace("extras MAP<STRING, STRING>", "extras_json STRING")
        extras = F.coalesce(F.from_json("extras_json", "MAP<STRING, STRING>"), F.create_map().cast("map<string,string>"))
        return scan(spark, path, table, f"t_ns BIGINT, {stored}", **options).withColumn("extras", extras).drop("extras_json")
    if table == "trust":
        rows = scan(spark, path, table, "t_ns BIGINT, source STRING, provider STRING, state STRING, confidence DOUBLE, reasons STRING, innovation_nis DOUBLE, implied_speed_mps DOUBLE", **options)
        return rows.withColumn("reasons", reasons_of_text(F.col("reasons")))
    if table == "estimate":
        numbers = "heading_rad DOUBLE, heading_std_rad DOUBLE, speed_mps DOUBLE, speed_std_mps DOUBLE"
        rows = scan(spark, path, table, f"t_ns BIGINT, estimator STRING, lat DOUBLE, lon DOUBLE, cov_ee DOUBLE, cov_en DOUBLE, cov_nn DOUBLE, {numbers}, mode STRING, confidence DOUBLE, hypotheses_json STRING", **options)
        cov = F.struct(*(F.col(f"cov_{x}").alias(x) for x in ("ee", "en", "nn")))
        kind = k.columns.rsplit("hypotheses ", 1)[1]
        alone = F.array(F.struct(F.lit(1.0).alias("weight"), "lat", "lon", cov.alias("cov")))
        rows = rows.withColumns({"cov": cov, "hypotheses": F.coalesce(F.from_json("hypotheses_json", kind), alone.cast(kind))})
        return rows.select("drive_id", "seq", "t_ns", *k.names)
    return scan(spark, path, table, f"t_ns BIGINT, {k.columns}", **options)


def reasons_of_text(text: Column) -> Column:
    """The reasons in a comma-separated text, without blank ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def read_bundles(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: read_kind(spark, path, t) for t in KINDS}
