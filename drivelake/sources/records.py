"""Drives as tables of records: nesting, the union of all kinds in canonical order, JSON lines, CSV and logger text.

A set of tables is a dict from table name to DataFrame with the columns of schema.KINDS (drive_id, seq, t_ns first); kinds that a set
lacks count as empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drivelake.functions import geo
from drivelake.operators.tables import nest_by_time
from drivelake.sources.schema import KINDS, Kind, json_name, json_type, split_columns, without_default


def nested(kind: str, parents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """A list-shaped kind from its flat tables: parents drive, children of the same drive and time follow in order of seq, none gives an empty list."""
    out = parents
    for column, (_, fields, _) in KINDS[kind].children.items():
        out = nest_by_time(out, children[column], [c.split(" ")[0] for c in fields.split(", ")], column)
    return out


def tagged(tables: dict[str, DataFrame], kinds: list[Kind]) -> DataFrame:
    """drive_id, t_ns, rank, seq, type and one struct column a kind (null in rows of other kinds)."""
    out = None
    for k in kinds:
        if k.table not in tables:
            continue
        rows = tables[k.table].select("drive_id", "t_ns", F.lit(k.rank).alias("rank"), "seq", F.lit(k.name).alias("type"), F.struct(*k.names).alias(k.table))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no table of these kinds")
    return out


def measurements(tables: dict[str, DataFrame]) -> DataFrame:
    """All pipeline inputs of each drive in canonical order (t_ns, rank, seq): one shuffle by drive, sorted inside partitions."""
    rows = tagged(tables, [k for k in KINDS.values() if k.measurement])
    return rows.repartition("drive_id").sortWithinPartitions("drive_id", "t_ns", "rank", "seq")


def all_records(tables: dict[str, DataFrame]) -> DataFrame:
    """Every record of each drive: session and sensor descriptions first, then the rest in canonical order. head: 0, 1 or 2."""
    rows = tagged(tables, list(KINDS.values()))
    head = F.when(F.col("rank") < 2, F.col("rank")).otherwise(2)
    return rows.withColumn("head", head).repartition("drive_id").sortWithinPartitions("drive_id", "head", "t_ns", "rank", "seq")


# JSON lines


def _members(names: list[str], change: Callable[[Column, str], Column]) -> Callable[[Column], Column]:
    return lambda x: F.struct(*(change(x[n], n).alias(n) for n in names))


def to_json_lines(tables: dict[str, DataFrame], with_drive: bool = False) -> DataFrame:
    """drive_id, t_ns, rank, seq, value: one JSON text a record, with nulls and default values left out. with_drive: each tells its drive, "drive":{"id":...}."""
    out = None
    for k in KINDS.values():
        if k.table not in tables:
            continue
        columns: list[Column] = [F.lit(k.name).alias("type"), F.col("t_ns").alias("tNs")]
        for c in split_columns(k.columns):
            name = c.split(" ", 1)[0]
            value = F.col(name)
            if name in k.defaults:
                value = without_default(value, k.defaults[name])
            elif name in k.children:
                _, fields, defaults = k.children[name]
                names = [f.split(" ")[0] for f in fields.split(", ")]
                value = F.transform(value, _members(names, lambda c, n, d=defaults: without_default(c, d[n]) if n in d else c))
            columns.append(value.cast(json_type(c).split(": ", 1)[1]).alias(json_name(name)))
        if k.table == "gnss_meas":  # an empty list is its default
            columns[-1] = F.when(F.size("agc") > 0, columns[-1]).alias("agc")
        if with_drive:
            columns.insert(1, F.struct(F.col("drive_id").cast("string").alias("id")).alias("drive"))
        rows = tables[k.table].select("drive_id", "t_ns", F.lit(k.rank).alias("rank"), "seq", F.to_json(F.struct(*columns)).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no table")
    return out


def write_json_lines(tables: dict[str, DataFrame], path: str, packed: bool = False) -> None:
    """Text files under path/drive_id=<id>/, each drive's lines in canonical order. packed: whole drives share files path/part-*, and each line tells its drive;
    for many small drives, whose files would cost more than their lines."""
    rows = to_json_lines(tables, with_drive=packed).repartition("drive_id").sortWithinPartitions("drive_id", "t_ns", "rank", "seq")
    if packed:
        rows.select("value").write.mode("overwrite").text(path)
    else:
        rows.select("drive_id", "value").write.mode("overwrite").partitionBy("drive_id").text(path)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """drive_id, seq, type, value of every line that isn't blank. A drive is a folder drive_id=<id> or a file <id>.jsonl, or what a line of a packed file part-* tells; seq grows with the place in its file."""
    m = F.col("_metadata")
    name = F.regexp_extract(m["file_path"], r"drive_id=([^/]+)/", 1)
    own = F.when(F.startswith(m["file_name"], F.lit("part-")), F.from_json("value", "drive STRUCT<id: STRING>", {"allowNonNumericNumbers": "true"})["drive"])
    drive = F.when(name != "", name).when(own.isNotNull(), own["id"]).otherwise(F.regexp_extract(m["file_name"], r"^(.*?)(?:\.jsonl)?(?:\.gz)?$", 1))
    # A block that fills a split has it for itself, so row numbers never reach the next block's first byte.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = lines.select(drive.alias("drive_id"), (m["file_block_start"] + row).alias("seq"), "value").filter(F.trim("value") != "")
    return lines.select("drive_id", "seq", F.from_json("value", "type STRING", {"allowNonNumericNumbers": "true"})["type"].alias("type"), "value")


def parse_kind(lines: DataFrame, table: str) -> DataFrame:
    """The rows of one kind: unknown keys are ignored, lacking ones get their defaults, lists are never null."""
    k = KINDS[table]
    parsed = F.from_json("value", f"STRUCT<tNs: BIGINT, {json_type(k.columns)}>", {"allowNonNumericNumbers": "true"})
    # A text without the kind's name is of another kind unless it spells letters by escapes: most lines needn't be parsed for their type.
    likely = F.col("value").contains(k.name) | F.col("value").contains("\\")
    rows = lines.filter(likely).filter(F.col("type") == k.name).select("drive_id", "seq", parsed.alias("_r"))
    columns = []
    for c in split_columns(k.columns):
        name, kind = c.split(" ", 1)
        value = F.col(f"_r.{json_name(name)}").cast(kind)
        if name in k.children:
            _, fields, defaults = k.children[name]
            names = [f.split(" ")[0] for f in fields.split(", ")]
            value = F.transform(F.coalesce(value, F.array().cast(kind)), _members(names, lambda c, n, d=defaults: F.coalesce(c, F.lit(d[n])) if n in d else c))
        elif name in k.defaults:
            empty = k.defaults[name]
            value = F.coalesce(value, F.create_map().cast(kind) if empty == {} else F.lit(empty))
        columns.append(value.alias(name))
    return rows.select("drive_id", "seq", F.col("_r.tNs").alias("t_ns"), *columns)


def read_json_lines(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All kinds of the drives under a path. Lines of an unknown type are in no table."""
    lines = json_lines(spark, path)
    return {t: parse_kind(lines, t) for t in KINDS}


# CSV and logger text


def _text(c: Column, kind: str) -> Column:
    """A value as the exports spell it: null is empty, truth is 1 or 0, texts are quoted only where they must be."""
    if kind == "BOOLEAN":
        c = c.cast("int").cast("string")
    elif kind == "STRING":
        c = F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def _columns_of(table: str, leave_out: tuple[str, ...] = ()) -> list[tuple[str, str, Column]]:
    return [("t_ns", "BIGINT", F.col("t_ns"))] + [(n, k, F.col(n)) for n, k in (c.split(" ", 1) for c in split_columns(KINDS[table].columns)) if n not in leave_out]


def _member_columns(fields: str, leave_out: tuple[str, ...] = ()) -> list[tuple[str, str, Column]]:
    return [("t_ns", "BIGINT", F.col("t_ns"))] + [(n, k, F.col(f"_m.{n}")) for n, k in (c.split(" ") for c in fields.split(", ")) if n not in leave_out]


def csv_tables(tables: dict[str, DataFrame]) -> dict[str, tuple[str, DataFrame]]:
    """Export name -> (header, lines with drive_id, t_ns, seq, pos, value). Kinds without a table are left out; so are session, sensor_info, provider_event, nmea, gnss_meas and geomag."""
    out: dict[str, tuple[str, DataFrame]] = {}

    def add(name: str, rows: DataFrame, columns: list[tuple[str, str, Column]]) -> None:
        value = F.concat_ws(",", *(_text(c, k) for _, k, c in columns))
        pos = F.col("_pos") if "_pos" in rows.columns else F.lit(0)
        out[name] = ",".join(n for n, _, _ in columns), rows.select("drive_id", "t_ns", "seq", pos.alias("pos"), value.alias("value"))

    for t in ("location", "imu", "orientation", "obd_raw", "power", "vehicle_speed", "annotation"):
        if t in tables:
            add(t, tables[t], _columns_of(t, ("extras",)))
    for name, t, leave_out in (("gnss_sat", "gnss_status", ("has_ephemeris", "has_almanac", "baseband_cn0_dbhz")), ("cell", "cell_scan", ()), ("wifi", "wifi_scan", ())):
        if t in tables:
            column, (_, fields, _) = next(iter(KINDS[t].children.items()))
            add(name, tables[t].select("drive_id", "t_ns", "seq", F.posexplode(column).alias("_pos", "_m")), _member_columns(fields, leave_out))
    if "trust" in tables:
        columns = [(n, k if n != "reasons" else "STRING", F.array_join(c, "|") if n == "reasons" else c) for n, k, c in _columns_of("trust")]
        add("trust", tables["trust"], columns)
    if "estimate" in tables:
        c, number = F.col, "DOUBLE"
        spread = geo.cov_sigma(c("cov.ee"), c("cov.nn")) * geo.R68_PER_SIGMA
        columns = [("t_ns", "BIGINT", c("t_ns")), ("estimator", "STRING", c("estimator")), ("lat", number, c("lat")), ("lon", number, c("lon")), ("accuracy_m", number, spread)]
        columns += [(f"cov_{x}", number, c(f"cov.{x}")) for x in ("ee", "en", "nn")] + [("heading_deg", number, F.degrees("heading_rad")), ("heading_std_deg", number, F.degrees("heading_std_rad"))]
        columns += [(n, number, c(n)) for n in ("speed_mps", "speed_std_mps")] + [("mode", "STRING", c("mode")), ("confidence", number, c("confidence"))]
        add("estimate", tables["estimate"], columns)
    return out


def write_csv(tables: dict[str, DataFrame], path: str) -> list[str]:
    """One folder a kind that has rows, path/<name>/drive_id=<id>/: a header line, then the drive's rows in order. Returns the names written."""
    written = []
    for name, (header, lines) in csv_tables(tables).items():
        if lines.isEmpty():
            continue
        first = lines.select("drive_id").distinct().select("drive_id", F.lit(None).cast("long").alias("t_ns"), F.lit(None).cast("long").alias("seq"), F.lit(-1).alias("pos"), F.lit(header).alias("value"))
        rows = lines.unionByName(first).repartition("drive_id").sortWithinPartitions("drive_id", F.col("t_ns").asc_nulls_first(), "seq", "pos")
        rows.select("drive_id", "value").write.mode("overwrite").partitionBy("drive_id").text(f"{path}/{name}")
        written.append(name)
    return written


def wall_ms(t_ns: Column, anchor_elapsed_ns: Column, anchor_wall_ms: Column) -> Column:
    """Wall clock of a monotonic time; the division drops what is beyond the millisecond, towards zero."""
    return anchor_wall_ms + geo.whole_div(t_ns - anchor_elapsed_ns, 1_000_000)


def logger_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """drive_id, t_ns, rank, seq, pos, value: lines of the raw-measurement text format, in their canonical order after the header.

    Wall times come from the drive's first session; without one the field is empty.
    """
    w = Window.partitionBy("drive_id").orderBy("t_ns", "seq")
    anchors = None
    if "session" in tables:
        anchors = tables["session"].withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("drive_id", "anchor_elapsed_ns", "anchor_wall_ms")

    def line(rows: DataFrame, rank: int, parts: list, pos: Column) -> DataFrame:
        rows = rows.join(anchors, "drive_id", "left") if anchors is not None else rows.withColumns({"anchor_elapsed_ns": F.lit(None).cast("long"), "anchor_wall_ms": F.lit(None).cast("long")})
        rows = rows.withColumn("_utc", wall_ms(F.col("t_ns"), F.col("anchor_elapsed_ns"), F.col("anchor_wall_ms")))
        texts = [p if isinstance(p, Column) else F.col(p) if p else F.lit("") for p in parts]
        return rows.select("drive_id", "t_ns", F.lit(rank).alias("rank"), "seq", pos.alias("pos"), F.concat_ws(",", *(F.coalesce(x.cast("string"), F.lit("")) for x in texts)).alias("value"))

    flag = lambda c: F.col(c).cast("int")
    out = []
    if "gnss_meas" in tables:
        g = tables["gnss_meas"]
        clock = [f"clock.{c.split(' ')[0]}" for c in CLOCK_COLUMNS]
        m = [f"_m.{x}" if x else "" for x in ("svid", "time_offset_nanos", "state", "received_sv_time_nanos", "received_sv_time_unc_nanos", "cn0_dbhz", "pseudorange_rate_mps", "pseudorange_rate_unc_mps", "adr_state", "adr_m", "adr_unc_m",
                                              "carrier_hz", "", "", "", "multipath", "snr_db", "constellation", "agc_db", "baseband_cn0_dbhz", "", "", "", "", "code_type")]
        raw = g.select("drive_id", "t_ns", "seq", "clock", F.posexplode("meas").alias("_p", "_m"))
        out.append(line(raw, 6, [F.lit("Raw"), "_utc", *clock, *m, "t_ns"], F.col("_p")))
        agc = g.select("drive_id", "t_ns", "seq", "clock", F.posexplode("agc").alias("_p", "_m"))
        out.append(line(agc, 6, [F.lit("Agc"), "_utc", *clock, "_m.level_db", "_m.carrier_hz", "_m.constellation"], F.col("_p") + (1 << 20)))
    if "location" in tables:
        parts = [F.lit("Fix"), F.upper("provider"), "lat", "lon", "alt_m", "speed_mps", "h_acc_m", "bearing_deg", "wall_time_ms", "speed_acc_mps", "bearing_acc_deg", "t_ns", "v_acc_m", F.coalesce(flag("is_mock"), F.lit(0))]
        out.append(line(tables["location"], 13, parts, F.lit(0)))
    if "gnss_status" in tables:
        sats = tables["gnss_status"].select("drive_id", "t_ns", "seq", F.size("sats").alias("_n"), F.posexplode("sats").alias("_p", "_m"))
        parts = [F.lit("Status"), "_utc", "_n", "_p", "_m.constellation", "_m.svid", "_m.carrier_hz", "_m.cn0_dbhz", "_m.az_deg", "_m.elev_deg", flag("_m.used_in_fix"), flag("_m.has_almanac"), flag("_m.has_ephemeris"), "_m.baseband_cn0_dbhz"]
        out.append(line(sats, 5, parts, F.col("_p")))
    if "imu" in tables:
        tag = F.when(F.col("kind") == "ACCEL_UNCAL", "UncalAccel").when(F.col("kind") == "GYRO_UNCAL", "UncalGyro").when(F.col("kind") == "MAG_UNCAL", "UncalMag")
        parts = [tag, "_utc", "t_ns", "x", "y", "z", *(F.coalesce(b, F.lit(0.0)) for b in ("bx", "by", "bz"))]
        out.append(line(tables["imu"].filter(F.col("kind").isin("ACCEL_UNCAL", "GYRO_UNCAL", "MAG_UNCAL")), 3, parts, F.lit(0)))
    if "orientation" in tables:
        out.append(line(tables["orientation"], 4, [F.lit("OrientationDeg"), "_utc", "t_ns", *geo.euler_deg(*(F.col(f"q{x}") for x in "wxyz"))], F.lit(0)))
    lines = out[0]
    for x in out[1:]:
        lines = lines.unionByName(x)
    return lines


CLOCK_COLUMNS = "time_nanos,leap_second,time_unc_nanos,full_bias_nanos,bias_nanos,bias_unc_nanos,drift_nsps,drift_unc_nsps,hw_clock_discontinuity_count".split(",")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of drives by the path's extension: .jsonl (a file or a pattern), .sqlite or .db bundles, else a folder of Parquet tables by kind.

    Kinds that a folder lacks are empty tables; a folder with none of them is an error.
    """
    from drivelake.sources.bundle import read_bundles

    if path.rstrip("/").endswith((".jsonl", ".jsonl.gz")):
        return read_json_lines(spark, path)
    if path.endswith((".sqlite", ".db", ".drive")):
        return read_bundles(spark, path)
    found = [t for t in KINDS if _exists(spark, f"{path}/{t}")]
    if not found:
        raise FileNotFoundError(f"no record tables below {path}")
    return {t: spark.read.schema(k.ddl).parquet(f"{path}/{t}").select(*_columns(k)) if t in found else spark.createDataFrame([], k.ddl) for t, k in KINDS.items()}


def _columns(kind: Kind) -> list[str]:
    """All columns in their own order: partition columns come last from a read."""
    return ["drive_id", "seq", "t_ns", *kind.names]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def save(tables: dict[str, DataFrame], path: str, packed: bool = False) -> None:
    """Replaces the kinds that tables hold at the path: JSON lines for .jsonl (packed: many drives a file), else a folder of Parquet tables by kind, each partitioned by drive.

    Parquet tables are all written aside and then take their places, so tables that were loaded from the path may be saved to it.
    """
    if path.rstrip("/").endswith(".jsonl"):
        write_json_lines(tables, path, packed)
        return
    aside = f"_new-{uuid.uuid4().hex}"
    for t, df in tables.items():
        df.repartition("drive_id").write.partitionBy("drive_id").parquet(f"{path}/{aside}/{t}")
    for t, df in tables.items():
        spark = df.sparkSession
        new, old = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (f"{path}/{aside}/{t}", f"{path}/{t}"))
        fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(old, True)
        if not fs.rename(new, old):
            raise OSError(f"{new} could not become {old}")
        fs.delete(new.getParent(), False) if not fs.listStatus(new.getParent()) else None


def route(estimates: DataFrame, fixes: DataFrame, max_acc_m: float = 100.0) -> DataFrame:
    """drive_id, t_ns, seq, lat, lon, from_estimates: a drive's estimates if it has any, else its real satellite and fused fixes of at most max_acc_m (or unknown accuracy)."""
    ours = estimates.select("drive_id", "t_ns", "seq", "lat", "lon", F.lit(True).alias("from_estimates"))
    real = fixes.filter(F.col("source").isin("GNSS", "FUSED") & ~F.col("is_mock") & (F.col("h_acc_m").isNull() | (F.col("h_acc_m") <= max_acc_m)))
    lacking = real.join(ours.select("drive_id").distinct(), "drive_id", "left_anti")
    return ours.unionByName(lacking.select("drive_id", "t_ns", "seq", "lat", "lon", F.lit(False).alias("from_estimates")))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth samples of JSON files that hold one array each: drive_id (the file's name), t_ns, seq, lat, lon, bearing_deg (null where it isn't a number), speed_mps."""
    rows = spark.read.schema("tNs BIGINT, lat DOUBLE, lon DOUBLE, bearingDeg DOUBLE, speedMps DOUBLE").option("multiLine", "true").option("allowNonNumericNumbers", "true").json(path)
    drive = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1)
    return rows.select(drive.alias("drive_id"), F.col("tNs").alias("t_ns"), F.monotonically_increasing_id().alias("seq"), "lat", "lon", F.nanvl(F.col("bearingDeg"), F.lit(None).cast("double")).alias("bearing_deg"), F.col("speedMps").alias("speed_mps"))


def register_views(tables: dict[str, DataFrame]) -> None:
    """Temporary views by table name, for queries in SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
