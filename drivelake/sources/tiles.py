"""Road tile files: gzip, big-endian, one file a tile, read by the binary-file source and decoded in tasks."""

from __future__ import annotations

import gzip
import itertools
import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivelake.operators import roads

#: The first word of a tile file, its version, units of a degree.
MAGIC, VERSION, UNITS = 0x47505244, 1, 1e7
#: Ways that go back to Spark at once.
BATCH = 2000
WAY = "way_id BIGINT, node_ids ARRAY<BIGINT>, lats ARRAY<DOUBLE>, lons ARRAY<DOUBLE>, road_class STRING, oneway BOOLEAN, lanes INT, layer INT, name STRING"


def encode_tile(ways: list[dict]) -> bytes:
    """The bytes of a tile's ways, in order of way_id; places are whole units, halves go up."""
    text = lambda s: struct.pack(">H", len(b := s.encode())) + b
    unit = lambda x: math.floor(x * UNITS + 0.5)
    out = [struct.pack(">iii", MAGIC, VERSION, len(ways))]
    for w in sorted(ways, key=lambda w: w["way_id"]):
        out += [struct.pack(">q", w["way_id"]), text(w["road_class"]), struct.pack(">?bb", w["oneway"], w["lanes"], w["layer"]), text(w["name"]), struct.pack(">i", len(w["node_ids"]))]
        out += [struct.pack(">qii", n, unit(a), unit(b)) for n, a, b in zip(w["node_ids"], w["lats"], w["lons"])]
    return gzip.compress(b"".join(out), mtime=0)


def decode_tile(raw: bytes) -> list[dict]:
    """The ways of a tile file; another format or version is an error."""
    return list(ways_of_tile(raw))


def ways_of_tile(raw: bytes) -> Iterator[dict]:
    """The ways of a tile file one after another, as decode_tile gives them."""
    data, at = gzip.decompress(raw), 12
    magic, version, n = struct.unpack_from(">iii", data)
    if magic != MAGIC:
        raise ValueError("not a road tile")
    if version != VERSION:
        raise ValueError(f"road tile version {version}, expected {VERSION}")

    def take(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return out

    def text() -> str:
        nonlocal at
        (size,) = take(">H")
        at += size
        return data[at - size : at].decode()

    for _ in range(n):
        (way_id,), road_class, (oneway, lanes, layer), name, (m,) = take(">q"), text(), take(">?bb"), text(), take(">i")
        nodes = [take(">qii") for _ in range(m)]
        yield {"way_id": way_id, "node_ids": [x[0] for x in nodes], "lats": [x[1] / UNITS for x in nodes], "lons": [x[2] / UNITS for x in nodes], "road_class": road_class, "oneway": oneway, "lanes": lanes, "layer": layer, "name": name}


def write_tiles(ways: DataFrame, path: str) -> None:
    """One file r<iy>_<ix>.roads a tile, as the rows of a Parquet table (tile, content): every way goes to each tile that it passes through.

    Files themselves are written by whoever serves them; a task holds one tile's ways.
    """

    def pack(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return pa.table({"tile": [f"r{rows[0]['iy']}_{rows[0]['ix']}"], "content": [encode_tile(rows)]})

    both = ways.join(roads.tiles_of_ways(ways), "way_id")
    both.groupBy("iy", "ix").applyInArrow(pack, "tile string, content binary").write.parquet(path)


def decode_tiles(files: DataFrame) -> DataFrame:
    """The ways of tile files (tile, content), each once: that of the last tile by name. No shuffle but that by way; a task holds one tile and a batch of its ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for b in batches:
            for tile, raw in zip(b.column(0), b.column(1)):
                ways = ways_of_tile(raw.as_py())
                while rows := [{"tile": tile.as_py()} | w for w in itertools.islice(ways, BATCH)]:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    schema = files.sparkSession.createDataFrame([], f"tile STRING, {WAY}").schema
    ways = files.select("tile", "content").mapInArrow(run, schema)
    return roads.last_of_ways(ways, "tile").drop("tile")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Ways of a table that write_tiles has written."""
    return decode_tiles(spark.read.schema("tile string, content binary").parquet(path))


def read_tile_files(spark: SparkSession, path: str) -> DataFrame:
    """Ways of all *.roads files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.roads").option("recursiveFileLookup", "true").load(path)
    return decode_tiles(files.select(F.regexp_extract("path", r"([^/]+)\.roads$", 1).alias("tile"), "content"))
