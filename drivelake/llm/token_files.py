"""Token ids in compressed files, one wavelet matrix for each shard, with access, counting and occurrence lookup."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoder, work_folder

_MAGIC = b"WVM1"


class WaveletMatrix:
    """A sequence of ids below 2 ** bits as bit-planes, each stably sorted by the planes above it.

    access, rank and select take steps in the number of planes; ranks stand at every block of 512 bits.
    """

    BLOCK = 512

    def __init__(self, n: int, zeros: np.ndarray, planes: np.ndarray):
        self.n, self.zeros, self.planes, self.bits = n, zeros, planes, len(zeros)
        self._blocks: np.ndarray | None = None

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = 16) -> WaveletMatrix:
        seq = np.ascontiguousarray(ids, np.uint16 if bits <= 16 else np.uint32)
        zeros, planes = np.zeros(bits, np.int64), np.zeros((bits, (len(seq) + 7) // 8), np.uint8)
        for level in range(bits):
            one = (seq & seq.dtype.type(1 << (bits - 1 - level))) != 0
            planes[level] = np.packbits(one)
            low = np.compress(~one, seq)
            zeros[level] = len(low)
            seq = np.concatenate([low, np.compress(one, seq)])
        return cls(len(ids), zeros, planes)

    def to_bytes(self, level: int = 1) -> bytes:
        head = _MAGIC + np.array([self.n, self.bits], "<i8").tobytes() + self.zeros.astype("<i8").tobytes()
        return head + zstandard.ZstdCompressor(level=level).compress(self.planes.tobytes())

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        if raw[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, bits = np.frombuffer(raw, "<i8", 2, 4)
        zeros = np.frombuffer(raw, "<i8", int(bits), 20).copy()
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[20 + 8 * int(bits) :]), np.uint8)
        return cls(int(n), zeros, flat.reshape(int(bits), (int(n) + 7) // 8))

    def all_ids(self) -> np.ndarray:
        """Every id in order: planes are merged from the last to the first."""
        dtype = np.uint16 if self.bits <= 16 else np.uint32
        seq = np.zeros(self.n, dtype)
        for level in reversed(range(self.bits)):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            z = int(self.zeros[level])
            up = np.empty(self.n, dtype)
            np.place(up, ~one, seq[:z])
            np.place(up, one, seq[z:] | dtype(1 << (self.bits - 1 - level)))
            seq = up
        return seq

    def _rank1(self, level: int, at: int) -> int:
        """Ones among the first `at` bits of a plane."""
        if self._blocks is None:
            step = self.BLOCK // 8
            pop = np.bitwise_count(self.planes).astype(np.int64)
            pad = -pop.shape[1] % step
            sums = np.pad(pop, ((0, 0), (0, pad))).reshape(self.bits, -1, step).sum(2)
            self._blocks = np.concatenate([np.zeros((self.bits, 1), np.int64), np.cumsum(sums, 1)], 1)
        block, byte = at // self.BLOCK, at // 8
        ones = int(self._blocks[level, block]) + int(np.bitwise_count(self.planes[level, block * self.BLOCK // 8 : byte]).sum())
        if at % 8:
            ones += int(self.planes[level, byte] >> (8 - at % 8)).bit_count()
        return ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = int(self.planes[level, i // 8]) >> (7 - i % 8) & 1
            value = value << 1 | bit
            ones = self._rank1(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        for level in range(self.bits):
            a, b = self._rank1(level, low), self._rank1(level, high)
            z = int(self.zeros[level])
            low, high = (z + a, z + b) if value >> (self.bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, value: int, end: int) -> int:
        """How often a value occurs before place `end`."""
        low, high = self._range(value, end)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence (from 0)."""
        low, high = self._range(value, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for level in reversed(range(self.bits)):
            z, one = int(self.zeros[level]), value >> (self.bits - 1 - level) & 1
            want = (at - z if one else at) + 1
            a, b = 0, self.n  # the smallest prefix with so many such bits
            while a < b:
                m = (a + b) // 2
                ones = self._rank1(level, m)
                if (ones if one else m - ones) < want:
                    a = m + 1
                else:
                    b = m
            at = a - 1
        return at


FILE_SCHEMA = "part int, before long, first_id long, last_id long, n_docs long, n_tokens long, doc_ids binary, lengths binary, tokens binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, kind: str = "word", end_id: int = 2, key: str = "doc_id", text: str = "text", shard_tokens: int = 1 << 20, shard_count: int | None = None) -> None:
    """Encode every text, add end_id to each, and write the ids in ascending key order.

    The files are Parquet files whose rows are shards: the range partition they come from and the ids before them in
    it, the range of keys, the documents' keys and lengths, and one compressed wavelet matrix of about shard_tokens ids
    (always whole documents). Null texts are empty: only end_id.
    Rows with equal keys stay next to each other, in order of their text. Null keys come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, kind)
        part = TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        size = before = 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate([i for _, i in held])
            keys = np.array([-1 if k is None else k for k, _ in held], "<i8")
            lengths = np.array([len(i) for _, i in held], "<u4")
            pack = zstandard.ZstdCompressor(level=1).compress
            null = np.array([k is None for k, _ in held])
            values = [part, before, held[0][0], held[-1][0], len(held), len(ids), pack(keys.tobytes() + null.tobytes()), pack(lengths.tobytes()), WaveletMatrix.build(ids).to_bytes()]
            kinds = [pa.int32()] + [pa.int64()] * 5 + [pa.binary()] * 3
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)

        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).fill_null("")
            for at in range(0, len(keys), 2048):
                for k, ids in zip(keys[at : at + 2048], enc.encode(texts.slice(at, 2048))):
                    held.append((k, np.append(ids, np.uint16(end_id))))
                    size += len(ids) + 1
                    if size >= shard_tokens:
                        yield shard()
                        before, held, size = before + size, [], 0
        if held:
            yield shard()

    names = [x.split()[0] for x in FILE_SCHEMA.split(", ")]
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    ordered = rows.repartitionByRange(shard_count, "k") if shard_count else rows.repartitionByRange("k")
    ordered.sortWithinPartitions("k", "t").mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The documents in token files: key, start long (ids before it over all files), n_tokens long, ids_crc32 long and, if asked for, ids.

    Range partitions are in order of the key, and each shard knows the ids before it in its own: only one count for
    each partition is summed outside the tasks.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("part_start"))
    extra = ", ids binary" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        un = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for row in b.to_pylist():
                n = row["n_docs"]
                raw = un(row["doc_ids"])
                keys, null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, bool, n, 8 * n)
                lengths = np.frombuffer(un(row["lengths"]), "<u4").astype(np.int64)
                ids = WaveletMatrix.from_bytes(row["tokens"]).all_ids().astype("<u4")
                ends = np.cumsum(lengths)
                data = ids.tobytes()
                parts = [data[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), lengths.tolist())]
                out = [pa.array(keys, mask=null), pa.array(row["start"] + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = [key, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    # One row for each task that wrote: small enough to send to all.
    start = (F.col("part_start") + F.col("before")).alias("start")
    joined = files.join(F.broadcast(starts), "part").select("n_docs", "doc_ids", "lengths", "tokens", start)
    return joined.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long{extra}")


def count_tokens(spark: SparkSession, path: str, values: list[int]) -> DataFrame:
    """token, n: how often ids occur in token files. Each shard is asked by its ranks; one row a shard and id is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                m = WaveletMatrix.from_bytes(raw)
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array([m.count(v) for v in values], pa.int64())], ["token", "n"])

    found = spark.read.schema(FILE_SCHEMA).parquet(path).select("tokens").mapInArrow(run, "token long, n long")
    every = spark.createDataFrame([(v,) for v in dict.fromkeys(values)], "token long")
    return every.join(found.groupBy("token").agg(F.sum("n").alias("n")), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def find_token(spark: SparkSession, path: str, value: int, key: str = "doc_id") -> DataFrame:
    """key, place (from 0, in its document) of every occurrence of an id in token files, found by select; occurrences leave a task in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        un = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for row in b.to_pylist():
                m, n = WaveletMatrix.from_bytes(row["tokens"]), row["n_docs"]
                raw = un(row["doc_ids"])
                keys, null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, bool, n, 8 * n)
                ends = np.cumsum(np.frombuffer(un(row["lengths"]), "<u4").astype(np.int64))
                for first in range(0, m.count(value), 1 << 16):
                    at = np.array([m.select(value, k) for k in range(first, min(m.count(value), first + (1 << 16)))], np.int64)
                    doc = np.searchsorted(ends, at, "right")
                    yield pa.RecordBatch.from_arrays([pa.array(keys[doc], mask=null[doc]), pa.array(at - np.where(doc > 0, ends[doc - 1], 0))], [key, "place"])

    files = spark.read.schema(FILE_SCHEMA).parquet(path).select("n_docs", "doc_ids", "lengths", "tokens")
    return files.mapInArrow(run, f"`{key}` long, place long")


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the token files of all documents into the shared folder and read them back."""
    path = f"{work_folder(docs.sparkSession)}/tokens"
    write_token_files(docs, path, tokenizer, **options)
    return read_token_files(docs.sparkSession, path, options.get("key", "doc_id"))
