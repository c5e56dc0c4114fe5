"""Shards of nearly equal size by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, work_folder

#: Groups above total / (shards * this) are scheduled one by one: at most shards * this of them.
SINGLE = 1000
#: Smaller groups are scheduled in bundles, shards * this many coarse and as many fine ones (1/16 of the groups).
BUNDLES = 256


def longest_first(items: list[tuple], shards: int) -> dict:
    """{key: shard} of (size, key) items: by size, the largest first, each to the least loaded shard (a heap).

    Ties go to the smaller key and to the smaller shard, so the result doesn't depend on the order of the items.
    """
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        out[key] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return out


def shard_by_size(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", overhead: int = 16, rows_per_slot_group: int = 50_000) -> DataFrame:
    """Put every row into one of the shards so that the shards' bytes are nearly equal and equal texts stay together.

    Returns key, size long (UTF-8 bytes of the text plus overhead; null counts as empty, and is of the group of empty
    texts), text_crc32 long, shard int, slot long (0, 1, ... in each shard).

    Large groups are scheduled one by one, the rest in bundles by a hash of the text: both are bounded in number by
    the parameters, whatever the input, so the schedule fits the driver and is sent to all tasks. Sums are made
    before the shuffle, so a group of a third of all rows is one number. Rows with equal or null keys each get a
    slot. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = work_folder(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        docs.select(
            F.col(key).alias("key"),
            (F.octet_length(body) + overhead).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("crc"),
            F.xxhash64(body).alias("g1"),
            F.xxhash64(F.lit(7), body, F.octet_length(body)).alias("g2"),
        ),
        work,
        "rows",
    )
    coarse = shards * BUNDLES
    at = F.xxhash64("g2", "g1")
    bundle = F.when(F.pmod(at, F.lit(16)) == 0, coarse + F.pmod(F.shiftright(at, 8), F.lit(coarse))).otherwise(F.pmod(F.shiftright(at, 8), F.lit(coarse))).cast("int")
    rows = rows.withColumn("bundle", bundle)
    groups = stored(rows.groupBy("g1", "g2", "bundle").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), work, "groups")
    total, count = groups.agg(F.sum("bytes"), F.sum("n")).first()
    limit = max(1, (total or 0) // (shards * SINGLE))
    single = groups.filter(F.col("bytes") > limit).select("g1", "g2", "bytes").collect()
    bundles = groups.filter(F.col("bytes") <= limit).groupBy("bundle").agg(F.sum("bytes").alias("bytes")).collect()
    plan = longest_first([(r.bytes, (0, r.g1, r.g2)) for r in single] + [(r.bytes, (1, r.bundle, 0)) for r in bundles], shards)
    by_group = spark.createDataFrame([(k[1], k[2], s) for k, s in plan.items() if k[0] == 0], "g1 long, g2 long, s1 int")
    by_bundle = spark.createDataFrame([(k[1], s) for k, s in plan.items() if k[0] == 1], "bundle int, s2 int")
    placed = (
        rows.join(F.broadcast(by_group), ["g1", "g2"], "left")
        .join(F.broadcast(by_bundle), "bundle", "left")
        .select("key", "size", "crc", F.coalesce("s1", "s2").alias("shard"))
    )
    # Slots: rows are numbered inside parts of a shard, each behind all rows of the parts before it.
    parts = min(4096, max(4, math.ceil((count or 0) / (shards * rows_per_slot_group))))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("key", "crc"), F.lit(parts)).cast("int"))
    sizes = placed.groupBy("shard", "part").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")
    offsets = sizes.select("shard", "part", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "crc"))
    return placed.join(F.broadcast(offsets), ["shard", "part"]).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + number - 1).cast("long").alias("slot")
    )
