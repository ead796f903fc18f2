"""Sharding (operator 10): largest differencing (Karmarkar-Karp) over indivisible groups of rows.

Law ``bytes``: the shards' byte sums are nearly equal, rows with equal text stay together.

* A row's size is the UTF-8 length of its text plus 8; null text counts as no bytes, and null and
  empty text are one group. Repeated rows stay rows; a null ``doc_id`` sorts first in its shard.
* Groups above 1/``large_share`` of a shard's even share are items of their own: there are at most
  ``shards * large_share`` of them at any corpus size. All other groups are pooled by hash of the
  text into ``cells`` cells. So the driver differences a list whose length has a fixed bound, and the
  differences left are below a cell's size whatever the corpus.
* If one group is larger than an even share, its shard is as large as that group and the others are
  levelled: groups are indivisible.
* Groups of equal size are taken in the order of their cells and digests, so reruns agree; very long texts are groups
  like others, and columns of other names do not matter.
* An empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest, slices, spread_row_number, table, text_of

SHARDS = 24


def difference(sizes: list[int], ways: int) -> list[int]:
    """The way of each item: repeatedly combine the two partial partitions of largest spread, oppositely ordered.

    A partial partition is a list of ``ways`` sums in falling order with the sub-partitions behind
    them; combining adds the largest sum of the one to the smallest of the other. Sub-partitions are
    kept as binary trees and walked once at the end.
    """
    if not sizes:
        return []
    if ways == 1:
        return [0] * len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [s] + [0] * (ways - 1), [i] + [None] * (ways - 1)))
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, sums, parts = heapq.heappop(heap)
        _, _, sums2, parts2 = heapq.heappop(heap)
        merged = []
        for s, p, s2, p2 in zip(sums, parts, reversed(sums2), reversed(parts2)):
            merged.append((s + s2, p if p2 is None else p2 if p is None else (p, p2)))
        merged.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], turn, [x[0] for x in merged], [x[1] for x in merged]))
        turn += 1
    way = [0] * len(sizes)
    for k, part in enumerate(heap[0][3]):
        todo = [part]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            elif x is not None:
                way[x] = k
    return way


def shard_rows(
    docs: DataFrame, shards: int = SHARDS, cells: int = 6_144, large_share: int = 256, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null)."""
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        digest(text).alias("gid"),
    )
    groups = rows.groupBy("gid").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    cell = F.pmod(F.xxhash64("gid"), F.lit(cells))
    total = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    bar = max(1, (total[0] or 0) // (shards * large_share))
    items = (
        groups.groupBy(F.when(F.col("bytes") > bar, F.col("gid")).alias("gid"), F.when(F.col("bytes") <= bar, cell).alias("cell"))
        .agg(F.sum("bytes").alias("bytes"))
        .orderBy(F.desc("bytes"), "cell", "gid")
        .collect()  # at most cells + shards * large_share rows
    )
    ways = difference([r.bytes for r in items], shards)
    # Both maps have a bounded length, so they may be broadcast.
    by_cell = spark.createDataFrame([(r.cell, w) for r, w in zip(items, ways) if r.gid is None], "cell bigint, cell_shard int")
    by_gid = spark.createDataFrame([(bytes(r.gid), w) for r, w in zip(items, ways) if r.gid is not None], "gid binary, gid_shard int")
    placed = (
        rows.withColumn("cell", cell)
        .join(F.broadcast(by_cell), "cell", "left")
        .join(F.broadcast(by_gid), "gid", "left")
        .withColumn("shard", F.coalesce("gid_shard", "cell_shard"))
        .withColumn("slice", F.pmod(F.xxhash64("doc_id", "size"), F.lit(slices(total[1]))).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "slice")
    )
    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    out = spread_row_number(placed, ["shard"], "slice", order, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
