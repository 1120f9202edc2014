"""Sharding by Karmarkar-Karp differencing over many machines.

Groups (equal texts) are indivisible. A partial partition is a vector of one load for each shard; the two with the largest
spread are combined, the heaviest shard of one with the lightest of the other, until one is left. To do this for any number of
groups, tasks first difference hashed chunks of groups into bundles, and bundles into fewer bundles, until at most `TOP` items
are left; these are differenced into the shards in one task. Items that are large for a bundle skip the lower levels, so
that they meet all others in the last one; at most SHARE * n_shards items can be large, whatever the input. So does a hashed
share of about FILL items, small ones that even out what whole bundles can't.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Items that one task differences, and bundles it makes of them.
CHUNK = 8192
BUNDLES = 96
#: Items left for the last task, besides large ones, and those among them that never were in a bundle.
TOP, FILL = 8192, 2048
#: An item is large when it holds more than 1 / (SHARE * n_shards) of all bytes.
SHARE = 64
#: Rows that one task numbers.
SLOTS = 100_000


def difference(sizes: list[int], k: int) -> list[int]:
    """Part (0 to k - 1) of each item, by Karmarkar-Karp differencing; ties go by item order."""
    n = len(sizes)
    if not n:
        return []
    loads: dict[int, np.ndarray] = {}
    heap = []
    for i, s in enumerate(sizes):
        v = np.zeros(k, np.int64)
        v[-1] = s
        loads[i] = v
        heap.append((-s, i))
    heapq.heapify(heap)
    merges, node = [], n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = loads.pop(a) + loads.pop(b)[::-1]
        order = np.argsort(both, kind="stable")
        both = both[order]
        both -= both[0]
        loads[node] = both
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(both[-1]), node))
        node += 1
    place: dict[int, np.ndarray] = {node - 1: np.arange(k)}
    for up in range(node - 1, n - 1, -1):  # place[x][j]: the final part of what x holds in its j-th part
        a, b, order = merges[up - n]
        here = np.empty(k, np.int64)
        here[order] = place.pop(up)
        place[a], place[b] = here, here[::-1]
    return [int(place[i][-1]) for i in range(n)]


def _differenced(parts: int, out: str):
    """(chunk, table of item, size) -> item and its part, in order of size and item."""

    def run(key, table):
        import pyarrow as pa

        item, size = table.column("item").to_pylist(), table.column("size").to_pylist()
        order = sorted(range(len(item)), key=lambda i: (-size[i], item[i]))
        part = difference([size[i] for i in order], parts)
        return pa.table({"item": pa.array([item[i] for i in order], pa.string()), "size": pa.array([size[i] for i in order], pa.int64()), out: pa.array([f"{key[0].as_py()}:{p}" for p in part] if out == "bundle" else part, pa.string() if out == "bundle" else pa.int32())})

    return run


def assign(scratch: Scratch, groups: DataFrame, n_shards: int) -> DataFrame:
    """groups (item string, size long), one row an item -> (item, shard int)."""
    total, n = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    least = total // (SHARE * n_shards)
    fill = F.pmod(F.xxhash64("item", F.lit(-1)), F.lit(1 << 30)) < int(min(1.0, FILL / max(1, n)) * (1 << 30))
    items, levels = groups.withColumn("alone", fill | (F.col("size") > least)), []
    while n > TOP + SHARE * n_shards:
        small = items.where(~F.col("alone"))
        n_chunks = max(1, math.ceil(n / CHUNK))
        level = len(levels)
        chunk = F.concat(F.lit(f"{level}-"), F.pmod(F.xxhash64("item", F.lit(level)), F.lit(n_chunks)).cast("string"))
        done = scratch.write(small.select("item", "size", chunk.alias("chunk")).groupBy("chunk").applyInArrow(_differenced(BUNDLES, "bundle"), "item string, size long, bundle string"))
        levels.append(done.select("item", "bundle"))
        bundles = done.groupBy("bundle").agg(F.sum("size").alias("size")).select(F.col("bundle").alias("item"), "size", (F.col("size") > least).alias("alone"))
        items = scratch.write(items.where("alone").unionByName(bundles))
        before, n = n, items.count()
        if n >= before:
            break
    last = items.select("item", "size", F.lit("top").alias("chunk")).groupBy("chunk").applyInArrow(_differenced(n_shards, "shard"), "item string, size long, shard int")
    shard = scratch.write(last.select("item", "shard"))
    for below in reversed(levels):
        # an item of the level below is either in a bundle or went past it
        inside = below.join(shard.withColumnRenamed("item", "bundle"), "bundle").select("item", "shard")
        shard = scratch.write(inside.unionByName(shard.join(below.select(F.col("bundle").alias("item")).distinct(), "item", "left_anti")))
    return shard


def sharded(docs: DataFrame, n_shards: int) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot.

    Equal texts are one group and stay in one shard; a null text counts as the empty one (size 8) and is of its group. Shards'
    byte sizes are near equal, as far as the largest group lets them be. Slots are gapless from 0 in each shard, in order of
    a hash of doc_id and text_crc32, then of the two; rows that repeat both each get a slot, which one is left open. Groups of one
    size go by the md5 of their text. Whole texts count, however long. Other columns are ignored; an empty table gives an empty
    table.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("item"))
    rows = scratch.write(rows)
    groups = scratch.write(rows.groupBy("item").agg(F.sum("size").alias("size")))
    shard = assign(scratch, groups, n_shards)
    placed = rows.join(shard, "item").select("doc_id", "size", "text_crc32", "shard")
    n_parts = max(1, math.ceil(rows.count() / (n_shards * SLOTS)) * 8)
    placed = scratch.write(placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_parts)).cast("int")))
    counts = placed.groupBy("shard", "part").count()  # n_shards * n_parts rows
    before = counts.withColumn("first", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "part", "first")
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    numbered = placed.withColumn("at", at).join(before, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at") - 1).cast("long").alias("slot"))
