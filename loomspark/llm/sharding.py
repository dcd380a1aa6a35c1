"""Sharding by Karmarkar-Karp differencing.

Groups of equal texts are indivisible. A partial partition has one sum for each shard; the two with the largest
spread are combined again and again, the largest sum of one with the smallest of the other, which leaves a partition
whose shards differ little in bytes.

Scale: the groups are dealt by hash into chunks of about ``CHUNK`` and each chunk is differenced in one task; what is
left of a chunk is again a partial partition, so chunks are combined by the same rule, ``CHUNK`` at a time, until one
partition is left. The plan is then read backwards by joins from chunk to group to row. Nothing is gathered on the
driver, and a group with a third of all rows is one weight, summed before it is shuffled.

Law: ``bytes`` (sizes of shards near equal). Defined cases: a very long text is one weight, never split; a null text has size 1, no checksum, and is a group of its
own; the empty text is another; rows that repeat a doc_id are kept, each with its own slot; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SHARDS, CHUNK, SLOT_ROWS = 8, 20_000, 50_000


def difference(vectors: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """One partition of ``vectors`` (each a partial partition of the shards): its sums, and for each vector the shard
    to which each of its positions goes."""
    width = len(vectors[0])
    heap = []
    # A node of the tree of combinations: its children with the position that each of their positions takes.
    children: list[tuple] = [()] * len(vectors)
    for i, v in enumerate(vectors):
        heap.append((min(v) - max(v), i, v))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, v = heapq.heappop(heap)
        _, j, w = heapq.heappop(heap)
        down = sorted(range(width), key=lambda k: -v[k])
        up = sorted(range(width), key=lambda k: w[k])
        merged, to_v, to_w = [0] * width, [0] * width, [0] * width
        for place, (a, b) in enumerate(zip(down, up, strict=True)):
            merged[place], to_v[a], to_w[b] = v[a] + w[b], place, place
        heapq.heappush(heap, (min(merged) - max(merged), len(children), merged))
        children.append(((i, to_v), (j, to_w)))
    where: list = [None] * len(children)
    where[heap[0][1]] = list(range(width))
    for node in range(len(children) - 1, -1, -1):
        for child, to in children[node]:
            where[child] = [where[node][p] for p in to]
    return heap[0][2], where[: len(vectors)]


def _combine(shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", kind="stable")
        sums, where = difference([list(map(int, v)) for v in rows["sums"]])
        items = [*rows["item"], None]
        return pd.DataFrame({"chunk": rows["chunk"].iloc[0], "item": pd.array(items, dtype="Int64"), "sums": [*[None] * len(rows), sums], "places": [*where, None]})

    return run


def shard_groups(groups: DataFrame, shards: int = SHARDS, chunk: int = CHUNK) -> DataFrame:
    """``(item, shard)`` for ``groups(item, bytes)``."""
    zeros = F.array(*[F.lit(0).cast("long")] * (shards - 1))
    level = groups.select("item", F.concat(F.array(F.col("bytes").cast("long")), zeros).alias("sums"))
    left = groups.count()
    plans = []
    while left > 1 or not plans:
        chunks = max(1, -(-left // chunk))
        dealt = level.withColumn("chunk", F.pmod(F.xxhash64("item", F.lit(len(plans))), F.lit(chunks)))
        made = common.cut(dealt.groupBy("chunk").applyInPandas(_combine(shards), "chunk long, item long, sums array<long>, places array<int>"))
        plans.append(made.where("item is not null").select("item", "chunk", "places"))
        level = made.where("item is null").select(F.col("chunk").alias("item"), "sums")
        left = chunks if left else 0
        if chunks == 1:
            break
    out = None
    for below in reversed(plans):
        if out is None:
            out = below.select("item", "places")
        else:  # the places of a chunk, seen through those of the chunk that it became part of
            over = out.select(F.col("item").alias("chunk"), F.col("places").alias("over"))
            out = below.join(over, "chunk").select("item", F.transform("places", lambda p: F.element_at("over", p + 1)).alias("places"))
    return out.select("item", F.element_at("places", 1).alias("shard"))


def shards_of(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each of ``docs(doc_id, text)``: size, checksum, law, shard, slot, grown_shard."""
    # Equal texts share a digest, whose first 60 bits are the number of their group. Two groups that share a number, of
    # some billions, would be kept together as one; nothing else depends on it.
    sized = docs.select(F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), F.coalesce(F.md5("text"), F.lit("")).alias("digest"))
    sized = sized.withColumn("item", F.conv(F.substring(F.md5(F.concat(F.lit("g"), "digest")), 1, 15), 16, 10).cast("long"))
    sized = common.cut(sized.drop("digest"))
    groups = common.cut(sized.groupBy("item").agg(F.sum("size").alias("bytes")))
    shard = shard_groups(groups, shards)
    placed = sized.join(shard, "item")
    buckets = max(1, -(-sized.count() // SLOT_ROWS))
    placed = common.cut(placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "item"), F.lit(buckets))))
    totals = placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "item")
    out = placed.withColumn("turn", F.row_number().over(inside) - 1).join(offsets, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("turn") + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_of(common.table(spark, sf_dir, "documents"))
