"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of a source's documents, in a seeded order of the documents, make one stream. A block is one word, the finest
equal block, so that quotas meet the targets whatever the smallest source. The highest quotients target / (2 i + 1) get
the seats, and shard j of the mix has for each source what the first j shares of the seats add to the first j - 1 (the
method never takes a seat away when there are more). The shards then select their blocks one after the other: shard j
goes on in each source's stream where shard j - 1 ended, from the start again after the last word, so a source's quota
of q of its n words is q // n passes over the stream and its first q % n words, a sample as the order is seeded.

Documents stay whole: one belongs to the shard in which it starts, and at the end of a source's quota a document of at
most a block share's words is taken or left, whichever is nearer; a longer one is cut there. No word is taken more than
once a pass, and but for the targets no source has an influence on what is taken of another.

Work: no row is moved. The order is a hash of (doc_id, text); the sizes are summed by (source, leading bits of the hash),
the ends of the shards are looked up in these sums, and only the rows of the few ranges of the hash that hold an end
are sorted to find the document there. Every row is then placed by comparing its hash with the ends of its source. The
driver sees one row for each source (name, size, ends); the table of sources is broadcast while it is small.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, the last; rows that repeat a
doc_id count each, and rows that repeat it with the same text are numbered where an end falls among them; an empty table
gives an empty result; sources of size 0 have target 0; very long texts are counted and cut in the JVM; other columns
are ignored by the query and kept by ``mixed_texts``, whatever their names.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SEED, SHARDS, WEIGHTS, MOST = 20260, 8, (1, 2, 3), 3
#: The end of a quota cuts documents of more words than this share of their source, or than so many.
BLOCK_SHARE, BLOCK_MOST = 256, 1024
#: The leading bits of the order by which sizes are summed; sources whose table is broadcast.
RANGE_BITS, BROADCAST_SOURCES = 12, 10_000
WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"
PLAN = "_name string, _source int, source_size long, target double, quota long, _block long, _ends array<struct<turn:long,key:long,copy:long,part:long>>"


def targets(sizes: list[int], weights: list[int]) -> list[float]:
    """Shares of the total by weight; what exceeds ``MOST`` times a source's size goes to the others by weight."""
    total, out, free = sum(sizes), [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s}
    out_of = float(total)
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if out_of * weights[i] / whole > MOST * sizes[i]]
        if not over:
            for i in free:
                out[i] = out_of * weights[i] / whole
            break
        for i in over:
            out[i] = float(MOST * sizes[i])
            free.discard(i)
        out_of = total - sum(out)
    return out


def sainte_lague(shares: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by the highest quotients share / (2 i + 1), at most ``most`` for each; ties to the first.

    With n sources, the divisor total / (seats - n) hands out fewer seats than there are, and these are the first by
    quotient; the last ones, 1.5 n at most, come from a queue."""
    if seats <= 0 or not any(shares):
        return [0] * len(shares)
    total = sum(shares)
    sure = max(0, seats - len(shares)) / total
    got = [min(m, math.floor(s * sure + 0.5) if sure else 0) for s, m in zip(shares, most, strict=True)]
    queue = [(-s / (2 * g + 1), i) for i, (s, g, m) in enumerate(zip(shares, got, most, strict=True)) if s and g < m]
    heapq.heapify(queue)
    left = seats - sum(got)
    while left > 0 and queue:
        _, i = heapq.heappop(queue)
        got[i] += 1
        left -= 1
        if got[i] < most[i]:
            heapq.heappush(queue, (-shares[i] / (2 * got[i] + 1), i))
    return got


def plan(sources: list[tuple[str | None, int]]) -> list[dict]:
    """For each (source, size): its target, block, quota in words, and the quotas of the shards."""
    ordered = sorted(sources, key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [s for _, s in ordered]
    shares = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
    seats, most = round(sum(shares)), [MOST * s for s in sizes]
    shards, before = [], [0] * len(sizes)
    for j in range(1, SHARDS + 1):
        now = sainte_lague(shares, seats * j // SHARDS, most)
        shards.append([b - a for a, b in zip(before, now, strict=True)])
        before = now
    out = []
    for i, (name, size) in enumerate(ordered):
        out.append({"name": name, "source_size": size, "target": shares[i], "block": max(1, min(BLOCK_MOST, size // BLOCK_SHARE)), "quota": before[i], "shards": [s[i] for s in shards]})
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``, the place of a document in the seeded order of its source."""
    return docs.withColumn("_key", F.xxhash64(F.lit(SEED), "doc_id", "text"))


def words_of(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def placed(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """``rows(source, _key, ...)`` with its source's plan, ``_copy`` (its number among equal rows, where that matters),
    ``times`` (how often it is taken whole) and ``_part`` (words of one more time, of a document that is cut).

    ``sized(source, _key, size)`` is read twice: for the sums, and in the ranges that hold the end of a shard."""
    spark, reach = rows.sparkSession, F.shiftright("_key", 64 - RANGE_BITS)
    sums = common.cut(sized.groupBy("source", reach.alias("_range")).agg(F.sum("size").alias("_sum")))
    plans = plan([(r["source"], r["size"]) for r in sums.groupBy("source").agg(F.sum("_sum").alias("size")).collect()])
    wanted = []  # (source, shard, words of the source before the shard's end)
    for i, p in enumerate(plans):
        up_to = 0
        for j, quota in enumerate(p["shards"]):
            up_to += quota
            if p["source_size"]:
                wanted.append((p["name"], i, j, up_to % p["source_size"]))
    ends = spark.createDataFrame(wanted, "_name string, _source int, _shard int, _rest long")
    ends = F.broadcast(ends) if len(plans) <= BROADCAST_SOURCES else ends
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = sums.withColumn("_before", before).join(ends, F.col("source").eqNullSafe(F.col("_name"))).where("_rest >= _before and _rest < _before + _sum")
    found = common.cut(found.select("_name", "_source", "_shard", "_range", (F.col("_rest") - F.col("_before")).alias("_rest")))
    ranges = found.select("_name", "_source", "_range").distinct()
    near = sized.withColumn("_at", reach).join(F.broadcast(ranges) if len(plans) <= BROADCAST_SOURCES else ranges, F.col("source").eqNullSafe(F.col("_name")) & (F.col("_at") == F.col("_range")))
    inside = Window.partitionBy("_source", "_range").orderBy("_key", "size")
    lined = near.select("_source", "_range", "_key", "size", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.row_number().over(Window.partitionBy("_source", "_range", "_key").orderBy("size")).alias("_copy"), F.count("*").over(Window.partitionBy("_source", "_range", "_key")).alias("_many"))
    hits = lined.join(F.broadcast(found.drop("_name")) if len(plans) <= BROADCAST_SOURCES else found.drop("_name"), ["_source", "_range"]).where("_rest >= _start and _rest < _start + size")
    of_source: dict[int, dict[int, tuple]] = {}
    repeated = False
    for r in hits.select("_source", "_shard", "_key", "_copy", "_many", (F.col("_rest") - F.col("_start")).alias("_part")).collect():
        of_source.setdefault(r["_source"], {})[r["_shard"]] = (r["_key"], r["_copy"], r["_part"])
        repeated = repeated or r["_many"] > 1
    table = []
    for i, p in enumerate(plans):
        up_to, marks = 0, []
        for j, quota in enumerate(p["shards"]):
            up_to += quota
            marks.append((up_to // p["source_size"] if p["source_size"] else 0, *of_source.get(i, {}).get(j, (-(1 << 63), 0, 0))))
        table.append((p["name"], i, p["source_size"], p["target"], p["quota"], p["block"], marks))
    told = spark.createDataFrame(table, PLAN)
    out = rows.join(F.broadcast(told) if len(plans) <= BROADCAST_SOURCES else told, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    if repeated:  # number the equal rows at the ends; no other row needs a number
        at_end = F.exists("_ends", lambda e: e["key"] == F.col("_key"))
        turn = F.row_number().over(Window.partitionBy("_source", "_key").orderBy(F.xxhash64(*rows.columns)))
        out = out.where(~at_end).withColumn("_copy", F.lit(1)).unionByName(out.where(at_end).withColumn("_copy", turn))
    else:
        out = out.withColumn("_copy", F.lit(1))
    last = F.element_at("_ends", -1)
    here = F.struct(F.col("_key").alias("key"), F.col("_copy").cast("long").alias("copy"))
    end = F.struct(last["key"].alias("key"), last["copy"].alias("copy"))
    return out.withColumns({"_at_end": (here == end) & (last["part"] > 0), "_before_end": here < end})


def takes(size: Column) -> tuple[Column, Column]:
    """(times that a document is taken whole, words of one time more), from the columns of ``placed``."""
    last = F.element_at("_ends", -1)
    small = size <= F.col("_block")
    more = F.when(F.col("_before_end"), 1).when(F.col("_at_end") & small & (2 * last["part"] >= size), 1).otherwise(0)
    return (F.when(size > 0, last["turn"] + more).otherwise(0)).cast("long"), F.when(F.col("_at_end") & ~small, last["part"]).otherwise(0).cast("long")


#: The shards of the mix that a document is in, one for each time that it is taken: those whose end lies before it.
SHARDS_OF = f"""array_join(transform(if(_all = 0, array(), sequence(1, cast(_all as int))), n -> size(filter(slice(_ends, 1, {SHARDS - 1}),
    e -> e.turn < n - 1 or (e.turn = n - 1 and (e.key < _key or (e.key = _key and (e.copy < _copy or (e.copy = _copy and e.part = 0)))))))), ',')"""


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, quota, shards) for ``docs(doc_id, text, source)``."""
    sized = common.cut(keyed(docs.select("doc_id", "text", "source")).select("doc_id", "source", "_key", words_of("text").alias("size")))
    times, part = takes(F.col("size"))
    out = placed(sized, sized).withColumns({"_times": times, "_words": part})
    out = out.withColumn("_all", F.col("_times") + F.when(F.col("_words") > 0, 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("_times") * F.col("size") + F.col("_words")).alias("taken"), "source", "quota", F.expr(SHARDS_OF).alias("shards"))


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix itself: ``docs``, once for each time that a document is taken; whole texts stay as they are, and of one that
    the quota's end cuts the words before it are kept with the white space between them."""
    rows = keyed(common.packed(docs, "doc_id", "text", "source")).drop("doc_id")
    sized = rows.select("source", "_key", words_of("text").alias("size"))
    # only a document at an end has to be counted again; what has words is asked of the others
    size = F.when(F.col("_at_end"), words_of("text")).when(F.col("text").rlike(WORD), 1).otherwise(0)
    times, part = takes(F.col("_size"))
    out = placed(rows, sized).withColumn("_size", size).withColumns({"_times": times, "_words": part})
    out = out.withColumn("_all", F.col("_times") + F.when(F.col("_words") > 0, 1).otherwise(0)).where("_all > 0")
    out = out.select("_row", "text", "_times", "_words", F.explode(F.expr("sequence(1, cast(_all as int))")).alias("_turn"))
    start = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(GAP + WORD), F.lit(0)), F.lit(1), F.col("_words").cast("int")), "")
    return common.unpacked(out.withColumn("_text", F.when(F.col("_turn") <= F.col("_times"), F.col("text")).otherwise(F.regexp_replace(start, "^" + GAP, ""))), docs, "_text")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))
