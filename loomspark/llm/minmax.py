"""MinHash near-dedup by min-max hashing.

Every permutation of a document's five-word shingles gives two signature values, its minimum and its maximum, so
``PERMUTATIONS`` hash functions make twice as many values. Bands of w permutations (minimum and maximum of each) are
the bucket keys. A pair with Jaccard similarity s falls into a common bucket with probability
1 - (1 - s**(2 w))**(PERMUTATIONS // w); w is the largest width for which a pair at the threshold is missed with a
probability of at most ``MISS``: 4 for 0.85 (missed with 0.00004) and 3 for 0.8 (missed with 0.000003).

Documents with the same shingle set are one node, told apart by 128 bits. Within a bucket not all pairs are expanded:
members are verified against one leader, verified links are merged into components, and only buckets that still hold
several components go on. There, members outside the bucket's main component become leaders, about ``LEADERS`` in the
first round and four times as many in each further one, until every member has joined the main component or has been
compared with all others; buckets of at most ``SMALL`` members finish at once. No candidate is capped or dropped. Links
are confirmed on full shingle sets.

Scale: a bucket of any size is dealt to units of bounded members and shingles, and every join by bucket is a join by
(bucket, unit); a text crosses one shuffle, by a key of (doc_id, text).

Defined cases: null, empty or blank text gives the empty set (0 shingles, linked with nothing, a component of its
own); fewer than five words give one shingle; equal texts share a component; rows that repeat a doc_id are kept and
take the component of their own text; a null doc_id takes no part in the minimum; a very long text is a unit of its
own; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, PERMUTATIONS, MISS, SEED = 5, 128, 1e-4, 20260
SMALL, LEADERS, UNIT, UNIT_SHINGLES, SALTS = 32, 16, 128, 1 << 20, 16
WORD = r"[^\x20\x09-\x0D]"


def word_list(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased: both bytes methods know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = word_list(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out, n = np.zeros(len(h) - SHINGLE + 1, np.uint64), len(h) - SHINGLE + 1
    for i in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return np.unique(mixed(out))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32)


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(PERMUTATIONS, 2): the minimum and the maximum under each permutation of the 32-bit keys."""
    a, b = family
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(x), 1024):
        v = x[at : at + 1024, None] * a + b
        low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
    return np.stack([low, high], axis=1)


def band_width(percent: int) -> int:
    """Permutations in a band for a threshold."""
    missed = lambda w: (1 - (percent / 100) ** (2 * w)) ** (PERMUTATIONS // w)
    return max([1, *(w for w in range(1, PERMUTATIONS + 1) if missed(w) <= MISS)])


def band_keys(signatures: np.ndarray, width: int) -> np.ndarray:
    """(documents, bands) of 64-bit bucket keys for bands of ``width`` permutations; the band's number is part of the key."""
    n, bands = len(signatures), PERMUTATIONS // width
    v = signatures[:, : bands * width].reshape(n, bands, 2 * width).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, v.shape[1] + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), v.shape[:2]).copy()
    for i in range(2 * width):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + v[:, :, i])
    return key.view(np.int64)


#: Columns of a signed document: its row's key, and the 128-bit digest of its shingle set, which is its identity.
SIGNED = "doc_id long, k1 long, k2 long, n_shingles long, s1 long, s2 long, bands array<long>"


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """Two longs that stand for (doc_id, text)."""
    return F.xxhash64(F.lit(1), doc_id, text).alias("k1"), F.xxhash64(F.lit(2), doc_id, text).alias("k2")


def _signed(width: int):
    """Arrow batches (doc_id, text, k1, k2) -> ``SIGNED``."""

    def run(rows):
        family = permutations()
        for batch in rows:
            for part in common.slices(batch):
                yield _signed_part(part, family, width)
        common.released()

    return run


def _signed_part(part: pa.RecordBatch, family, width: int) -> pa.RecordBatch:
    sets = [shingle_set(x.as_py()) for x in part.column("text")]
    digests = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) if len(s) else None for s in sets]
    full = [i for i, s in enumerate(sets) if len(s)]
    bands: list = [None] * len(sets)
    if full:
        for i, keys in zip(full, band_keys(np.stack([signature(sets[i], family) for i in full]), width), strict=True):
            bands[i] = keys
    halves = [pa.array([None if d is None else int(d[k]) for d in digests], pa.int64()) for k in (0, 1)]
    columns = [*(part.column(c) for c in ("doc_id", "k1", "k2")), pa.array([len(s) for s in sets], pa.int64()), *halves, pa.array(bands, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "n_shingles", "s1", "s2", "bands"])


def _hashed(rows):
    """Arrow batches (node, text) -> (node, full): the whole shingle set as sorted 64-bit hashes."""
    for batch in rows:
        for part in common.slices(batch):
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([shingle_set(x.as_py()).tobytes() for x in part.column("text")], pa.binary())], names=["node", "full"])
    common.released()


def alike(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(other, one)
    both = int((other[np.minimum(at, len(other) - 1)] == one).sum())
    return 100 * both >= percent * (len(one) + len(other) - both)


def _compared(percent: int):
    """One unit, Arrow columns (side, node, label, n, full): leaders (side 1) against members (side 0); the pairs that
    reach the similarity on their full sets and whose labels differ."""

    def run(rows: pa.Table) -> pa.Table:
        side, node, label, n = (rows.column(c).to_numpy() for c in ("side", "node", "label", "n"))
        full = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("full")]
        found: list[list[int]] = [[], []]
        for b in np.flatnonzero(side == 1):
            fits = (side == 0) & (label != label[b]) & (100 * np.minimum(n, n[b]) >= percent * np.maximum(n, n[b]))
            for a in np.flatnonzero(fits):
                if alike(full[a], full[b], percent):
                    found[0].append(int(node[a]))
                    found[1].append(int(node[b]))
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return run


def parts(count, shingles):
    """Units for so many members with so many shingles: at most about ``UNIT`` members and ``UNIT_SHINGLES`` each."""
    return F.greatest(F.ceil(count / UNIT), F.ceil(shingles / UNIT_SHINGLES), F.lit(1)).cast("long")


def _part(by: str):
    return F.pmod(F.xxhash64("node", F.lit(11)), F.col(by))


def _every(by: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(by) - 1))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, near_group, k1, k2, first)`` for ``docs(doc_id, text)``; links need
    100 * common >= percent * union, and ``first`` marks the row (doc_id, text) that stands for its group."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", *row_key())
    signed = common.cut(slim.mapInArrow(_signed(band_width(percent)), SIGNED))
    # A node is a distinct shingle set; its first row is that of the smallest doc_id. Ids are dealt when it is written.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    nodes = signed.where("s1 is not null").groupBy("s1", "s2").agg(F.first("bands").alias("bands"), F.first("n_shingles").alias("n"), F.min(order).alias("row"))
    nodes = common.cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    rows = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.min(F.struct("node", "n")).alias("leader")).where("size > 1")
    led = rows.join(buckets.select("bucket", "size", "leader", parts(F.col("size"), F.col("total")).alias("high")), "bucket")
    led = common.cut(led.select("bucket", "node", "n", "size", "high", _part("high").alias("y"), (F.col("node") == F.col("leader.node")).alias("tested"), "leader"))
    members = led.drop("leader")
    # The full set of each node that shares a bucket, from the text of its first row: a text is moved once, by a key
    # that copies do not share.
    wanted = members.select("node").distinct().join(nodes.select("node", "row.k1", "row.k2"), "node")
    texts = slim.where("text is not null").select("k1", "k2", "text").join(wanted, ["k1", "k2"])
    sets = texts.select("node", "text").mapInArrow(_hashed, "node long, full binary")
    sets = common.cut(sets.groupBy("node").agg(F.first("full").alias("full")))  # rows may repeat

    def pairs_of_first_leaders() -> DataFrame:
        """Each member against its bucket's first leader, each pair once, whatever the buckets that it shares; a leader's
        members are dealt to units, so that its set goes to each unit and not to each pair."""
        near = led.where("not tested").select("node", "n", F.col("leader.node").alias("b"), F.col("leader.n").alias("m")).where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
        near = common.cut(near.groupBy(F.col("node").alias("a"), "b").agg(F.first("n").alias("n"), F.first("m").alias("m")))
        units = near.groupBy("b").agg(F.count("*").alias("many"), F.sum("n").alias("total"), F.first("m").alias("m")).select("b", "m", parts(F.col("many"), F.col("total")).alias("units"))
        low = near.withColumn("salt", F.pmod(F.xxhash64("a", F.lit(3)), F.lit(SALTS))).join(units.select("b", "units").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1)))), ["b", "salt"])
        low = low.select("b", F.pmod(F.xxhash64("a", F.lit(5)), F.col("units")).alias("unit"), F.lit(0).alias("side"), F.col("a").alias("node"), F.col("a").alias("label"), "n")
        high = units.select("b", _every("units").alias("unit"), F.lit(1).alias("side"), F.col("b").alias("node"), F.col("b").alias("label"), F.col("m").alias("n"))
        return low.unionByName(high).join(sets, "node").select("b", "unit", "side", "node", "label", "n", "full").groupBy("b", "unit").applyInArrow(_compared(percent), "a long, b long")

    def pairs_of(leaders: DataFrame, members: DataFrame) -> DataFrame:
        """Leaders against the members of their buckets in units of at most about ``UNIT`` members and ``UNIT`` leaders:
        each full set goes once to each unit, not once to each pair."""
        columns = ["bucket", "node", "label", "n", "x", "y"]
        low = members.withColumn("x", _every("wide")).select(*columns, F.lit(0).alias("side"))
        lead = leaders.withColumn("x", _part("wide")).withColumn("y", _every("high")).select(*columns, F.lit(1).alias("side"))
        full = low.union(lead).join(sets, "node").select(*columns, "side", "full")
        return full.groupBy("bucket", "x", "y").applyInArrow(_compared(percent), "a long, b long")

    links = common.cut(pairs_of_first_leaders())
    labels = sets.select("node").join(common.components(links), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    many, of_sets = led.count(), sets.count()
    labels, leaders = common.cut(labels, of_sets), LEADERS
    while True:
        # Links that are still unknown join two components, so one of their ends lies outside the bucket's main component.
        known = common.cut(members.join(labels, "node"), many)
        free = F.when(~F.col("tested"), F.col("n"))
        main = known.groupBy("bucket", "label").agg(F.count("*").alias("many"), F.count(free).alias("left"), F.sum(free).alias("total"), F.first("high").alias("high"))
        biggest = F.max(F.struct("many", "label", "left", F.coalesce("total", F.lit(0)).alias("total")))
        main = main.groupBy("bucket").agg(biggest.alias("main"), F.sum("left").alias("left"), F.sum("total").alias("total"), F.sum("many").alias("size"), F.first("high").alias("high"))
        # ``left``: members outside the main component that no leader has been; a bucket without them is done. About
        # ``leaders`` of them are next, chosen by a hash; all, where they are no more than that.
        left, share = F.col("left") - F.col("main.left"), F.least(F.lit(1.0), 1.25 * leaders / F.col("left"))
        still = main.withColumns({"left": left, "total": F.col("total") - F.col("main.total")}).where("left > 0")
        wide = F.when(F.col("size") <= SMALL, F.lit(1)).otherwise(parts(F.col("left") * share, F.col("total") * share)).cast("long")
        still = still.select("bucket", F.col("main.label").alias("main"), "left", wide.alias("wide"), _every("high").alias("y"))
        members = common.cut(known.join(still, ["bucket", "y"]), many)
        if members.isEmpty():
            break
        chance = F.pmod(F.xxhash64("node", "bucket", F.lit(leaders)), F.lit(1 << 20)) * F.col("left") < F.lit(leaders << 20)
        chosen = common.cut(members.where("not tested and label <> main").where((F.col("size") <= SMALL) | chance), many)
        found = common.cut(pairs_of(chosen, members).distinct())
        # new links join components; only these are merged further
        ends = found.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        merges = ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        moved = common.components(merges).select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = common.cut(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), of_sets)
        members = members.where(F.col("size") > SMALL).join(chosen.select("bucket", "node", F.lit(True).alias("now")), ["bucket", "node"], "left")
        members = members.select("bucket", "node", "n", "size", "high", "y", (F.col("tested") | F.coalesce("now", F.lit(False))).alias("tested"))
        leaders *= 4
    of_node = nodes.select("node", "s1", "s2", "row").join(labels, "node", "left").select("s1", "s2", "row", F.coalesce("label", "node").alias("label"))
    least = of_node.groupBy("label").agg(F.min("row").alias("least"))
    ids = of_node.join(least, "label").select("s1", "s2", F.col("label").alias("near_group"), F.col("least").alias("least"))
    out = signed.select("doc_id", "n_shingles", "s1", "s2", "k1", "k2").join(ids, ["s1", "s2"], "left")
    component = F.when(F.col("s1").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    first = F.col("s1").isNull() | ((F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "near_group", "k1", "k2", first.alias("first"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row for each group of near duplicates, one of the smallest doc_id (of rows that share it, the one
    that a hash puts first). Blank texts have no group: nothing is like them, and they all stay."""
    marks = common.cut(near_duplicates(docs, percent).where("first").groupBy("k1", "k2", "n_shingles").count())
    keyed = common.packed(docs, *row_key(F.col("doc_id").cast("long"), "text"))
    if not marks.where("count > 1 and n_shingles > 0").isEmpty():
        # Rows that repeat a (doc_id, text) that stays: one of them, found before anything is moved by that key.
        blank = docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
        rest = common.packed(docs.where(F.col("text").rlike(WORD)), *row_key(F.col("doc_id").cast("long"), "text"))
        once = rest.groupBy("k1", "k2").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).join(marks, ["k1", "k2"], "left_semi")
        return common.unpacked(once, docs).unionByName(blank)
    return common.unpacked(keyed.join(marks, ["k1", "k2"], "left_semi"), docs)


def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: Shared shingles of all pairs, for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS k FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(k) = 0 THEN [] WHEN len(k) < 5 THEN [array_to_string(k, ' ')] ELSE list_transform(range(1, len(k) - 3), lambda i: array_to_string(k[i : i + 4], ' ')) END) AS g FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least l ON l.node = d.doc_id
"""
