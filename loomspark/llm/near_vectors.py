"""Embedding near-dedup with an inverted multi-index.

Both halves of the unit vectors have a codebook of their own, fitted on a bounded sample; the pairs of codes form the
grid of cells. Every vector lives in its nearest cell, and a query walks the grid by the multi-sequence algorithm: cells in
the order of t1**2 + t2**2, where t is how far a half would have to move to be nearer to the other code than to its own.
The two ends of a link are at most sqrt(2 - 2 c) apart, so a cell beyond that holds none, and the walk ends there. The
target is a recall of 1: only rounding, against which the limit has a margin, could lose a link. Pairs met this way are
verified in double precision.

Scale: equal vectors are one node with a weight, so that a common vector is compared once. The number of codes grows with
the square root of the nodes, so that cells keep about ``CELL_BYTES`` of them; a cell is one task's work, and one of more
than twice ``UNIT_BYTES`` is dealt to units of residents by residents and visitors, each of about so many bytes. A vector crosses the shuffle once for each cell
that it visits, as it was given. No pair ever becomes a row: a unit reports the number of links of each vector, and edges
that join what it links, at most one for each vector. The links within one cluster of different vectors are quadratic
work, spread over its units.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing and are
their own components; only vectors of one dimension are compared; rows that repeat a vec_id are vectors of their own,
which link with each other if they are near, and share a component; a null vec_id is kept and takes no part; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

THRESHOLD, CELL_BYTES, UNIT_BYTES, ROUNDS, SEED = 0.95, 4 << 20, 8 << 20, 8, 11
#: Rows and bytes of the sample that the codebooks are fitted on; rows of a unit that are compared at once.
SAMPLE, SAMPLE_BYTES, CHUNK = 8192, 32 << 20, 512


def codebook(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means centroids of the sample, from a seeded choice of its rows."""
    rng = np.random.default_rng(seed)
    book = sample[rng.permutation(len(sample))[:k]].copy()
    for _ in range(ROUNDS):
        near = (-2 * sample @ book.T + (book**2).sum(axis=1)).argmin(axis=1)
        for c in range(len(book)):
            if (own := near == c).any():
                book[c] = sample[own].mean(axis=0)
    return book


def gaps(half: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(rows, codes): how far each row must move to be nearer to the code than to its own, squared; 0 for its own."""
    far = ((half[:, None, :] - book[None]) ** 2).sum(axis=2) if len(book) * half.size < 1 << 22 else (half**2).sum(axis=1)[:, None] - 2 * half @ book.T + (book**2).sum(axis=1)
    own = far.argmin(axis=1)
    apart = np.sqrt(((book[:, None] - book[None]) ** 2).sum(axis=2))
    t = (far - far.min(axis=1)[:, None]) / (2 * np.maximum(apart[own], 1e-12))
    t[np.arange(len(half)), own] = 0.0
    return t**2


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float):
    """Cells (i, j) in ascending first[i] + second[j], while that is at most ``limit``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a], second[b]
    queue, seen = [(x[0] + y[0], 0, 0)], {(0, 0)}
    while queue:
        cost, i, j = heapq.heappop(queue)
        if cost > limit:
            return
        yield int(a[i]), int(b[j])
        for step in ((i + 1, j), (i, j + 1)):
            if step[0] < len(x) and step[1] < len(y) and step not in seen:
                seen.add(step)
                heapq.heappush(queue, (x[step[0]] + y[step[1]], *step))


class Index:
    def __init__(self, sample: np.ndarray, rows: int, threshold: float = THRESHOLD):
        self.dim = sample.shape[1]
        self.split = max(1, self.dim // 2)
        k = max(2, math.ceil(math.sqrt(rows * 8 * self.dim / CELL_BYTES)))
        self.books = [codebook(half, min(k, len(half)), SEED + i) for i, half in enumerate((sample[:, : self.split], sample[:, self.split :]))]
        self.limit = (2 - 2 * threshold) * (1 + 1e-6) + 1e-9

    def cells(self, units: np.ndarray) -> list[list[int]]:
        """For each vector its own cell, and then those that it visits: of two cells one is visited by the vectors of the
        other, so that a pair is met once; which one depends on both numbers, so that no cell gets all the visits."""
        first, second = gaps(units[:, : self.split], self.books[0]), gaps(units[:, self.split :], self.books[1])
        out = []
        for p, q in zip(first, second, strict=True):
            own, *others = (i * len(q) + j for i, j in multi_sequence(p, q, self.limit))
            out.append([own, *(c for c in others if (own < c) == ((own + c) % 2 == 0))])
        return out


def unit_of(v: np.ndarray) -> np.ndarray | None:
    v = v.astype(np.float64)
    big = np.abs(v).max(initial=0)
    if not big > 0:
        return None
    v = v / big
    return v / np.linalg.norm(v)


def _units(kind: type):
    """(row, vec_id, embedding) -> the vector's bytes as given, and a 128-bit digest of its unit vector."""

    def run(rows):
        for batch in rows:
            ids, numbers, usable, found = batch.column("vec_id").to_pylist(), batch.column("row").to_pylist(), *vectors.matrix(batch.column("embedding"))
            out: list[list] = [[None] * len(ids) for _ in range(4)]
            for i, v in zip(np.flatnonzero(usable), found, strict=True):
                if ids[i] is not None and (unit := unit_of(v)) is not None:
                    k1, k2 = np.frombuffer(xxhash.xxh3_128_digest(unit.tobytes()), np.int64).tolist()
                    for column, x in zip(out, (len(v), k1, k2, v.astype(kind).tobytes()), strict=True):
                        column[i] = x
            arrays = [pa.array(x, t) for x, t in zip([numbers, ids, *out], (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "vec_id", "dim", "k1", "k2", "vector"])
        common.released()

    return run


def _routed(indexes: dict[int, Index], kind: type):
    """(node, weight, least, dim, vector) -> one row for each cell that the vector lives in (guest 0) or visits (guest 1)."""

    def run(rows):
        for batch in rows:
            dims = batch.column("dim").to_pylist()
            units = [unit_of(np.frombuffer(x.as_buffer(), kind)) for x in batch.column("vector")]
            take, cells, guests = [], [], []
            for d in set(dims):
                own = [i for i, x in enumerate(dims) if x == d]
                walks = indexes[d].cells(np.stack([units[i] for i in own])) if d in indexes else [[0]] * len(own)
                for i, walk in zip(own, walks, strict=True):
                    take += [i] * len(walk)
                    cells += [d << 40 | c for c in walk]
                    guests += [0] + [1] * (len(walk) - 1)
            part = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.int64()), pa.array(guests, pa.int32())], names=[*part.schema.names, "cell", "guest"])
        common.released()

    return run


#: What a unit reports: links of a node, or an edge between two nodes.
FOUND = "node long, links long, a long, b long"


def _linked(threshold: float, kind: type):
    """One unit, Arrow columns (node, weight, least, dim, vector, side): residents (side 1, or 2 for both sides) against
    residents and guests (side 0 for guests, -1 for residents of other units or this one, 2)."""

    def run(rows: pa.Table) -> pa.Table:
        node, weight, least, side = (rows.column(c).to_numpy() for c in ("node", "weight", "least", "side"))
        units = np.stack([unit_of(np.frombuffer(x.as_buffer(), kind)) for x in rows.column("vector")])
        left, right = np.flatnonzero(side >= 1), np.flatnonzero(side != 1)
        guest = side[right] == 0
        links, parent = np.zeros(len(node), np.int64), list(range(len(node)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        other = units[right].T
        for at in range(0, len(left), CHUNK):
            own = left[at : at + CHUNK]
            near = units[own] @ other >= threshold
            near &= node[own][:, None] != node[right][None]
            links[own] += near @ weight[right]
            if guest.any():
                links[right[guest]] += weight[own] @ near[:, guest]
            for i, j in _joined(near):
                x, y = root(own[i]), root(right[j])
                parent[max(x, y)] = min(x, y)
        some = np.flatnonzero(links)
        tied = [(i, r) for i in range(len(node)) if (r := root(i)) != i and least[i] != least[r]]
        nothing = [None] * len(tied)
        columns = [[*node[some].tolist(), *nothing], [*links[some].tolist(), *nothing], [*[None] * len(some), *(int(least[i]) for i, _ in tied)], [*[None] * len(some), *(int(least[r]) for _, r in tied)]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["node", "links", "a", "b"])

    return run


def _joined(near: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs that connect what ``near`` connects: each column to its first row, and of two rows that share
    a column the later one to that column."""
    out = []
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return out
    hit = near[np.ix_(rows, columns)]
    first = hit.argmax(axis=0)
    out += [(int(rows[r]), int(c)) for r, c in zip(first, columns, strict=True)]
    # Rows are connected through the columns they share: spread the least row over each row's columns until nothing moves.
    label = np.arange(len(rows))
    while True:
        of_column = np.where(hit, label[:, None], len(rows)).min(axis=0)
        best = np.where(hit, of_column[None], len(rows))
        new = np.minimum(label, best.min(axis=1))
        if (new == label).all():
            return out
        for r in np.flatnonzero(new < label):
            out.append((int(rows[r]), int(columns[best[r].argmin()])))
        label = new


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for ``embeddings(vec_id, embedding)``."""
    kind = np.float32 if embeddings.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    numbered = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("row", F.monotonically_increasing_id())
    units = common.cut(numbered.mapInArrow(_units(kind), "row long, vec_id long, dim int, k1 long, k2 long, vector binary"))
    usable = units.where("vector is not null")
    nodes = usable.groupBy("k1", "k2").agg(F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    nodes = common.cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    sizes = {r["dim"]: r["rows"] for r in nodes.groupBy("dim").agg(F.count("*").alias("rows")).collect()}
    rows = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(sizes, default=1))))
    sample = nodes.orderBy(F.xxhash64("k1"), "k2").limit(rows).select("dim", "vector").collect()
    indexes = {}
    for dim in {r["dim"] for r in sample}:
        indexes[dim] = Index(np.stack([unit_of(np.frombuffer(r["vector"], kind)) for r in sample if r["dim"] == dim]), sizes[dim], threshold)
    slim = nodes.select("node", "weight", "least", "dim", "vector")
    routed = common.cut(slim.mapInArrow(_routed(indexes, kind), "node long, weight long, least long, dim int, vector binary, cell long, guest int"))
    # Only cells that are too large for one unit are listed.
    size = F.lit(8) * F.col("dim") / UNIT_BYTES
    shape = routed.groupBy("cell", "dim").agg(F.count(F.when(F.col("guest") == 0, 1)).alias("own"), F.count("*").alias("all")).where(F.col("all") * size > 2)
    shape = shape.select("cell", F.ceil(F.col("own") * size).alias("wide"), F.ceil(F.col("all") * size).alias("high"))
    dealt = routed.join(shape, "cell", "left").withColumns({"x": F.pmod(F.xxhash64("node"), F.col("wide")), "y": F.pmod(F.xxhash64("node", F.lit(1)), F.col("high"))})
    columns = ["cell", "node", "weight", "least", "vector"]
    each = lambda by: F.explode(F.sequence(F.lit(0).cast("long"), F.col(by) - 1))
    whole = dealt.where("wide is null").select(*columns, F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.when(F.col("guest") == 0, 2).otherwise(0).alias("side"))
    large = dealt.where("wide is not null")
    ahead = large.where("guest = 0").drop("y").withColumn("y", each("high")).select(*columns, "x", "y", F.lit(1).alias("side"))
    behind = large.drop("x").withColumn("x", each("wide")).select(*columns, "x", "y", F.when(F.col("guest") == 0, -1).otherwise(0).alias("side"))
    met = whole.unionByName(ahead).unionByName(behind)
    found = common.cut(met.groupBy("cell", "x", "y").applyInArrow(_linked(threshold, kind), FOUND))
    counts = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    ids = usable.select("row", "vec_id", "k1", "k2").join(nodes.select("k1", "k2", "node", "least", "weight"), ["k1", "k2"])
    # A vec_id with several vectors joins their components.
    several = ids.groupBy("vec_id").agg(F.min("least").alias("b"), F.max("least").alias("far")).where("b <> far").select("vec_id", "b")
    edges = found.where("a is not null").select("a", "b").unionByName(ids.join(several, "vec_id").select(F.col("least").alias("a"), "b"))
    labels = common.components(edges)
    told = ids.join(counts, "node", "left").join(labels.withColumnRenamed("node", "least"), "least", "left")
    told = told.select("row", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "least").alias("component_id"))
    out = units.select("row", "vec_id").join(told, "row", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))


#: All pairs, for small tables.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS len FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b
  ON a.vec_id <> b.vec_id AND a.len > 0 AND b.len > 0 AND list_inner_product(a.e, b.e) / (a.len * b.len) >= 0.95
),
reach(node, other) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN least c ON c.node = v.vec_id
"""
