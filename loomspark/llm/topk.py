"""Exact top-k search by inner product.

Vectors are kept in blocks by descending length. A block is scored against a block of queries in two steps: the first
coordinates after a rotation by the singular vectors, which gather most of the length there, plus the Cauchy-Schwarz
bound on the rest. Only where the bound reaches a query's k-th best score so far is the product finished, in exact
integers. Whole blocks fall by length alone when |query| times the block's longest vector stays below that score.
The rotation comes from a bounded sample and only decides how early a product is given up, never what is returned.

Scale: first every query is scored against the ``LEADERS`` longest vectors, a bounded table that is broadcast; the k-th best
of these scores is its floor. Queries (the stated set: every hundredth id) are sorted by floor / length into blocks, and a
block of vectors goes to the blocks of queries whose floors its longest vector can reach, which are the first ones in that
order. Groups of such vector blocks meet one block of queries in a task, longest first, keep the k best of each query,
and the last step ranks what is left of each query. The ends of the order by length also hold the row, so that vectors of
one length do not meet in one task.

Defined cases: vectors that are null, empty, or hold a null or non-finite component (also after scaling) take no part;
only vectors of one dimension are compared; equal scores rank by the smaller vec_id; rows that repeat a vec_id are queries
and candidates of their own, and only a query's own row is no candidate of it; a null vec_id takes no part; an empty
table gives an empty result; other columns are ignored. Products are exact in doubles while they stay below 2**53, and are
taken in Python integers above; beyond the range of a long they count as its end.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, vectors

SCALE, K, EVERY = 1024, 10, 100
#: Bytes of a block of vectors and of a block of queries; vector blocks of a task; the sample; longest vectors.
BLOCK_BYTES, QUERY_BYTES, TOGETHER, SAMPLE, LEADERS, TABLE_BYTES, EXACT = 1 << 20, 1 << 19, 4, 4096, 1024, 8 << 20, float(1 << 53)


def _packed(rows):
    """(row, vec_id, embedding) -> (row, vec_id, dim, norm, packed): the scaled integers as doubles."""
    kinds = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("dim", pa.int32()), ("norm", pa.float64()), ("packed", pa.binary())])
    for batch in rows:
        usable, found = vectors.matrix(batch.column("embedding"))
        ids, numbers = (np.array(batch.column(c).to_pylist(), object)[usable] for c in ("vec_id", "row"))
        with np.errstate(over="ignore"):
            scaled = [np.floor(SCALE * v) for v in found]
        keep = [i for i, v in enumerate(scaled) if ids[i] is not None and np.isfinite(v).all()]
        columns = [[numbers[i] for i in keep], [ids[i] for i in keep], [len(scaled[i]) for i in keep], [float(np.linalg.norm(scaled[i])) for i in keep], [scaled[i].tobytes() for i in keep]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)


#: A block: its dimension, its sort value (least need of queries, greatest length of vectors) and its rows.
BLOCK = "dim int, edge double, n long, rows binary, ids binary, floors binary, packed binary"


def _blocks(most: int, edge: str):
    """Sorted rows (row, vec_id, dim, packed, ``edge``, floor) -> blocks of one dimension of about ``most`` bytes."""

    def run(batches):
        dim, held = None, []

        def block():
            numbers, ids, packed, edges, floors = zip(*held, strict=True)
            values = ([dim], [min(edges) if edge == "need" else max(edges)], [len(held)], [np.array(numbers, np.int64).tobytes()], [np.array(ids, np.int64).tobytes()], [np.array(floors, np.float64).tobytes()], [b"".join(packed)])
            kinds = (pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["dim", "edge", "n", "rows", "ids", "floors", "packed"])

        for batch in batches:
            for *row, d in zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "packed", edge, "floor", "dim")), strict=True):
                if held and (d != dim or len(held) * 8 * d >= most):
                    yield block()
                    held = []
                dim = d
                held.append(row)
        if held:
            yield block()

    return run


def _floored(leaders: dict, k: int):
    """Adds to queries (row, vec_id, dim, norm, packed) their floor and need, the length that a vector must have to reach it."""

    def run(rows):
        for batch in rows:
            dims, norms, numbers = (batch.column(c).to_pylist() for c in ("dim", "norm", "row"))
            floors = []
            for d, norm, number, x in zip(dims, norms, numbers, batch.column("packed"), strict=True):
                own, matrix = leaders.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = (matrix @ np.frombuffer(x.as_buffer(), np.float64))[own != number]
                low = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
                slack = 1e-9 * norm * (np.linalg.norm(matrix[0]) if len(matrix) else 0.0) + 1e-6
                floors.append(float(low - slack) if np.isfinite(low - slack) else -np.inf)
            needs = [f / n if n > 0 else -np.inf for f, n in zip(floors, norms, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.float64()), pa.array(needs, pa.float64())], names=[*batch.schema.names, "floor", "need"])

    return run


def rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors, the largest first."""
    return np.linalg.svd(sample.T @ sample)[0]


def best(queries: np.ndarray, block: np.ndarray, turn: np.ndarray | None, floor: np.ndarray) -> list[tuple[int, int, float]]:
    """(query's row, vector's row, score) of the pairs of the block whose score may reach ``floor``, each query's k-th best."""
    lengths = np.linalg.norm(block, axis=1)
    of_queries = np.linalg.norm(queries, axis=1)
    alive = np.flatnonzero(of_queries * lengths.max() * (1 + 1e-9) + 1e-6 >= floor)
    if not len(alive):
        return []
    head = max(1, block.shape[1] // 4)
    q, x = (queries[alive], block) if turn is None else (queries[alive] @ turn, block @ turn)
    slack = 1e-9 * np.outer(of_queries[alive], lengths) + 1e-6
    bound = q[:, :head] @ x[:, :head].T
    bound += np.outer(np.linalg.norm(q[:, head:], axis=1), np.linalg.norm(x[:, head:], axis=1)) + slack
    rows, columns = np.nonzero(bound >= floor[alive][:, None])
    if not len(rows):
        return []
    if of_queries.max() * lengths.max() < EXACT:
        some = np.unique(columns)
        scores = (queries[alive] @ block[some].T)[rows, np.searchsorted(some, columns)]
    else:
        scores = [sum(int(a) * int(b) for a, b in zip(queries[alive[r]], block[c], strict=True)) for r, c in zip(rows, columns, strict=True)]
        scores = [max(-(1 << 63), min((1 << 63) - 1, s)) for s in scores]
    return [(int(alive[r]), int(c), int(s)) for r, c, s in zip(rows, columns, scores, strict=True)]


def _search(k: int, turns: dict):
    """Sorted by (place, part, kind, edge): a block of queries (kind 0) and then blocks of vectors, longest first -> the k
    best of each query in the part."""

    def run(rows):
        kinds = pa.schema([(c, pa.int64()) for c in ("query_row", "query_id", "vec_id", "score")])
        tops: dict[int, list] = {}
        asked: tuple | None = None

        def result():
            flat = [(int(asked[0][q]), int(asked[1][q]), -i, s) for q, top in tops.items() for s, i in top]
            return pa.RecordBatch.from_arrays([pa.array([x[n] for x in flat], pa.int64()) for n in range(4)], schema=kinds)

        for batch in rows:
            for b in range(batch.num_rows):
                numbers, ids = (np.frombuffer(batch.column(c)[b].as_buffer(), np.int64) for c in ("rows", "ids"))
                floors, packed = (np.frombuffer(batch.column(c)[b].as_buffer(), np.float64) for c in ("floors", "packed"))
                dim, packed = batch.column("dim")[b].as_py(), packed.reshape(len(ids), -1)
                if batch.column("kind")[b].as_py() == 0:
                    if tops:
                        yield result()
                    tops, asked = {}, (numbers, ids, floors, packed)
                    continue
                own, _, least, queries = asked
                for at in range(0, len(ids), 512):  # later parts profit from the scores of earlier ones
                    floor = np.array([max(least[q], tops[q][0][0]) if len(tops.get(q, ())) >= k else least[q] for q in range(len(own))])
                    for q, c, score in best(queries, packed[at : at + 512], turns.get(dim), floor):
                        if numbers[at + c] == own[q]:
                            continue
                        top, entry = tops.setdefault(q, []), (score, -int(ids[at + c]))
                        if len(top) < k:
                            heapq.heappush(top, entry)
                        elif entry > top[0]:
                            heapq.heapreplace(top, entry)
        if tops:
            yield result()

    return run


def search(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the vectors whose id is divisible by ``every``; ``query_row`` tells rows apart."""
    numbered = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("row", F.monotonically_increasing_id())
    packed = common.cut(numbered.mapInArrow(_packed, "row long, vec_id long, dim int, norm double, packed binary"))
    told = packed.agg(F.count("*").alias("rows"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim"), F.coalesce(F.sum(8 * F.col("dim").cast("long")), F.lit(0)).alias("bytes")).first()
    fits = max(1, TABLE_BYTES // (8 * told["dim"]))
    matrices = lambda rows: {d: [r for r in rows if r["dim"] == d] for d in {r["dim"] for r in rows}}
    stacked = lambda rows: np.stack([np.frombuffer(r["packed"], np.float64) for r in rows])
    sample = packed.orderBy(F.xxhash64("row"), "row").limit(min(SAMPLE, fits)).select("dim", "packed").collect()
    turns = {d: rotation(stacked(rows)) for d, rows in matrices(sample).items()}
    longest = packed.orderBy(F.col("norm").desc(), "row").limit(min(LEADERS, fits)).select("row", "dim", "packed").collect()
    leaders = {d: (np.array([r["row"] for r in rows], np.int64), stacked(rows)) for d, rows in matrices(longest).items()}
    floored = packed.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(_floored(leaders, k), "row long, vec_id long, dim int, norm double, packed binary, floor double, need double")
    queries = common.cut(floored)
    in_blocks = lambda df, order, size, n: df.repartitionByRange(max(1, int(n // (16 * size))), *order).sortWithinPartitions(*order)
    asked = in_blocks(queries, [F.col("dim"), F.col("need"), F.col("row")], QUERY_BYTES, told["bytes"] // every).mapInArrow(_blocks(QUERY_BYTES, "need"), BLOCK)
    asked = common.cut(asked.withColumn("id", F.monotonically_increasing_id()))
    order = [F.col("dim"), F.col("norm").desc(), F.col("row")]
    held = in_blocks(packed.withColumn("floor", F.lit(0.0)), order, BLOCK_BYTES, told["bytes"]).mapInArrow(_blocks(BLOCK_BYTES, "norm"), BLOCK)
    held = common.cut(held.withColumn("id", F.monotonically_increasing_id()))
    # The place of a block of queries among those of its dimension, by need: a block of vectors meets the first ones.
    places = asked.select("id", "dim", "edge").withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy("edge", "id")) - 1)
    needs = places.groupBy("dim").agg(F.sort_array(F.collect_list("edge")).alias("needs"))
    reach = F.size(F.filter("needs", lambda x: x <= F.col("edge") * (1 + 1e-6) + 1e-6))
    group = held.groupBy("dim").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    shape = needs.join(group, "dim")
    ahead = held.join(shape, "dim").where(reach > 0).withColumn("part", F.pmod("id", F.col("parts"))).withColumn("place", F.explode(F.sequence(F.lit(0), reach - 1)))
    behind = asked.join(places.select("id", "place"), "id").join(shape, "dim").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    columns = ["dim", "place", "part", "edge", "rows", "ids", "floors", "packed"]
    met = behind.select(*columns, F.lit(0).alias("kind")).unionByName(ahead.select(*columns, F.lit(1).alias("kind")))
    met = met.repartition("dim", "place", "part").sortWithinPartitions("dim", "place", "part", "kind", F.col("edge").desc())
    found = met.mapInArrow(_search(k, turns), "query_row long, query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_row")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings")).drop("query_row")


#: All pairs, for small tables.
SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings),
p AS (SELECT q.n, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON v.n <> q.n WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS place FROM p)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 10
"""
