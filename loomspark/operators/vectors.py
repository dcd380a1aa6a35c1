"""Vector search over an array column: exact, clustered, and quantised, with exact re-scoring.

The query vector is one row's array, a literal of the plan; scores are aggregates over zipped arrays in doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from .checkpoints import cut

#: Metrics, each a score of which more is better.
METRICS = ("cosine", "dot", "l2", "l1")
INDEXES = ("auto", "flat", "ivf_flat", "ivf_pq", "hnsw", "vamana", "diskann")


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def score(metric: str, a: Column, b: Column) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    if metric == "dot":
        return _sum(a, b, lambda x, y: x * y)
    if metric == "l2":
        return F.lit(0.0) - _sum(a, b, lambda x, y: (x - y) * (x - y))
    if metric == "l1":
        return F.lit(0.0) - _sum(a, b, lambda x, y: F.abs(x - y))
    if metric == "cosine":
        length = F.sqrt(_sum(a, a, lambda x, y: x * y)) * F.sqrt(_sum(b, b, lambda x, y: x * y))
        return F.when(length == 0, F.raise_error(F.lit("E_EXPRESSION: zero vector")).cast("double")).otherwise(_sum(a, b, lambda x, y: x * y) / length)
    raise QueryError("E_AI_ARGUMENT_REQUIRED", f"metric {metric}")


def vector_of(vectors: DataFrame, vec_id) -> list[float]:
    row = vectors.where(F.col("vec_id") == vec_id).select("embedding").first()
    if row is None:
        raise QueryError("E_AI_ARGUMENT_REQUIRED", f"no vector {vec_id}")
    return list(row[0])


def search(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", target: str | None = None) -> DataFrame:
    """The k best of all vectors, ties by target kind and then vec_id: one scan and a top-k of each task."""
    if k < 1:
        raise QueryError("E_AI_ARGUMENT_REQUIRED", "k")
    kind = F.col("target_kind") if "target_kind" in vectors.columns else F.lit("all")
    rows = vectors.withColumn("target_kind", kind)
    if target not in (None, "all"):
        rows = rows.where(F.col("target_kind") == target)
    array = F.array(*[F.lit(float(x)) for x in query])
    return rows.select("vec_id", "target_kind", score(metric, F.col("embedding"), array).alias("score")).orderBy(F.col("score").desc(), "target_kind", "vec_id").limit(k)


def _reach(metric: str, query: list[float], seed: list[float], radius: float) -> float:
    """The best score that a vector within ``radius`` of ``seed`` can have (for cosine, both are of length 1)."""
    import math

    gap = max(0.0, math.dist(query, seed) - radius)
    if metric == "dot":
        return sum(a * b for a, b in zip(query, seed, strict=True)) + math.hypot(*query) * radius
    return {"l2": -gap * gap, "l1": -gap, "cosine": 1 - gap * gap / 2}[metric]


def ivf_search(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", most_clusters: int = 64) -> DataFrame:
    """Clusters around seeds spread by hash. The nearest sqrt(clusters) give a k-th best score; then every cluster is
    scored whose radius lets it reach that score, so the result is that of the exact search. Vectors without a cluster
    (null, or of another dimension) are always scored."""
    import math

    if metric not in METRICS:
        raise QueryError("E_AI_ARGUMENT_REQUIRED", f"metric {metric}")
    unit = metric == "cosine"
    length = lambda v: F.sqrt(_sum(v, v, lambda x, y: x * y))
    plain = F.col("embedding").cast("array<double>")
    point = F.when(length(plain) > 0, F.transform(plain, lambda x: x / length(plain))) if unit else plain
    usable = vectors.where(F.size("embedding") == len(query)).where(~F.exists(point, lambda x: x.isNull() | F.isnan(x)))
    n = vectors.count()
    clusters = max(1, min(most_clusters, int(math.sqrt(n))))
    books = [list(r[0]) for r in usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(clusters).select(point).collect()]
    size = math.hypot(*query)
    if not books or not math.isfinite(size) or (unit and not size):
        return search(vectors, query, k, metric)
    own = [x / size for x in query] if unit else list(map(float, query))
    best = F.array_min(F.array(*[F.struct((-score("l2", F.col("_point"), F.array(*[F.lit(x) for x in b]))).alias("d"), F.lit(i).alias("c")) for i, b in enumerate(books)]))
    whole = (F.size("_point") == len(query)) & ~F.exists("_point", lambda x: x.isNull() | F.isnan(x))
    dealt = cut(vectors.withColumn("_point", point).withColumn("_near", F.when(whole, best)).drop("_point"))
    radii = {r["c"]: math.sqrt(r["d"]) for r in dealt.where("_near is not null").groupBy(F.col("_near.c").alias("c")).agg(F.max("_near.d").alias("d")).collect()}
    order = sorted(radii, key=lambda i: math.dist(own, books[i]))[: max(1, math.ceil(math.sqrt(clusters)))]
    first = [r["score"] for r in search(dealt.where(F.col("_near.c").isin(order)), query, k, metric).collect()]
    reach = {i: _reach(metric, own, books[i], r * (1 + 1e-9) + 1e-9) for i, r in radii.items()}
    floor = first[-1] if len(first) == k else -math.inf
    chosen = [i for i, x in reach.items() if not x < floor - 1e-6 * max(1.0, abs(floor))]
    return search(dealt.where(F.col("_near").isNull() | F.col("_near.c").isin(chosen)).drop("_near"), query, k, metric)


def quantised(x: Column, steps: int = 16) -> Column:
    """Each component as one of 16 steps between -1 and 1."""
    return F.transform(x.cast("array<double>"), lambda v: F.round((F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)) + 1) / 2 * (steps - 1)) / (steps - 1) * 2 - 1)


def pq_search(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", widen: int = 8) -> DataFrame:
    """Candidates by the quantised vectors, max(widen k, 32) of them, scored exactly."""
    array = F.array(*[F.lit(float(x)) for x in query])
    rough = vectors.withColumn("_rough", score("dot", quantised(F.col("embedding")), array)).orderBy(F.col("_rough").desc(), "vec_id").limit(max(widen * k, 32))
    return search(rough.drop("_rough"), query, k, metric)


def indexed(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", index: str = "auto") -> DataFrame:
    """A search labelled with the way it took; graph indexes are not kept here and fall back to the exact one."""
    if index not in INDEXES:
        raise QueryError("E_AI_ARGUMENT_REQUIRED", f"index {index}")
    if index == "ivf_flat":
        return ivf_search(vectors, query, k, metric).withColumn("authority", F.lit("IvfFlat"))
    if index == "ivf_pq":
        return pq_search(vectors, query, k, metric).withColumn("authority", F.lit("IvfPq"))
    return search(vectors, query, k, metric).withColumn("authority", F.lit("ExactFlat" if index in ("auto", "flat") else "ExactFlatFallback"))


def hashed_vectors(texts: DataFrame, key: str, text: str, dimension: int = 32) -> DataFrame:
    """Deterministic local vectors: signed hashes of words summed by place, scaled to length 1."""
    words = texts.select(F.col(key).alias("vec_id"), F.explode(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")).alias("w"))
    placed = words.select("vec_id", F.pmod(F.xxhash64("w"), F.lit(dimension)).cast("int").alias("place"), F.when(F.xxhash64("w", F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))
    summed = placed.groupBy("vec_id", "place").agg(F.sum("sign").alias("s")).groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "s"))).alias("m"))
    array = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    full = summed.select("vec_id", array.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return full.select("vec_id", F.when(norm > 0, F.transform("v", lambda x: x / norm)).otherwise(F.col("v")).alias("embedding"))
