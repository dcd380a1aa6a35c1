"""Queries of vector search and of projections for machine-learning corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import training, vectors
from .registry import Area, read

area = Area()
QUERY = 3
V = f"WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = {QUERY}), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) "
SCORES = {
    "cosine": "list_inner_product(v.e, q.e) / (sqrt(list_inner_product(v.e, v.e)) * sqrt(list_inner_product(q.e, q.e)))",
    "dot": "list_inner_product(v.e, q.e)",
    "l2": "0.0 - list_sum(list_transform(range(1, len(v.e) + 1), lambda i: (v.e[i] - q.e[i]) * (v.e[i] - q.e[i])))",
    "l1": "0.0 - list_sum(list_transform(range(1, len(v.e) + 1), lambda i: abs(v.e[i] - q.e[i])))",
}


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


for _metric, _score in SCORES.items():
    area.frame(f"vec_{_metric}_topk", lambda s, d, m=_metric: _rounded(vectors.search(read(s, d, "embeddings"), vectors.vector_of(read(s, d, "embeddings"), QUERY), 10, m)), V + f"SELECT vec_id, 'all' AS target_kind, round({_score}, 6) AS score FROM v, q ORDER BY {_score} DESC, vec_id LIMIT 10")
area.chain("vec_similar", f"table(embeddings).similar(vectorRef: {QUERY}, k: 5, index: hnsw).select(vec_id, authority)", V + f"SELECT vec_id, 'ExactFlatFallback' AS authority FROM v, q ORDER BY {SCORES['cosine']} DESC, vec_id LIMIT 5")
area.chain("vec_embedding", f"table(embeddings).embedding(vectorRef: {QUERY}).select(vec_id, label)", f"SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id = {QUERY}")
area.frame("vec_ivf", lambda s, d: _rounded(vectors.indexed(read(s, d, "embeddings"), vectors.vector_of(read(s, d, "embeddings"), QUERY), 10, "cosine", "ivf_flat")), V + f"SELECT vec_id, 'all' AS target_kind, round({SCORES['cosine']}, 6) AS score, 'IvfFlat' AS authority FROM v, q ORDER BY {SCORES['cosine']} DESC, vec_id LIMIT 10")
area.frame("vec_pq", lambda s, d: _rounded(vectors.indexed(read(s, d, "embeddings"), vectors.vector_of(read(s, d, "embeddings"), QUERY), 10, "cosine", "ivf_pq")), None)
#: Words are told apart by Spark's own hash, which SQL does not have; the numbers below do not depend on it.
area.frame("vec_build", lambda s, d: _built(s, d), "SELECT item_id AS vec_id, CAST(32 AS BIGINT) AS dimension, CAST(1 AS DOUBLE) AS length, count(*) OVER (PARTITION BY list_sort(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''))) AS alike FROM benchmark")


def _built(spark, folder):
    """Built vectors: their size, their length, and how many texts have the same words and so the same vector."""
    from pyspark.sql.window import Window

    made = vectors.hashed_vectors(read(spark, folder, "benchmark"), "item_id", "text")
    length = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 6)
    return made.select("vec_id", F.size("embedding").alias("dimension"), length.alias("length"), F.count("*").over(Window.partitionBy("embedding")).alias("alike"))



area.frame("ai_chunks", lambda s, d: training.chunks(read(s, d, "documents"), "doc_id", "text", 500),
           """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''),
e AS (SELECT doc_id, c, i, strlen(c) AS b, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM c),
g AS (SELECT doc_id, CAST((upto - 1) // 500 AS BIGINT) AS chunk, CAST(min(upto - b) AS BIGINT) AS start, CAST(sum(b) AS BIGINT) AS length, CAST(min(i) - 1 AS BIGINT) AS scalar_start, count(*) AS scalars, string_agg(c, '' ORDER BY i) AS payload FROM e GROUP BY 1, 2)
SELECT doc_id, chunk, start, length, scalar_start, scalars, sha256(payload) AS sha256, payload FROM g
UNION ALL SELECT doc_id, 0, 0, 0, 0, 0, sha256(''), '' FROM documents WHERE text = ''""")  # fmt: skip
area.frame("ai_token_spans", lambda s, d: training.token_spans(read(s, d, "benchmark"), "item_id", "text", 16),
           r"""WITH p AS (SELECT item_id, unnest(regexp_extract_all(text, '\s*\S+')) AS piece, generate_subscripts(regexp_extract_all(text, '\s*\S+'), 1) - 1 AS token FROM benchmark),
e AS (SELECT *, sum(length(piece)) OVER (PARTITION BY item_id ORDER BY token ROWS UNBOUNDED PRECEDING) AS upto, length(regexp_replace(piece, '^\s+', '')) AS n FROM p)
SELECT item_id, CAST(token AS BIGINT) AS token, CAST(upto - n AS BIGINT) AS start, CAST(n AS BIGINT) AS length, CAST(token // 16 AS BIGINT) AS block FROM e""".replace("\\\\", "\\"))  # fmt: skip
area.frame("ai_context", lambda s, d: training.context(training.chunks(read(s, d, "documents"), "doc_id", "text", 500), False).select("doc_id", "chunk", "context.text", "context.withheld"), "SELECT doc_id, unnest(range(0, greatest(1, CAST(ceil(strlen(text) / 500.0) AS BIGINT)))) AS chunk, CAST(NULL AS VARCHAR) AS text, true AS withheld FROM documents WHERE text IS NOT NULL")
area.frame("ai_tokens", lambda s, d: training.tokens(read(s, d, "benchmark"), "item_id", "text").select("item_id", "n_tokens"), r"SELECT item_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS n_tokens FROM benchmark")
NUMBER = "CAST(CAST('0x' || " + " || ".join(f"substr(h, {i}, 2)" for i in range(15, 0, -2)) + " AS UBIGINT) % 1000000 AS BIGINT)"
SPLIT = f"WITH k AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h, text, source FROM documents), s AS (SELECT *, CASE WHEN {NUMBER} < 980000 THEN 'train' WHEN {NUMBER} < 990000 THEN 'validation' ELSE 'test' END AS split FROM k) "
area.frame("ai_split", lambda s, d: read(s, d, "documents").select("doc_id", training.split_of(F.col("doc_id")).alias("split")), SPLIT + "SELECT doc_id, split FROM s")
area.frame("ai_samples", lambda s, d: training.samples(read(s, d, "documents"), read(s, d, "labels")).select("doc_id", "split", "dedup_group", "quality_ppm", "source"), SPLIT + "SELECT s.doc_id, split, sha256(text) AS dedup_group, coalesce(quality, 1) * CAST(1000000 AS BIGINT) AS quality_ppm, source FROM s LEFT JOIN labels l ON l.doc_id = s.doc_id")
area.frame("ai_split_counts", lambda s, d: training.split_counts(training.samples(read(s, d, "documents"), read(s, d, "labels"))), SPLIT + "SELECT split, count(*) AS samples FROM s GROUP BY 1")
area.frame("ai_contamination", lambda s, d: training.contamination(training.samples(read(s, d, "documents"), read(s, d, "labels"))), SPLIT + "SELECT sha256(text) AS dedup_group, count(*) AS samples FROM s GROUP BY 1 HAVING bool_or(split = 'train') AND bool_or(split <> 'train')")
area.frame("ai_chat_import", lambda s, d: training.import_chat(read(s, d, "conversations")).select("conv_id", "n_turns", "target", "valid"), "SELECT conv_id, count(*) AS n_turns, max_by(text, turn) FILTER (role = 'assistant') AS target, bool_and(role IN ('system', 'user', 'assistant', 'tool')) AND max_by(role, turn) = 'assistant' AS valid FROM conversations GROUP BY 1")
area.frame("ai_pretrain_import", lambda s, d: training.import_rows(read(s, d, "documents"), "pretrain"), "SELECT text AS input, CAST(NULL AS VARCHAR) AS target, 'pretrain' AS schema FROM documents")
area.frame("ai_archive_diff", lambda s, d: training.archive_diff(read(s, d, "customer").where("c_mktsegment <> 'BUILDING'"), read(s, d, "customer").where("c_mktsegment <> 'FURNITURE'").withColumn("c_acctbal", F.when(F.col("c_mktsegment") == "HOUSEHOLD", -1.0).otherwise(F.col("c_acctbal"))), "c_custkey"), "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'added' WHEN 'FURNITURE' THEN 'removed' ELSE 'changed' END AS change FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') OR c_mktsegment = 'HOUSEHOLD' AND c_acctbal <> -1.0")
area.frame("ai_pack", lambda s, d: training.packs(read(s, d, "documents"), "doc_id", "n_chars", 8192, ["source"]).drop("segment"),
           """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (SELECT source, doc_id, n_chars, i, CAST(0 AS BIGINT) AS pack, CAST(0 AS BIGINT) AS "offset" FROM o WHERE i = 1
  UNION ALL SELECT o.source, o.doc_id, o.n_chars, o.i, CASE WHEN fits THEN f.pack ELSE f.pack + 1 END, CASE WHEN fits THEN f."offset" + f.n_chars ELSE 0 END
  FROM f JOIN o ON o.source IS NOT DISTINCT FROM f.source AND o.i = f.i + 1, LATERAL (SELECT f."offset" + f.n_chars = 0 OR f."offset" + f.n_chars + o.n_chars <= 8192 AS fits) t)
SELECT source, doc_id, n_chars, pack, "offset" FROM f""")  # fmt: skip
area.frame("ai_verify", lambda s, d: training.verify(training.samples(read(s, d, "documents"), read(s, d, "labels"))), "SELECT count(*) AS samples, count(DISTINCT doc_id) AS ids, CAST(0 AS BIGINT) AS without_split, CAST(0 AS BIGINT) AS bad_quality FROM documents")
