"""Queries on tables: predicates, scalars, joins, aggregates, windows, sets, and the SQL surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import STEPS
from ..operators import relational
from .registry import Area, read

area = Area()
MONEY = "round(CAST(sum(CAST({0} AS DECIMAL(38,10))) AS DOUBLE), 4)"
SUM_PRICE = MONEY.format("o_totalprice")

# ---- predicates and scalars
area.chain("filter_kleene", 'table(customer).where(if(c_acctbal > 0, c_nationkey, null) > 10 || !(c_mktsegment == "BUILDING" && c_acctbal < 5000)).select(c_custkey)',
           "SELECT c_custkey FROM customer WHERE (CASE WHEN c_acctbal > 0 THEN c_nationkey END) > 10 OR NOT (c_mktsegment = 'BUILDING' AND c_acctbal < 5000)")
area.chain("filter_in_null", "table(nation).where(n_regionkey in [1, 2, null]).select(n_nationkey, n_name)", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 2, NULL)")
area.chain("filter_not_in_null", "table(nation).where(!(n_regionkey in [1, null])).select(n_nationkey)", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE NOT (n_regionkey IN (1, NULL))")
area.chain("filter_null_check", "table(customer).where(if(c_acctbal > 0, c_custkey, null).isNull()).select(c_custkey, c_name)", "SELECT c_custkey, c_name FROM customer WHERE (CASE WHEN c_acctbal > 0 THEN c_custkey END) IS NULL")
area.chain("filter_conjoined", 'table(orders).where(o_orderstatus == "F").where(o_totalprice >= 100000).select(o_orderkey)', "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
area.chain("filter_timestamp", 'table(orders).where(o_orderdate >= "1995-01-01T00:00:00Z" && o_orderdate < "1996-01-01T00:00:00Z").select(o_orderkey, o_orderdate)', "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
area.chain("expr_if", 'table(part).select(p_partkey, bucket: if(p_size > 25, "large", "small"), size: if(p_size > 40, null, p_size))', "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS bucket, CAST(CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS BIGINT) AS size FROM part")
area.frame("fn_trim", lambda s, d: read(s, d, "part").select("p_partkey", STEPS["trim"](F.concat(F.lit("\t "), "p_name", F.lit(" \n"))).alias("trimmed")), "SELECT p_partkey, trim(p_name) AS trimmed FROM part")
area.chain("fn_case", "table(customer).select(c_custkey, low: lower(c_mktsegment), up: upper(c_name), same: identity(c_name))", "SELECT c_custkey, lower(c_mktsegment) AS low, upper(c_name) AS up, c_name AS same FROM customer")
area.chain("fn_contains", 'table(part).where(contains(p_type, "AN")).select(p_partkey, p_type)', "SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'AN')")
area.chain("fn_finite", "table(customer).select(c_custkey, finite: isFinite(c_acctbal), nan: isNaN(c_acctbal))", "SELECT c_custkey, isfinite(c_acctbal) AS finite, isnan(c_acctbal) AS nan FROM customer")
area.chain("fn_starts_with", 'table(part).where(startsWith(p_type, "S")).select(p_partkey, p_type)', "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S')")
area.chain("fn_length", "table(documents).select(doc_id, n: length(text))", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
area.chain("fn_length_array", "table(embeddings).select(vec_id, n: length(embedding), has: exists(embedding))", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, embedding IS NOT NULL AND len(embedding) > 0 AS has FROM embeddings")
area.chain("fn_coalesce", "table(part).select(p_partkey, v: coalesce(if(p_size > 25, p_size, null), p_partkey))", "SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_size END, p_partkey) AS v FROM part")
area.chain("fn_cast_int", 'table(orders).select(o_orderkey, v: cast(cast(o_custkey, "utf8"), "int64"))', "SELECT o_orderkey, CAST(CAST(o_custkey AS VARCHAR) AS BIGINT) AS v FROM orders")
area.chain("fn_cast_bool", 'table(labels).select(doc_id, good: cast(if(quality == 1, "true", "false"), "bool"))', "SELECT doc_id, quality = 1 AS good FROM labels")
area.chain("fn_cast_timestamp", 'table(orders).select(o_orderkey, t: cast("1995-06-01 12:30:00", "timestamp_micros"))', "SELECT o_orderkey, TIMESTAMP '1995-06-01 12:30:00' AS t FROM orders")
for _name, _sql in {
    "strip_punctuation": r"regexp_replace(p_name, '[!-/:-@\[-`{-~]', '', 'g')",
    "collapse_whitespace": r"trim(regexp_replace(p_name, '\s+', ' ', 'g'))",
    "sort_tokens": r"array_to_string(list_sort(list_filter(string_split_regex(p_name, '\s+'), lambda t: t <> '')), ' ')",
    "ascii_lower": "lower(p_name)",
    "trim_lower": "lower(trim(p_name))",
    "sha256_hex": "sha256(p_name)",
}.items():
    area.frame(f"norm_{_name}", lambda s, d, step=_name: read(s, d, "part").select("p_partkey", STEPS[step](F.col("p_name")).alias("value")), f"SELECT p_partkey, {_sql} AS value FROM part")
area.frame("norm_parse", lambda s, d: read(s, d, "orders").select("o_orderkey", STEPS["parse_int64"](F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).alias("i"), STEPS["parse_decimal"](F.col("o_custkey").cast("string")).alias("t")), "SELECT o_orderkey, o_custkey AS i, CAST(o_custkey AS VARCHAR) AS t FROM orders")
area.frame("norm_unicode", lambda s, d: read(s, d, "part").select("p_partkey", STEPS["unicode_casefold"](STEPS["unicode_nfkc"](F.col("p_name"))).alias("value")), "SELECT p_partkey, lower(p_name) AS value FROM part")

# ---- order, limits, sets
area.chain("sort_nulls_take_skip", "table(customer).select(c_custkey, v: if(c_acctbal > 0, c_nationkey, null)).orderBy(if(c_acctbal > 0, c_nationkey, null), desc, nulls_last).skip(5).take(20)",
           "SELECT c_custkey, CAST(v AS BIGINT) AS v FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS v FROM customer) ORDER BY v DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 5")
area.chain("topk_orders", "table(orders).select(o_orderkey, o_totalprice).orderBy(o_totalprice, desc).take(10)", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
for _op, _sql in (("union", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT")):
    for _all in (True, False):
        area.chain(f"{_op}_{'all' if _all else 'distinct'}", f"table(customer_keys).{_op}(table(order_keys){'' if _all else ', all: false'})",
                   f"SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer {_sql} {'ALL' if _all else ''} SELECT CAST(s_nationkey AS BIGINT) AS k FROM supplier",
                   catalog=lambda s, d: _keys(s, d))


def _keys(spark, folder):
    from ..sources.catalog import Catalog

    out = Catalog.of_folder(spark, folder)
    out.add("customer_keys", read(spark, folder, "customer").select(F.col("c_nationkey").cast("long").alias("k")))
    return out.add("order_keys", read(spark, folder, "supplier").select(F.col("s_nationkey").cast("long").alias("k")))


area.chain("cte_with", "table(customer).with(n: table(nation)).join(table(n), on: c_nationkey == n.n_nationkey).select(c_custkey, n.n_name)", "WITH n AS (SELECT * FROM nation) SELECT c_custkey, n_name FROM customer JOIN n ON c_nationkey = n_nationkey")
area.chain("cte_recursive_fixpoint", "table(r).withRecursive(name: r, seed: table(seed_keys), step: table(order_keys), key: k, maxIterations: 5).select(k)",
           "SELECT k FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_regionkey = 0) UNION ALL SELECT DISTINCT CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)",
           catalog=lambda s, d: _keys(s, d).add("seed_keys", read(s, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").cast("long").alias("k"))))

# ---- joins
OC = "table(orders) as o"
area.chain("join_inner", f"{OC}.join(table(customer) as c, on: o.o_custkey == c.c_custkey).where(c.c_mktsegment == \"BUILDING\").select(o.o_orderkey, c.c_name)", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
area.chain("join_group_segment", f'{OC}.join(table(customer) as c, on: o.o_custkey == c.c_custkey).groupBy(c.c_mktsegment).select(segment: c.c_mktsegment, n: count(*), total: sum(cast(o.o_totalprice, "decimal128")))', f"SELECT c_mktsegment AS segment, count(*) AS n, {SUM_PRICE} AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
area.chain("join_left", 'table(customer) as c.join(table(orders) as o, on: c.c_custkey == o.o_custkey && o.o_totalprice > 150000, kind: left).select(c.c_custkey, o.o_orderkey)', "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000")
area.chain("join_right", "table(supplier) as s.join(table(nation) as n, on: s.s_nationkey == n.n_nationkey, kind: right).select(s.s_suppkey, n.n_name)", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
area.chain("join_full", "table(supplier) as s.join(table(customer) as c, on: s.s_suppkey == c.c_custkey, kind: full).select(s.s_suppkey, c.c_custkey)", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
area.chain("join_semi", "table(customer) as c.semiJoin(table(orders) as o, on: c.c_custkey == o.o_custkey && o.o_totalprice > 200000).select(c_custkey)", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
area.chain("join_anti", "table(customer) as c.antiJoin(table(orders) as o, on: c.c_custkey == o.o_custkey && o.o_totalprice > 300000).select(c_custkey)", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
area.chain("join_theta_range", "table(nation) as n.join(table(region) as r, on: n.n_regionkey > r.r_regionkey).select(n.n_name, r.r_name)", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey > r_regionkey")
area.chain("join_null_safe", "table(some_keys) as a.join(table(some_keys) as b, on: a.k == b.k, nulls_match: true).select(x: a.k, y: b.k)",
           "WITH s AS (SELECT CASE WHEN n_nationkey < 20 THEN CAST(n_nationkey AS BIGINT) END AS k FROM nation) SELECT a.k AS x, b.k AS y FROM s a JOIN s b ON a.k IS NOT DISTINCT FROM b.k",
           catalog=lambda s, d: _keys(s, d).add("some_keys", read(s, d, "nation").select(F.when(F.col("n_nationkey") < 20, F.col("n_nationkey").cast("long")).alias("k"))))
area.chain("join_multi_star", 'table(lineitem) as l.join(table(orders) as o, on: l.l_orderkey == o.o_orderkey).join(table(customer) as c, on: o.o_custkey == c.c_custkey).join(table(nation) as n, on: c.c_nationkey == n.n_nationkey).groupBy(n.n_name).select(nation: n.n_name, n: count(*), total: sum(cast(l.l_extendedprice, "decimal128")))',
           f"SELECT n_name AS nation, count(*) AS n, {MONEY.format('l_extendedprice')} AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
area.chain("lookup_one", "table(customer) as c.lookup(table(nation) as n, on: c.c_nationkey == n.n_nationkey, cardinality: one, required: true).select(c_custkey, n.n_name)", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
area.chain("lookup_many", "table(nation) as n.lookup(table(supplier) as s, on: n.n_nationkey == s.s_nationkey, cardinality: many).select(n_name, s.s_suppkey)", "SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey")
area.frame("lookup_first_of_many", lambda s, d: relational.guarded_join(read(s, d, "customer").select("c_custkey"), read(s, d, "orders").select("o_custkey", "o_orderkey"), F.expr("c_custkey = o_custkey"), "left", "one", duplicate="first", order=["o_orderkey"]).select("c_custkey", "o_orderkey"), "SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS o_orderkey FROM customer")
area.chain("exists_table", "table(part) as p.where(exists(table(lineitem) as l, on: p.p_partkey == l.l_partkey && l.l_quantity > 49)).select(p_partkey)", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
area.chain("not_exists_table", "table(part) as p.where(!exists(table(lineitem) as l, on: p.p_partkey == l.l_partkey && l.l_quantity > 49)).select(p_partkey)", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
area.frame("overlay_hidden", lambda s, d: _overlay(s, d), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")


def _overlay(spark, folder):
    from ..sources.files import overlay

    customers = read(spark, folder, "customer")
    return overlay(customers, customers.where("c_acctbal < 0").select("c_custkey"), "c_custkey").select("c_custkey")


# ---- aggregates
area.chain("agg_group_status", 'table(orders).groupBy(o_orderstatus).select(o_orderstatus, n: count(*), total: sum(cast(o_totalprice, "decimal128")), least: min(o_totalprice), most: max(o_totalprice))', f"SELECT o_orderstatus, count(*) AS n, {SUM_PRICE} AS total, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1")
area.chain("agg_group_customer", 'table(orders).groupBy(o_custkey).select(o_custkey, n: count(*), total: sum(cast(o_totalprice, "decimal128")))', f"SELECT o_custkey, count(*) AS n, {SUM_PRICE} AS total FROM orders GROUP BY 1")
area.chain("agg_top_customers", "table(orders).groupBy(o_custkey).select(o_custkey, n: count(*)).orderBy(n, desc).take(10)", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
area.chain("agg_count_distinct", "table(orders).select(customers: distinct_count(o_custkey), statuses: distinct_count(o_orderstatus))", "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS statuses FROM orders")
area.chain("agg_global_empty", "table(orders).where(o_orderkey < 0).select(n: count(*), total: sum(o_custkey), least: min(o_totalprice), any: exists(*))", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total, min(o_totalprice) AS least, count(*) > 0 AS any FROM orders WHERE o_orderkey < 0")
area.chain("agg_avg_exact", "table(lineitem).groupBy(l_returnflag).select(l_returnflag, line: avg(l_linenumber), n: count(l_linenumber))", "SELECT l_returnflag, round(avg(l_linenumber), 4) AS line, count(l_linenumber) AS n FROM lineitem GROUP BY 1")
area.chain("agg_exists", "table(customer).groupBy(c_nationkey).select(c_nationkey, rich: exists(if(c_acctbal > 9000, c_custkey, null)))", "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(CASE WHEN c_acctbal > 9000 THEN c_custkey END) > 0 AS rich FROM customer GROUP BY 1")
area.chain("agg_thresholded", "table(customer).groupBy(c_nationkey, c_mktsegment).policy(allow_thresholded(10)).select(c_nationkey, c_mktsegment, n: count(*))", "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment, CASE WHEN count(*) >= 10 THEN count(*) END AS n, count(*) < 10 AS n_suppressed FROM customer GROUP BY 1, 2")
area.chain("agg_topk_values", "table(lineitem).groupBy(l_partkey).select(l_partkey, n: count(*)).orderBy(n, desc).take(20)", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
area.chain("agg_histogram", "table(lineitem).groupBy(l_quantity).select(l_quantity, n: count(*))", "SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1")
area.frame("agg_bool_counts", lambda s, d: read(s, d, "labels").agg(F.count_if(F.col("quality") == 1).alias("n_true"), F.count_if(F.col("quality") == 0).alias("n_false")), "SELECT count(*) FILTER (quality = 1) AS n_true, count(*) FILTER (quality = 0) AS n_false FROM labels")
for _policy, _sql in {"checked": "CAST(sum(v) AS BIGINT)", "saturating": "CAST(least(greatest(sum(v), -9223372036854775808), 9223372036854775807) AS BIGINT)", "wrapping": "CAST(((sum(v) + 9223372036854775808) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 - 9223372036854775808 AS BIGINT)", "widened": "round(CAST(sum(v) AS DOUBLE), 4)"}.items():
    # the order keys of each status, so large (but for the checked sum) that their sums leave the range of 64 bits
    _by = 1 if _policy == "checked" else 4_000_000_000_000_000
    area.frame(f"agg_overflow_{_policy}", lambda s, d, p=_policy, by=_by: read(s, d, "orders").select("o_orderstatus", ((F.col("o_orderkey") % 2000 - 900) * F.lit(by)).alias("v")).groupBy("o_orderstatus").agg(relational.summed("v", p).alias("v")), f"SELECT o_orderstatus, {_sql} AS v FROM (SELECT o_orderstatus, CAST((o_orderkey % 2000 - 900) AS HUGEINT) * {_by} AS v FROM orders) GROUP BY 1")
area.frame("agg_approx_distinct_bound", lambda s, d: _distinct_near(read(s, d, "lineitem")), "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders, true AS parts_near, true AS orders_near FROM lineitem")
area.frame("agg_quantile_bound", lambda s, d: _quantiles_near(read(s, d, "lineitem")), "SELECT CAST(q AS DOUBLE) AS q, true AS near FROM (VALUES (0.5), (0.9), (0.99)) t(q)")


def _distinct_near(lines):
    """Exact counts, and whether the approximate ones are near. One aggregate of all four would group the lines by the
    exact keys and carry both sketches in each group; so each is an aggregate of its own, joined as single rows."""
    sketched = lines.agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey")).alias("b"))
    parts, orders = lines.agg(F.count_distinct("l_partkey").alias("parts")), lines.agg(F.count_distinct("l_orderkey").alias("orders"))
    near = lambda found, exact: F.abs(F.col(found) / F.col(exact) - 1) <= 0.08
    return sketched.crossJoin(parts).crossJoin(orders).select("parts", "orders", near("a", "parts").alias("parts_near"), near("b", "orders").alias("orders_near"))


def _quantiles_near(lines):
    """Whether the rank of each approximate quantile is within one per cent of the rows of its own."""
    found = lines.agg(F.percentile_approx("l_extendedprice", [0.5, 0.9, 0.99]).alias("v")).select(F.explode(F.arrays_zip(F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)).alias("q"), "v")).alias("x")).select("x.q", "x.v")
    counted = lines.join(F.broadcast(found)).groupBy("q").agg(F.avg((F.col("l_extendedprice") <= F.col("v")).cast("double")).alias("rank"))
    return counted.select("q", (F.abs(F.col("rank") - F.col("q")) <= 0.01).alias("near"))


area.frame("agg_approx_distinct", lambda s, d: read(s, d, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey")).alias("orders")), None)
area.frame("agg_quantile_sketch", lambda s, d: read(s, d, "lineitem").agg(F.percentile_approx("l_extendedprice", [0.5, 0.9, 0.99]).alias("quantiles")), None)

# ---- windows
WINDOW = 'table(orders).window(partitionBy: o_custkey, orderBy: o_orderkey{0})'
OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey NULLS LAST{0})"
ROWS = " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
area.chain("win_row_number", WINDOW.format("") + ".select(o_orderkey, rn: row_number())", f"SELECT o_orderkey, row_number() {OVER.format('')} AS rn FROM orders")
area.chain("win_rank_dense", "table(orders).window(partitionBy: o_custkey, orderBy: o_orderpriority).select(o_orderkey, r: rank(), d: dense_rank())", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority NULLS LAST)")
area.chain("win_lag_lead", WINDOW.format("") + ".select(o_orderkey, before: lag(o_orderkey), two: lag(o_orderkey, 2), after: lead(o_orderkey))", f"SELECT o_orderkey, lag(o_orderkey) {OVER.format('')} AS before, lag(o_orderkey, 2) {OVER.format('')} AS two, lead(o_orderkey) {OVER.format('')} AS after FROM orders")
area.chain("win_first_last", WINDOW.format("") + ".select(o_orderkey, f: first_value(o_orderkey), l: last_value(o_orderkey))", f"SELECT o_orderkey, first_value(o_orderkey) {OVER.format(ROWS)} AS f, last_value(o_orderkey) {OVER.format(ROWS)} AS l FROM orders")
area.chain("win_running_sum", WINDOW.format("") + '.select(o_orderkey, s: sum(cast(o_totalprice, "decimal128")), n: count(*))', f"SELECT o_orderkey, round(CAST(sum(CAST(o_totalprice AS DECIMAL(38,10))) {OVER.format(ROWS)} AS DOUBLE), 4) AS s, count(*) {OVER.format(ROWS)} AS n FROM orders")
area.chain("win_full_frame", WINDOW.format(", frame: rows, start: unbounded_preceding, end: unbounded_following") + ".select(o_orderkey, most: max(o_totalprice), n: count(*))", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
area.chain("win_following_frame", WINDOW.format(", frame: range, start: current_row, end: unbounded_following") + ".select(o_orderkey, least: min(o_totalprice))", f"SELECT o_orderkey, min(o_totalprice) {OVER.format(' ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')} AS least FROM orders")
area.chain("win_topn_filter", WINDOW.format("") + ".where(row_number() <= 2).select(o_custkey, o_orderkey)", f"SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() {OVER.format('')} AS rn FROM orders) WHERE rn <= 2")

# ---- SQL surface
area.statement("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
area.statement("sql_rollup", "SELECT c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)", "SELECT c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
area.statement("sql_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
area.statement("sql_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
area.statement("sql_between_like", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type LIKE 'S%' AND p_brand NOT IN ('Brand#11', 'Brand#12')")
area.statement("sql_ntile", "SELECT c_custkey, CAST(ntile(4) OVER (ORDER BY c_acctbal, c_custkey) AS BIGINT) AS q FROM customer")
area.statement("sql_recursive", "WITH RECURSIVE t(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t")

# ---- the published mix of analytical, operational and join queries
TOTAL = "round(CAST(sum(CAST(o_totalprice AS DECIMAL(38,10))) AS DOUBLE), 4) AS total"
for _name, _sql in {
    "olap_narrow_projection": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000",
    "olap_group_status": f"SELECT o_orderstatus, count(*) AS n, {TOTAL} FROM orders GROUP BY o_orderstatus",
    "olap_group_customer": f"SELECT o_custkey, count(*) AS n, {TOTAL} FROM orders GROUP BY o_custkey",
    "olap_top_customers": "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10",
    "olap_count_distinct_customers": "SELECT count(DISTINCT o_custkey) AS customers FROM orders",
    "operational_point_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 42",
    "operational_small_in_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 77, 777)",
    "operational_latest_customer": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 1",
    "operational_zero_match": "SELECT o_orderkey FROM orders WHERE o_orderkey = -1",
    "join_fact_customer_region": f"SELECT c_nationkey * CAST(1 AS BIGINT) AS nation, count(*) AS n, {TOTAL} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey",
    "join_star_region_category": "SELECT r_name, p_brand, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey GROUP BY r_name, p_brand",
    "join_selective_dimensions": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size = 15 AND s_nationkey = 3",
    "join_left_stocked_products": "SELECT p_partkey, l_orderkey FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 45",
    "join_semi_customer_tier": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 9000)",
    "join_anti_unstocked_products": "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)",
}.items():
    area.statement(_name, _sql)
