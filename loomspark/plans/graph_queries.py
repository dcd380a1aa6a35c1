"""Queries on graphs: a ring of nations for walks and algorithms, and customers, orders and parts for wide operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..operators.checkpoints import cut
from ..sources.catalog import Catalog
from .registry import Area, read

area = Area()


def nations(spark, folder):
    """(nodes, edges): two edges for each nation."""
    n = read(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    near = n.select(F.concat(F.lit("a"), "id").alias("edge"), F.col("id").alias("src"), ((F.col("id") * 7 + 3) % 25).alias("dst"), ((F.col("id") * 5) % 11).cast("double").alias("weight"))
    far = n.select(F.concat(F.lit("b"), "id").alias("edge"), F.col("id").alias("src"), ((F.col("id") * 3 + 1) % 25).alias("dst"), ((F.col("id") * 3) % 13).cast("double").alias("weight"))
    return n, near.unionByName(far)


def parts(spark, folder):
    """customers to the parts of their orders."""
    pairs = read(spark, folder, "orders").join(read(spark, folder, "lineitem"), F.expr("o_orderkey = l_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    edges = pairs.withColumn("edge", F.concat_ws(">", "src", "dst"))
    nodes = read(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")).union(read(spark, folder, "part").select(F.concat(F.lit("p"), "p_partkey")))
    return nodes, edges


def places(spark, folder):
    """supplier to nation to region."""
    s, n = read(spark, folder, "supplier"), read(spark, folder, "nation")
    one = s.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    two = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return one.union(two).withColumn("edge", F.concat_ws(">", "src", "dst"))


N = """n AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation),
e AS (SELECT 'a' || id AS edge, id AS src, (id * 7 + 3) % 25 AS dst FROM n UNION ALL SELECT 'b' || id, id, (id * 3 + 1) % 25 FROM n)"""
P = """pairs AS (SELECT DISTINCT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
nodes AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'p' || p_partkey FROM part)"""
WALK = "WITH RECURSIVE " + N + """, w(start, node, nodes, edges, depth) AS (
  SELECT id, id, [id], CAST([] AS VARCHAR[]), 0 FROM n
  UNION ALL SELECT start, e.dst, list_append(nodes, e.dst), list_append(edges, e.edge), depth + 1 FROM w JOIN e ON e.src = w.node WHERE depth < 3 {0})
SELECT start, node, array_to_string(edges, '/') AS trace, CAST(depth AS BIGINT) AS depth FROM w WHERE depth >= 1"""


def _traced(df):
    return df.select("start", "node", F.array_join("edges", "/").alias("trace"), F.col("depth").cast("long").alias("depth"))


for _mode, _when in (("walk", ""), ("trail", "AND NOT list_contains(edges, e.edge)"), ("simple_path", "AND NOT list_contains(edges, e.edge) AND NOT list_contains(nodes, e.dst)")):
    area.frame(f"graph_traverse_{_mode}", lambda s, d, mode=_mode: _traced(graph.traverse(*nations(s, d), 1, 3, mode)), WALK.format(_when))
area.frame("graph_traverse_end_node", lambda s, d: graph.traverse(*nations(s, d), 0, 3, "walk", "end_node").select("start", "node", F.col("depth").cast("long").alias("depth")),
           "WITH RECURSIVE " + N + ", w(start, node, depth) AS (SELECT id, id, 0 FROM n UNION SELECT start, e.dst, depth + 1 FROM w JOIN e ON e.src = w.node WHERE depth < 3) SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY 1, 2")
REACH = "WITH RECURSIVE " + N + ", w(start, node, depth) AS (SELECT id, id, 0 FROM n UNION SELECT start, e.dst, depth + 1 FROM w JOIN e ON e.src = w.node WHERE depth < {0}), d AS (SELECT start, node, min(depth) AS depth FROM w GROUP BY 1, 2) "
area.frame("graph_reachable", lambda s, d: graph.reachable(*nations(s, d), 3), REACH.format(3) + "SELECT start AS id, count(*) > 1 AS reachable, count(*) - 1 AS reachable_count FROM d GROUP BY 1")
area.frame("graph_shortest", lambda s, d: graph.shortest(nations(s, d)[0], nations(s, d)[1], nations(s, d)[0].where("id in (4, 9)")), REACH.format(8) + "SELECT n.id, CAST(min(d.depth) FILTER (d.depth > 0 AND d.node IN (4, 9)) AS BIGINT) AS shortest_distance FROM n LEFT JOIN d ON d.start = n.id GROUP BY n.id")
area.frame("graph_closeness", lambda s, d: graph.closeness(*nations(s, d)).select("id", F.round("centrality", 6).alias("centrality")), REACH.format(24) + "SELECT start AS id, CASE WHEN count(*) = 1 THEN 0 ELSE round((count(*) - 1) / CAST(sum(depth) AS DOUBLE), 6) END AS centrality FROM d GROUP BY 1")
area.frame("graph_all_paths", lambda s, d: graph.all_paths(*nations(s, d), 3).groupBy("start", "node").agg(F.count("*").alias("paths")), WALK.format("AND NOT list_contains(edges, e.edge) AND NOT list_contains(nodes, e.dst)").replace("SELECT start, node, array_to_string(edges, '/') AS trace, CAST(depth AS BIGINT) AS depth FROM w WHERE depth >= 1", "SELECT start, node, count(*) AS paths FROM w WHERE depth >= 1 GROUP BY 1, 2"))
area.frame("graph_hop", lambda s, d: graph.hop(read(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("supplier")), places(s, d), read(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id")), "supplier", "edge", "nation").select("supplier", "edge", "nation"), "SELECT 's' || s_suppkey AS supplier, 's' || s_suppkey || '>' || 'n' || s_nationkey AS edge, 'n' || s_nationkey AS nation FROM supplier")
area.frame("graph_degree", lambda s, d: graph.degree(*parts(s, d)), "WITH " + P + ", o AS (SELECT src AS id, count(*) AS n FROM pairs GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n FROM pairs GROUP BY 1) SELECT nodes.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree FROM nodes LEFT JOIN o ON o.id = nodes.id LEFT JOIN i ON i.id = nodes.id")
area.frame("graph_degree_centrality", lambda s, d: graph.degree_centrality(*parts(s, d)).select("id", F.round("centrality", 6).alias("centrality")), "WITH " + P + ", a AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM pairs UNION ALL SELECT dst FROM pairs) GROUP BY 1) SELECT nodes.id, round(coalesce(a.n, 0) / (SELECT CAST(count(*) - 1 AS DOUBLE) FROM nodes), 6) AS centrality FROM nodes LEFT JOIN a ON a.id = nodes.id")
area.frame("graph_triangles", lambda s, d: graph.triangles(*_both(s, d)), "WITH " + N + ", b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst) SELECT n.id, CAST(coalesce(floor(count(z.src) / 2), 0) AS BIGINT) AS triangles FROM n LEFT JOIN b x ON x.src = n.id LEFT JOIN b y ON y.src = n.id LEFT JOIN b z ON z.src = x.dst AND z.dst = y.dst GROUP BY n.id")
area.frame("graph_clustering", lambda s, d: graph.clustering(*_both(s, d)).select("id", F.round("clustering", 6).alias("clustering")), "WITH " + N + ", b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst), t AS (SELECT x.src AS id, floor(count(*) / 2) AS t FROM b x JOIN b y ON y.src = x.src JOIN b z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1), g AS (SELECT src AS id, count(*) AS d FROM b GROUP BY 1) SELECT n.id, CASE WHEN g.d >= 2 THEN round(coalesce(t.t, 0) / (g.d * (g.d - 1) / 2.0), 6) ELSE 0.0 END AS clustering FROM n LEFT JOIN g ON g.id = n.id LEFT JOIN t ON t.id = n.id")


def _both(spark, folder):
    nodes, edges = nations(spark, folder)
    return nodes, graph.oriented(edges, "either")


area.frame("graph_weak_components", lambda s, d: graph.weak_components(*nations(s, d)),
           "WITH RECURSIVE " + N + ", b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(a, z) AS (SELECT src, src FROM b UNION SELECT r.a, b.dst FROM r JOIN b ON b.src = r.z), l AS (SELECT a, min(z) AS low FROM r GROUP BY 1) SELECT n.id, coalesce(dense_rank() OVER (ORDER BY l.low NULLS LAST), 0) * CASE WHEN l.a IS NULL THEN 0 ELSE 1 END AS component_id FROM n LEFT JOIN l ON l.a = n.id")
area.frame("graph_scc", lambda s, d: graph.strong_components(*nations(s, d)), "WITH RECURSIVE " + N + ", r(a, z) AS (SELECT id, id FROM n UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.z) SELECT x.a AS id, min(x.z) AS component FROM r x JOIN r y ON y.a = x.z AND y.z = x.a GROUP BY 1")
area.frame("graph_betweenness", lambda s, d: graph.betweenness(*nations(s, d)).select("id", F.round("centrality", 6).alias("centrality")), REACH.format(24) + """, q AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst),
p(start, node, nodes, depth) AS (SELECT id, id, [id], 0 FROM n UNION ALL SELECT p.start, q.dst, list_append(p.nodes, q.dst), p.depth + 1 FROM p JOIN q ON q.src = p.node JOIN d ON d.start = p.start AND d.node = q.dst AND d.depth = p.depth + 1),
t AS (SELECT start, node, count(*) AS many FROM p GROUP BY 1, 2), i AS (SELECT p.start, p.node, unnest(p.nodes[2:len(p.nodes) - 1]) AS id, many FROM p JOIN t ON t.start = p.start AND t.node = p.node WHERE len(p.nodes) > 2)
SELECT n.id, round(coalesce(sum(1.0::DOUBLE / many), 0), 6) AS centrality FROM n LEFT JOIN i ON i.id = n.id GROUP BY n.id""")
area.frame("graph_tree_bfs", lambda s, d: graph.spanning_tree(*nations(s, d)), None)
area.frame("graph_tree_dfs", lambda s, d: graph.spanning_tree(*nations(s, d), "dfs"), None)
area.frame("graph_tree_min_weight", lambda s, d: graph.spanning_tree(*nations(s, d), "min_weight", "weight"), None)


# ---- the same operators on graphs that grow with the data
def trade(spark, folder, once=True):
    """customers, suppliers and parts, with an edge between any two that meet in a line of an order, for each line or once."""
    lines = read(spark, folder, "orders").join(read(spark, folder, "lineitem"), F.expr("o_orderkey = l_orderkey"))
    c, s, p = (F.concat(F.lit(x), k) for x, k in (("c", "o_custkey"), ("s", "l_suppkey"), ("p", "l_partkey")))
    pairs = lines.select(F.explode(F.array(*[F.struct(a.alias("src"), b.alias("dst")) for a, b in ((c, s), (c, p), (s, p))])).alias("e")).select("e.*")
    edges = (pairs.distinct() if once else pairs).withColumn("edge", F.concat_ws(">", "src", "dst"))
    nodes = read(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return nodes.union(read(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_suppkey"))).union(read(spark, folder, "part").select(F.concat(F.lit("p"), "p_partkey"))), edges


TRADE = """lines AS (SELECT 'c' || o_custkey AS c, 's' || l_suppkey AS s, 'p' || l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
cs AS (SELECT DISTINCT c, s FROM lines), cp AS (SELECT DISTINCT c, p FROM lines), sp AS (SELECT DISTINCT s, p FROM lines),
nodes AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier UNION ALL SELECT 'p' || p_partkey FROM part)"""


def _either(spark, folder):
    nodes, edges = trade(spark, folder)
    return nodes, graph.oriented(edges, "either")


area.frame("graph_triangles_trade", lambda s, d: graph.triangles(*_either(s, d)), "WITH " + TRADE + """, t AS (SELECT cs.c, cs.s, cp.p FROM cs JOIN cp ON cp.c = cs.c JOIN sp ON sp.s = cs.s AND sp.p = cp.p),
n AS (SELECT id, count(*) AS t FROM (SELECT unnest([c, s, p]) AS id FROM t) GROUP BY 1) SELECT nodes.id, coalesce(n.t, 0) AS triangles FROM nodes LEFT JOIN n ON n.id = nodes.id""")
RANKS = "WITH " + P + ", n AS (SELECT count(*) AS n FROM nodes), many AS (SELECT src, count(*) AS many FROM pairs GROUP BY 1), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT n FROM n) AS rank FROM nodes)"
for _i in range(1, 5):
    RANKS += f""", i{_i} AS (SELECT dst AS id, sum(rank / many) AS x FROM pairs JOIN many USING (src) JOIN r{_i - 1} ON r{_i - 1}.id = pairs.src GROUP BY 1),
r{_i} AS (SELECT nodes.id, (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{_i - 1} WHERE id NOT IN (SELECT src FROM many))) / (SELECT n FROM n) + 0.85 * coalesce(x, 0) AS rank FROM nodes LEFT JOIN i{_i} ON i{_i}.id = nodes.id)"""
area.frame("graph_pagerank_parts", lambda s, d: graph.page_rank(*parts(s, d), iterations=4).select("id", F.round(F.col("rank") * 1000, 6).alias("rank")), RANKS + " SELECT id, round(rank * 1000, 6) AS rank FROM r4")
HITS = "WITH " + P + ", s0 AS (SELECT id, 1.0::DOUBLE AS hub FROM nodes)"
for _i in range(1, 4):
    HITS += f""", x{_i} AS (SELECT dst AS id, sum(hub) AS a FROM pairs JOIN s{_i - 1} ON id = src GROUP BY 1), a{_i} AS (SELECT id, a / (SELECT sqrt(sum(a * a)) FROM x{_i}) AS a FROM x{_i}),
y{_i} AS (SELECT src AS id, sum(a) AS h FROM pairs JOIN a{_i} ON id = dst GROUP BY 1), s{_i} AS (SELECT id, h / (SELECT sqrt(sum(h * h)) FROM y{_i}) AS hub FROM y{_i})"""
area.frame("graph_hits_parts", lambda s, d: graph.hits(*parts(s, d), iterations=3).select("id", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority")), HITS + " SELECT nodes.id, round(coalesce(hub, 0), 6) AS hub, round(coalesce(a, 0), 6) AS authority FROM nodes LEFT JOIN s3 ON s3.id = nodes.id LEFT JOIN a3 ON a3.id = nodes.id")
LABELS = "WITH " + P + ", b AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs), l0 AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS label FROM nodes)"
for _i in range(1, 4):
    LABELS += f""", v{_i} AS (SELECT src AS id, label, count(*) AS n FROM b JOIN l{_i - 1} ON id = dst GROUP BY 1, 2), w{_i} AS (SELECT id, arg_max(label, (n, -label)) AS best FROM v{_i} GROUP BY 1),
l{_i} AS (SELECT l{_i - 1}.id, coalesce(best, label) AS label FROM l{_i - 1} LEFT JOIN w{_i} ON w{_i}.id = l{_i - 1}.id)"""
area.frame("graph_lpa_parts", lambda s, d: graph.communities(*parts(s, d), 3), LABELS + " SELECT id, CAST(label AS BIGINT) AS community FROM l3")
#: Suppliers, nations and regions: a forest of one tree for each region, whose distances and parents can be told.
FOREST = """regions AS (SELECT r_regionkey, dense_rank() OVER (ORDER BY least('r' || r_regionkey, n, coalesce(s, 'z'))) AS place FROM region
  JOIN (SELECT n_regionkey, min('n' || n_nationkey) AS n FROM nation GROUP BY 1) ON n_regionkey = r_regionkey LEFT JOIN (SELECT n_regionkey AS k, min('s' || s_suppkey) AS s FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1) ON k = r_regionkey)"""
area.frame("graph_components_places", lambda s, d: graph.weak_components(_placed(s, d), places(s, d)), "WITH " + FOREST + " SELECT 'r' || r_regionkey AS id, place AS component_id FROM regions UNION ALL SELECT 'n' || n_nationkey, place FROM nation JOIN regions ON r_regionkey = n_regionkey UNION ALL SELECT 's' || s_suppkey, place FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN regions ON r_regionkey = n_regionkey")
area.frame("graph_tree_bfs_trade", lambda s, d: _tree_check(s, d, "bfs"), "WITH RECURSIVE " + TRADE + """, b AS (SELECT c AS src, s AS dst FROM cs UNION ALL SELECT s, c FROM cs UNION ALL SELECT c, p FROM cp UNION ALL SELECT p, c FROM cp UNION ALL SELECT s, p FROM sp UNION ALL SELECT p, s FROM sp),
far(id, depth) AS (SELECT min(src), 0 FROM b UNION SELECT b.dst, far.depth + 1 FROM far JOIN b ON b.src = far.id WHERE far.depth < 4), best AS (SELECT id, min(depth) AS depth FROM far GROUP BY 1)
SELECT nodes.id, CAST(coalesce(depth, 0) AS BIGINT) AS depth, true AS sound FROM nodes LEFT JOIN best ON best.id = nodes.id""")


def _placed(spark, folder):
    edges = places(spark, folder)
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def _tree_check(spark, folder, kind):
    """Depths of a tree, and whether each parent is a neighbour of the level above."""
    nodes, edges = trade(spark, folder, once=False)
    edges = cut(edges.select("src", "dst"))
    tree = graph.spanning_tree(nodes, edges, kind)
    over = tree.select(F.col("id").alias("tree_parent"), F.col("tree_depth").alias("above"))
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    sides = tree.where("tree_parent is not null").select("id", *ends("id", "tree_parent")).join(edges.select(*ends("src", "dst")), ["a", "b"], "left_semi").select("id", F.lit(True).alias("side"))
    told = tree.join(over, "tree_parent", "left").join(sides, "id", "left")
    sound = F.col("tree_parent").isNull() | (F.col("side") & (F.col("above") + 1 == F.col("tree_depth")))
    return told.select("id", F.col("tree_depth").alias("depth"), F.coalesce(sound, F.lit(False)).alias("sound"))


def catalog(spark, folder) -> Catalog:
    """Suppliers, nations and regions as objects, and their places as associations."""
    from ..operators.temporal import KEY

    out = Catalog.of_folder(spark, folder)
    told = None
    for name, key, letter in (("supplier", "s_suppkey", "s"), ("nation", "n_nationkey", "n"), ("region", "r_regionkey", "r")):
        rows = read(spark, folder, name).select(F.lit(name).alias("object_type"), F.lit(0).cast("long").alias("branch_key"), F.concat(F.lit(letter), key).alias("goid"))
        told = rows if told is None else told.unionByName(rows)
    out.records = told.select(*KEY, F.concat(F.lit("r-"), "goid").alias("record_id"), F.lit(0).cast("long").alias("ts_us"), F.lit(1).cast("long").alias("csn"), F.lit("baseline").alias("record_kind"), F.create_map(F.lit("name"), F.col("goid")).alias("props"))
    edges = places(spark, folder)
    out.edges = edges.select(F.lit("located_in").alias("assoc_type"), F.col("edge").alias("assoc_goid"), F.col("src").alias("source_goid"), F.col("dst").alias("target_goid"), F.lit(None).cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return out


area.chain("root_node", "node(nation).select(goid)", "SELECT 'n' || n_nationkey AS goid FROM nation", catalog)
area.chain("root_edge", "edge(located_in).select(assoc_goid, source_goid, target_goid)", "SELECT a || '>' || b AS assoc_goid, a AS source_goid, b AS target_goid FROM (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)", catalog)
area.chain("root_path", "path(node(supplier) as s.out(edge(located_in) as e).to(node(nation) as n).out(edge(located_in) as f).to(node(region) as r)).select(s, n, r)", "SELECT 's' || s_suppkey AS s, 'n' || n_nationkey AS n, 'r' || n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey", catalog)
area.chain("exists_association", "object(nation).where(exists(in(located_in))).select(goid)", "SELECT 'n' || n_nationkey AS goid FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)", catalog)
area.chain("not_exists_association", "object(supplier).where(!exists(in(located_in))).select(goid)", "SELECT 's' || s_suppkey AS goid FROM supplier WHERE 's' || s_suppkey NOT IN (SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || n_regionkey FROM nation)", catalog)
EVIDENCE = "SELECT 's' || s_suppkey AS goid, 'row' AS grain, 's-' || s_suppkey AS digest FROM supplier UNION ALL SELECT 'n' || s_nationkey, 'association', 'a-' || s_suppkey FROM supplier UNION ALL SELECT 'n' || s_nationkey, 'property', 'p-' || (s_suppkey % 3) FROM supplier"


def proven(spark, folder) -> Catalog:
    """Evidence of suppliers by their rows, and of nations by their associations and properties; regions have none."""
    out, s = catalog(spark, folder), read(spark, folder, "supplier")
    rows = s.select(F.concat(F.lit("s"), "s_suppkey").alias("goid"), F.lit("row").alias("grain"), F.concat(F.lit("s-"), "s_suppkey").alias("digest"))
    links = s.select(F.concat(F.lit("n"), "s_nationkey"), F.lit("association"), F.concat(F.lit("a-"), "s_suppkey"))
    out.evidence = rows.union(links).union(s.select(F.concat(F.lit("n"), "s_nationkey"), F.lit("property"), F.concat(F.lit("p-"), F.col("s_suppkey") % 3)))
    return out


area.chain("root_evidence", "evidence(self).select(goid, grain, digest)", EVIDENCE, proven)
area.chain("root_evidence_grain", "evidence(self, grain: property).select(goid, digest)", f"SELECT goid, digest FROM ({EVIDENCE}) WHERE grain = 'property'", proven)
area.chain("exists_evidence", "object(nation).where(exists(evidence(self))).select(goid)", "SELECT DISTINCT 'n' || s_nationkey AS goid FROM supplier", proven)
area.chain("not_exists_evidence", "object(region).where(!exists(evidence(self))).select(goid)", "SELECT 'r' || r_regionkey AS goid FROM region", proven)
area.chain("agg_evidence", "object(nation).select(goid, n: count(evidence(self)), some: exists(evidence(self)), kinds: distinct_count(evidence(self)))", f"SELECT 'n' || n_nationkey AS goid, count(digest) AS n, count(digest) > 0 AS some, count(DISTINCT digest) AS kinds FROM nation LEFT JOIN ({EVIDENCE}) e ON e.goid = 'n' || n_nationkey GROUP BY n_nationkey", proven)
area.chain("agg_association_count", "object(nation).select(goid, n: count(in(located_in)), some: exists(in(located_in)), regions: distinct_count(out(located_in)))", "SELECT 'n' || n_nationkey AS goid, count(s_suppkey) AS n, count(s_suppkey) > 0 AS some, count(DISTINCT r_regionkey) AS regions FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY n_nationkey", catalog)
area.chain("chain_traverse", "node(supplier).traverse(out(edge(located_in) as e), min: 2, max: 2, mode: trail).select(start, node)", "SELECT 's' || s_suppkey AS start, 'r' || n_regionkey AS node FROM supplier JOIN nation ON s_nationkey = n_nationkey", catalog)
area.chain("chain_reachable", "node(supplier).reachable(out(edge(located_in)), maxDepth: 3).select(id, reachable_count)", "SELECT 's' || s_suppkey AS id, count(DISTINCT n_nationkey) + count(DISTINCT r_regionkey) AS reachable_count FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY s_suppkey", catalog)
