"""Queries of entity resolution: customers and suppliers as sources of companies in nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mapping, projection, temporal
from .registry import Area, read
from .temporal_queries import LOG, memberships

area = Area()


def sources(spark, folder):
    """Two sources whose rows are the same object where the number of the name and the nation agree."""
    customer = read(spark, folder, "customer").select(F.col("c_custkey").alias("row_id"), F.concat_ws(" ", F.lit("Company"), (F.col("c_custkey") % 97).cast("string"), F.lit("Ltd")).alias("name"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("decimal(20,2)").cast("string").alias("balance"))
    supplier = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("row_id"), F.concat_ws("  ", F.lit("COMPANY"), (F.col("s_suppkey") % 97).cast("string")).alias("name"), F.col("s_nationkey").cast("string").alias("nation"), F.lit(None).cast("string").alias("segment"), F.col("s_acctbal").cast("decimal(20,2)").cast("string").alias("balance"))
    rule = mapping.IdentityRule("by_name", "company", [("name", ["strip_legal_suffix", "trim_lower", "collapse_whitespace"]), ("nation", [])])
    return [mapping.Source("customer", customer, "row_id", [rule], 1), mapping.Source("supplier", supplier, "row_id", [rule], 0)]


S = """src AS (
  SELECT 'customer' AS source, CAST(c_custkey AS VARCHAR) AS row, 'company ' || (c_custkey % 97) AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment, CAST(CAST(c_acctbal AS DECIMAL(20,2)) AS VARCHAR) AS balance, 1 AS priority, c_custkey AS n FROM customer
  UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'company ' || (s_suppkey % 97), CAST(s_nationkey AS VARCHAR), NULL, CAST(CAST(s_acctbal AS DECIMAL(20,2)) AS VARCHAR), 0, s_suppkey FROM supplier
), groups AS (SELECT *, name || '|' || nation AS g FROM src)"""


def merged(spark, folder):
    planned = mapping.plan_identities(sources(spark, folder))
    return planned, mapping.merge(planned)


def _first_of(df):
    """Components by their least (source, row), which does not depend on digests."""
    least = df.groupBy("component").agg(F.min(F.struct("source", "row")).alias("m"))
    return df.join(least, "component").select("source", "row", F.concat_ws(":", "m.source", "m.row").alias("component"))


area.frame("map_identity_plan", lambda s, d: mapping.plan_identities(sources(s, d)).groupBy("source", "rule").agg(F.count("*").alias("n"), F.count_distinct("merge_group").alias("groups")), "WITH " + S + " SELECT source, 'by_name' AS rule, count(*) AS n, count(DISTINCT g) AS groups FROM groups GROUP BY 1")
area.frame("map_identity_merge", lambda s, d: _first_of(merged(s, d)[1]), "WITH " + S + ", m AS (SELECT *, first_value(source || ':' || row) OVER (PARTITION BY g ORDER BY source, row) AS component FROM groups) SELECT source, row, component FROM m")
area.frame("map_union_find", lambda s, d: _reviewed(s, d), "WITH RECURSIVE " + S + """,
links AS (SELECT a.source || ':' || a.row AS a, b.source || ':' || b.row AS b FROM groups a JOIN groups b ON a.g = b.g
  UNION ALL SELECT 'customer:' || n, 'customer:' || (n + 1) FROM src WHERE source = 'customer' AND CAST(balance AS DECIMAL(20,2)) > 9500
  UNION ALL SELECT 'customer:' || (n + 1), 'customer:' || n FROM src WHERE source = 'customer' AND CAST(balance AS DECIMAL(20,2)) > 9500),
reach(a, b) AS (SELECT a, a FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT split_part(a, ':', 1) AS source, split_part(a, ':', 2) AS row, min(b) AS component FROM reach WHERE a IN (SELECT source || ':' || row FROM src) AND b IN (SELECT source || ':' || row FROM src) GROUP BY a""")


def _reviewed(spark, folder):
    planned = mapping.plan_identities(sources(spark, folder))
    pairs = read(spark, folder, "customer").where("c_acctbal > 9500").select(F.lit("customer").alias("a_source"), F.col("c_custkey").cast("string").alias("a_row"), F.lit("customer").alias("b_source"), (F.col("c_custkey") + 1).cast("string").alias("b_row"), F.lit("same_object").alias("decision"))
    out = mapping.merge(planned, pairs)
    least = out.groupBy("component").agg(F.min(F.concat_ws(":", "source", "row")).alias("m"))
    return out.join(least, "component").select("source", "row", F.col("m").alias("component"))


area.frame("map_anchors", lambda s, d: mapping.anchors(*merged(s, d)).select("source", "row"), "WITH " + S + " SELECT split_part(a, ':', 1) AS source, split_part(a, ':', 2) AS row FROM (SELECT min_by(source || ':' || row, (CASE source WHEN 'customer' THEN 0 ELSE 1 END, row)) AS a FROM groups GROUP BY g)")


def asserted(spark, folder):
    planned, components = merged(spark, folder)
    goids = components.select("source", "row", F.col("component").alias("goid"))
    out = None
    for i, source in enumerate(sources(spark, folder)):
        part = mapping.assertions(source, goids, {"segment": "segment", "balance": "balance", "nation": "nation"}, order=i)
        out = part if out is None else out.unionByName(part)
    return planned, components, out


def _settled(spark, folder, policy):
    _, components, told = asserted(spark, folder)
    least = components.groupBy("component").agg(F.min(F.concat_ws(":", "source", "row")).alias("m"))
    if policy == "reject_conflict":
        told = told.where("property = 'nation'")
    return mapping.settle(told, policy).join(least, F.col("goid") == F.col("component")).select(F.col("m").alias("object"), "property", "value", "suppressed")


T = ", told AS (SELECT g, source, row, priority, property, value FROM (SELECT g, source, row, priority, unnest(['segment', 'balance', 'nation']) AS property, unnest([segment, balance, nation]) AS value FROM groups) WHERE value IS NOT NULL), o AS (SELECT g, min(source || ':' || row) AS object FROM groups GROUP BY 1)"
area.frame("map_source_priority", lambda s, d: _settled(s, d, "source_priority_wins"), "WITH " + S + T + " SELECT o.object, property, min_by(value, (priority, row)) AS value, count(*) - 1 AS suppressed FROM told JOIN o ON o.g = told.g GROUP BY 1, 2")
area.frame("map_conflict_check", lambda s, d: _settled(s, d, "reject_conflict"), "WITH " + S + T + " SELECT o.object, property, min(value) AS value, CAST(0 AS BIGINT) AS suppressed FROM told JOIN o ON o.g = told.g WHERE property = 'nation' GROUP BY 1, 2")
area.frame("map_evidence", lambda s, d: mapping.evidence(asserted(s, d)[2]).groupBy("grain", "property", "source").agg(F.count("*").alias("n"), F.count_distinct("digest").alias("digests")), "WITH " + S + " SELECT 'property' AS grain, property, source, count(*) AS n, count(*) AS digests FROM (SELECT source, unnest(['segment', 'balance', 'nation']) AS property FROM src) GROUP BY 2, 3")
area.frame("map_alias_resolve", lambda s, d: _aliases(s, d), "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'home' WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE lower(c_mktsegment) END AS canonical, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'resolved' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'ambiguous' ELSE 'normalized_value' END AS resolution FROM customer")


def _aliases(spark, folder):
    known = spark.createDataFrame([("Building ", "home"), ("furniture", "home"), ("household", "a"), ("HOUSEHOLD", "b")], "alias string, canonical string")
    return mapping.resolve_aliases(read(spark, folder, "customer"), "c_mktsegment", known, ["trim_lower"]).select("c_custkey", "canonical", "resolution")


area.frame("map_candidates_jaccard", lambda s, d: mapping.candidates(read(s, d, "part").groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("label")).agg(F.min("p_partkey").alias("p_partkey")), "p_partkey", "label", ["ascii_lower"], None, 20).groupBy("block", "score").agg(F.count("*").alias("n")),
           """WITH t AS (SELECT CAST(min(p_partkey) AS VARCHAR) AS id, lower(p_brand || ' ' || p_type) AS v FROM part GROUP BY p_brand, p_type),
w AS (SELECT id, '' AS block, list_distinct(list_filter(string_split_regex(v, '\\s+'), lambda x: x <> '')) AS k FROM t),
p AS (SELECT a.block, len(list_intersect(a.k, b.k)) AS c, len(a.k) AS x, len(b.k) AS y FROM w a JOIN w b ON a.block = b.block AND a.id < b.id)
SELECT block, CAST(floor(c * 100.0 / (x + y - c)) AS BIGINT) AS score, count(*) AS n FROM p WHERE floor(c * 100.0 / (x + y - c)) >= 20 GROUP BY 1, 2""")  # fmt: skip
area.frame("map_associations", lambda s, d: mapping.associations(read(s, d, "customer"), read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.concat(F.lit("c"), "c_custkey").alias("goid")), read(s, d, "nation").where("n_regionkey <> 3").select(F.col("n_nationkey").cast("string").alias("key"), F.concat(F.lit("n"), "n_nationkey").alias("goid")), F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), "lives_in").select("assoc_type", "source_goid", "target_goid"), "SELECT 'lives_in' AS assoc_type, 'c' || c_custkey AS source_goid, 'n' || c_nationkey AS target_goid FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)")
area.frame("map_valid_time", lambda s, d: mapping.valid_at(read(s, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("valid_from"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate") + F.expr("interval 365 days")).alias("valid_to")), F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND (o_orderstatus = 'F' OR TIMESTAMP '1996-01-01' < o_orderdate + INTERVAL 365 DAY)")
for _policy, _sql in {
    "first": "SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1",
    "last": "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1",
    "explode": "SELECT o_custkey, o_orderkey FROM orders",
}.items():
    area.frame(f"map_projection_{_policy}", lambda s, d, policy=_policy: mapping.multi_value(read(s, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderdate", policy), _sql)
area.frame("map_projection_list", lambda s, d: mapping.multi_value(read(s, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderdate", "list").select("o_custkey", F.array_join("o_orderkey", ",").alias("listed")), "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS listed FROM orders GROUP BY 1")
for _function, _sql in {"count": "count(o_totalprice)", "distinct_count": "count(DISTINCT o_orderkey)", "min": "min(o_totalprice)", "max": "max(o_totalprice)"}.items():
    area.frame(f"map_associated_{_function}", lambda s, d, f=_function: _associated(s, d, f), f"SELECT 'c' || c_custkey AS goid, {_sql} AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")


def _associated(spark, folder, function):
    orders = read(spark, folder, "orders").where("o_orderstatus = 'F'")
    edges = orders.select(F.concat(F.lit("c"), "o_custkey").alias("source_goid"), F.concat(F.lit("o"), "o_orderkey").alias("target_goid"))
    target = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("goid"), "o_totalprice", "o_orderkey")
    return mapping.associated(read(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("goid")), edges, target, "o_orderkey" if function == "distinct_count" else "o_totalprice", function)


area.frame("map_property_versions", lambda s, d: mapping.property_versions(read(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("goid"), F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string")).alias("props"))), "SELECT 'n' || n_nationkey AS goid, unnest(['name', 'region']) AS property, unnest([n_name, CAST(n_regionkey AS VARCHAR)]) AS value FROM nation")
area.frame("map_parity", lambda s, d: mapping.parity(read(s, d, "nation").select("n_name"), read(s, d, "nation").where("n_regionkey <> 3").select("n_name")), "SELECT n_name, 'left' AS side FROM nation WHERE n_regionkey = 3")
area.frame("map_semantic_delta", lambda s, d: _delta(s, d), "SELECT CAST(c_custkey AS VARCHAR) AS goid, CASE c_mktsegment WHEN 'BUILDING' THEN 'tombstone' WHEN 'FURNITURE' THEN 'baseline' ELSE 'snapshot' END AS record_kind FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD')")


def _delta(spark, folder):
    state = lambda df, v: df.select(F.lit("c").alias("object_type"), F.lit(0).cast("long").alias("branch_key"), F.col("c_custkey").cast("string").alias("goid"), F.create_map(F.lit("v"), v).alias("props"))
    rows = read(spark, folder, "customer")
    before = state(rows.where("c_mktsegment <> 'FURNITURE'"), F.col("c_name"))
    after = state(rows.where("c_mktsegment <> 'BUILDING'"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", "new").otherwise(F.col("c_name")))
    return mapping.semantic_delta(before, after, 2, 2).select("goid", "record_kind")


# ---- projections: every grain and every temporal mode over the users' log and that of their memberships
def model(spark, folder) -> projection.Model:
    told = memberships(spark, folder)
    users = told.records.withColumn("goid", F.concat(F.lit("u"), "goid"))
    return projection.Model(users, told.edge_records, users.select("goid", F.col("record_id").alias("digest")), {"spent": "decimal(20,4)"})


H = "WITH " + LOG.format(where="{0}") + " "
ALIVE = "from_end = 1 AND record_kind <> 'tombstone'"
RICH = "coalesce(CAST(spent AS DECIMAL(20,4)) > 20, false)"
STATE = {"goid": "goid", "csn": "temporal.csn", "kind": "upper(last_type)", "level": "if(spent > 20, 'high', 'low')", "known": "exists(spent)", "shown": "coalesce(spent, 0)", "same": "if(last_type == 'purchase', true, false)", "truth": "if(last_type, 1, 0)"}
STATE_SQL = f"SELECT 'u' || goid AS goid, csn, upper(last_type) AS kind, CASE WHEN {RICH} THEN 'high' ELSE 'low' END AS level, spent IS NOT NULL AS known, round(coalesce(CAST(spent AS DOUBLE), 0), 4) AS shown, last_type = 'purchase' AS same, CAST(1 AS BIGINT) AS truth FROM hist WHERE "
area.frame("map_grain_object", lambda s, d: projection.projected(model(s, d), "one_row_per_object", "user", STATE), H.format("") + STATE_SQL + ALIVE)
area.frame("map_grain_event_object", lambda s, d: projection.projected(model(s, d), "one_row_per_event_object", "user", STATE, "as_of_csn:700"), H.format("WHERE event_id <= 700") + STATE_SQL + ALIVE)
area.frame("map_mode_time_cut", lambda s, d: projection.projected(model(s, d), "one_row_per_object", "user", STATE, "as_of_timestamp_us=1704240000000000"), H.format("WHERE epoch_us(ts) <= 1704240000000000") + STATE_SQL + ALIVE)
area.frame("map_grain_as_of_time", lambda s, d: projection.projected(model(s, d), "one_row_per_object_as_of_time", "user", STATE, "full_history"), H.format("") + STATE_SQL + "record_kind <> 'tombstone'")
AT_END = "CASE WHEN bool_or(record_kind = 'baseline') OVER (PARTITION BY goid, epoch) THEN 'u' || goid END"
EDGE = {"goid": "association.goid", "source": "source_goid", "target": "target_goid", "last_type": "last_type"}
EDGE_SQL = f"SELECT goid, source, CASE WHEN source IS NOT NULL THEN 'g' || (CAST(goid AS BIGINT) % 7) END AS target, last_type FROM (SELECT *, {AT_END} AS source FROM hist) WHERE " + ALIVE
area.frame("map_grain_association", lambda s, d: projection.projected(model(s, d), "one_row_per_association", "member_of", EDGE), H.format("") + EDGE_SQL)
area.frame("map_grain_link_object", lambda s, d: projection.projected(model(s, d), "one_row_per_link_object", "member_of", EDGE, "csn:700"), H.format("WHERE event_id <= 700") + EDGE_SQL)
area.frame("map_grain_property_version", lambda s, d: projection.projected(model(s, d), "one_row_per_property_version", "user", {"goid": "goid", "csn": "csn", "property": "property", "value": "value"}), H.format("") + "SELECT 'u' || goid AS goid, csn, property, value FROM (SELECT goid, csn, unnest(['last_type', 'spent']) AS property, unnest([event_type, spent_now]) AS value FROM log WHERE record_kind <> 'tombstone') WHERE value IS NOT NULL")
area.frame("map_grain_evidence", lambda s, d: projection.projected(model(s, d), "one_row_per_evidence_assertion", "user", {"object": "goid", "assertion": "digest"}), "SELECT 'u' || user_id AS object, CAST(event_id AS VARCHAR) AS assertion FROM events")
area.frame("map_mode_full_history", lambda s, d: projection.projected(model(s, d), "one_row_per_object", "user", {"goid": "goid", "csn": "csn", "kind": "record.kind", "id": "record.id"}, "full_history"), H.format("") + "SELECT 'u' || goid AS goid, csn, record_kind AS kind, CAST(csn AS VARCHAR) AS id FROM log")
area.frame("map_mode_commit_order", lambda s, d: projection.projected(model(s, d), "one_row_per_object", "user", {"goid": "goid", "csn": "csn", "at": "timestamp_us"}, "commit_order"), H.format("") + "SELECT 'u' || goid AS goid, csn, ts_us AS at FROM log")
LINKS = "WITH RECURSIVE " + LOG.format(where="") + f", live AS (SELECT *, {AT_END} AS source FROM hist), m AS (SELECT * FROM live WHERE {ALIVE}) SELECT 'u' || h.goid AS goid, count(m.last_type) AS n, count(DISTINCT m.last_type) AS kinds, min(m.last_type) AS least, round(sum(CAST(m.spent AS DOUBLE)), 4) AS total, round(avg(CAST(m.spent AS DOUBLE)), 4) AS mean, coalesce(string_agg(m.goid, '+'), '') AS ids FROM hist h LEFT JOIN m ON m.source = 'u' || h.goid WHERE h.from_end = 1 AND h.record_kind <> 'tombstone' GROUP BY 1"
area.frame("map_expression_associations", lambda s, d: _linked(s, d), LINKS)


def _linked(spark, folder):
    columns = {"goid": "goid", "n": "count(association.member_of.source.last_type)", "kinds": "distinct_count(association.member_of.last_type)", "least": "min(association.member_of.source.last_type)", "total": "sum(association.member_of.source.spent)", "mean": "avg(association.member_of.spent)", "ids": "association(member_of, source)"}
    out = projection.projected(model(spark, folder), "one_row_per_object", "user", columns)
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 4), "ids": F.array_join("ids", "+")})


def orders_model(spark, folder) -> projection.Model:
    """Orders as objects that hold from their date, for a year unless they are final, and were seen unless they are open."""
    o, none = read(spark, folder, "orders"), F.lit(None).cast("string")
    props = F.create_map(F.lit("valid_from"), F.col("o_orderdate").cast("string"), F.lit("valid_to"), F.when(F.col("o_orderstatus") != "F", (F.col("o_orderdate") + F.expr("interval 365 days")).cast("string")), F.lit("observed_at"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("string")).otherwise(none))
    records = o.select(F.lit("order").alias("object_type"), F.lit(0).cast("long").alias("branch_key"), F.col("o_orderkey").cast("string").alias("goid"), F.lit("r").alias("record_id"), F.lit(0).cast("long").alias("ts_us"), F.lit(1).cast("long").alias("csn"), F.lit("baseline").alias("record_kind"), props.alias("props"))
    return projection.Model(records, types={"valid_from": "timestamp_ntz", "valid_to": "timestamp_ntz", "observed_at": "timestamp_ntz"})


area.frame("map_mode_valid_time", lambda s, d: projection.projected(orders_model(s, d), "one_row_per_object", "order", {"goid": "goid"}, "valid_time", "1996-06-01 00:00:00"), "SELECT CAST(o_orderkey AS VARCHAR) AS goid FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND (o_orderstatus = 'F' OR TIMESTAMP '1996-06-01' < o_orderdate + INTERVAL 365 DAY)")
area.frame("map_mode_observed_time", lambda s, d: projection.projected(orders_model(s, d), "one_row_per_object", "order", {"goid": "goid", "at": "observed_at"}, "observed_time"), "SELECT CAST(o_orderkey AS VARCHAR) AS goid, o_orderdate AS at FROM orders WHERE o_orderstatus <> 'O'")


# ---- row semantics: customers of each segment mean something else
def _rows(spark, folder):
    rows = read(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"), "c_name", F.lit("segment").alias("name"), F.col("c_mktsegment").alias("value"), F.lit(1).cast("long").alias("csn"), F.lit(0).cast("long").alias("ts_us"))
    rule = lambda kind, **more: projection.RowRule(kind, "customer", "id", **more)
    link = [("lives_in", "nation")]
    by_value = {
        "BUILDING": rule("Object", properties=["c_name", "nation"], links=link), "FURNITURE": rule("AssociationOnly", links=link), "HOUSEHOLD": rule("EvidenceOnly"), "MACHINERY": rule("Tombstone", links=link),
        "AUTOMOBILE": rule("Composite", parts=[rule("LinkObject", properties=["c_name"], links=link), rule("KeyValueFragment", operation="patch"), rule("ProjectionOnly")]),
    }
    return projection.materialised(rows, projection.RowRule("Dispatched", dispatch="c_mktsegment", by_value=by_value))


def _row_kinds(spark, folder):
    made = _rows(spark, folder)
    logs = made["records"].select(F.lit("records").alias("what"), "goid", "record_kind").unionByName(made["edge_records"].select(F.lit("edges").alias("what"), F.col("goid"), "record_kind"))
    return logs.unionByName(made["evidence"].select(F.lit("evidence").alias("what"), "goid", F.lit("").alias("record_kind")))


area.frame("map_row_kinds", _row_kinds, """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS m, 'lives_in>' || c_custkey || '>' || c_nationkey AS link FROM customer)
SELECT 'records' AS what, id AS goid, CASE m WHEN 'MACHINERY' THEN 'tombstone' ELSE 'delta' END AS record_kind FROM c WHERE m IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')
UNION ALL SELECT 'records', id, 'delta' FROM c WHERE m = 'AUTOMOBILE'
UNION ALL SELECT 'edges', link, 'delta' FROM c WHERE m IN ('BUILDING', 'FURNITURE', 'AUTOMOBILE')
UNION ALL SELECT 'evidence', id, '' FROM c UNION ALL SELECT 'evidence', id, '' FROM c WHERE m = 'AUTOMOBILE'""")
area.frame("map_row_states", lambda s, d: temporal.states(_rows(s, d)["records"]).select("goid", F.element_at("props", F.lit("c_name")).alias("name"), F.element_at("props", F.lit("segment")).alias("segment")), "SELECT CAST(c_custkey AS VARCHAR) AS goid, c_name AS name, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN c_mktsegment END AS segment FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')")
for _miss, _shown in {"candidate_only": "NULL", "source_scoped": "c_mktsegment"}.items():
    area.frame(f"map_alias_{_miss}", lambda s, d, m=_miss: _missed(s, d, m), f"SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'home' ELSE {_shown} END AS canonical, CASE WHEN c_mktsegment = 'BUILDING' THEN 'resolved' ELSE '{_miss}' END AS resolution FROM customer")


def _missed(spark, folder, on_miss):
    known = spark.createDataFrame([("building", "home")], "alias string, canonical string")
    return mapping.resolve_aliases(read(spark, folder, "customer"), "c_mktsegment", known, ["trim_lower"], on_miss).select("c_custkey", "canonical", "resolution")


for _function, _sql in {"sum": "coalesce(round(sum(o_totalprice), 4), 0)", "avg": "round(avg(o_totalprice), 4)"}.items():
    area.frame(f"map_associated_{_function}", lambda s, d, f=_function: _associated(s, d, f).withColumn("value", F.round("value", 4)), f"SELECT 'c' || c_custkey AS goid, {_sql} AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
area.frame("map_associated_list", lambda s, d: _associated(s, d, "list").select("goid", F.array_join(F.transform("value", lambda x: x.cast("decimal(20,2)").cast("string")), ",").alias("value")), "SELECT 'c' || c_custkey AS goid, coalesce(string_agg(CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR), ',' ORDER BY o_totalprice), '') AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
