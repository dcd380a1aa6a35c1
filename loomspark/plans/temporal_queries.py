"""Queries on the versioned object log that ``events`` make: users as objects, events as records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import checkpoints, temporal
from ..sources.catalog import Catalog
from ..streaming import events
from .chain import query
from .registry import Area, read

area = Area()


def records(spark, folder):
    return log_of(read(spark, folder, "events"))


def log_of(told):
    """signup is a baseline, error a tombstone, all others deltas; props are the event's type and value."""
    kind = F.when(F.col("event_type") == "signup", "baseline").when(F.col("event_type") == "error", "tombstone").otherwise("delta")
    value = F.col("value").cast("decimal(20,4)").cast("string")
    props = F.when(F.col("event_type") == "purchase", F.create_map(F.lit("last_type"), F.col("event_type"), F.lit("spent"), value)).otherwise(F.create_map(F.lit("last_type"), F.col("event_type")))
    return told.select(
        F.lit("user").alias("object_type"), F.lit(0).cast("long").alias("branch_key"), F.col("user_id").cast("string").alias("goid"), F.col("event_id").cast("string").alias("record_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_id").alias("csn"), kind.alias("record_kind"), props.alias("props"),
    )


def catalog(spark, folder) -> Catalog:
    out = Catalog.of_folder(spark, folder)
    out.records = records(spark, folder)
    out.bounds = {"properties": {"last_type": "string", "spent": "string"}}
    return out


#: The log in SQL, and the state after each record by windows within the epochs that full records and tombstones start.
LOG = """
log AS (
  SELECT CAST(user_id AS VARCHAR) AS goid, event_id AS csn, epoch_us(ts) AS ts_us,
         CASE event_type WHEN 'signup' THEN 'baseline' WHEN 'error' THEN 'tombstone' ELSE 'delta' END AS record_kind, event_type,
         CASE WHEN event_type = 'purchase' THEN CAST(CAST(value AS DECIMAL(20,4)) AS VARCHAR) END AS spent_now
  FROM events {where}
), marked AS (
  SELECT *, sum(CASE WHEN record_kind IN ('baseline', 'tombstone') THEN 1 ELSE 0 END) OVER (PARTITION BY goid ORDER BY ts_us, csn) AS epoch,
         row_number() OVER (PARTITION BY goid ORDER BY ts_us DESC, csn DESC) AS from_end
  FROM log
), hist AS (
  SELECT *, CASE WHEN record_kind <> 'tombstone' THEN event_type END AS last_type,
         CASE WHEN record_kind <> 'tombstone' THEN last_value(spent_now IGNORE NULLS) OVER (PARTITION BY goid, epoch ORDER BY ts_us, csn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS spent
  FROM marked
)"""
LATEST = "WITH " + LOG + " SELECT goid, csn, last_type, spent FROM hist WHERE from_end = 1 AND record_kind <> 'tombstone'"
USER = 'object(user).{0}select(goid, csn, last_type, spent)'
CUT = 700
area.chain("tmp_latest", USER.format(""), LATEST.format(where=""), catalog)
area.chain("tmp_asof_csn", USER.format(f"asOf(csn: {CUT})."), LATEST.format(where=f"WHERE event_id <= {CUT}"), catalog)
area.chain("tmp_asof_time", USER.format('asOf(time: "2024-01-03T00:00:00Z").'), LATEST.format(where="WHERE ts <= TIMESTAMP '2024-01-03'"), catalog)
area.chain("tmp_tombstones", 'object(user).includeTombstones(true).select(goid, csn, live, last_type)', "WITH " + LOG.format(where="") + " SELECT goid, csn, record_kind <> 'tombstone' AS live, last_type FROM hist WHERE from_end = 1", catalog)
area.chain("tmp_history_records", "object(user).history(mode: records).select(goid, csn, record_kind)", "WITH " + LOG.format(where="") + " SELECT goid, csn, record_kind FROM log", catalog)
area.chain("tmp_history_states", "object(user).history().select(goid, csn, record_kind, last_type, spent)", "WITH " + LOG.format(where="") + " SELECT goid, csn, record_kind, last_type, spent FROM hist", catalog)
area.chain("tmp_history_both", "object(user).history(mode: records_and_states).groupBy(output_grain, record_kind).select(output_grain, record_kind, n: count(*))", "WITH " + LOG.format(where="") + " SELECT g AS output_grain, record_kind, count(*) AS n FROM log CROSS JOIN (VALUES ('record'), ('state')) t(g) GROUP BY 1, 2", catalog)
area.chain("tmp_changes_records", "object(user).changes(from: 100, to: 200, mode: records).select(goid, csn, record_kind)", "WITH " + LOG.format(where="") + " SELECT goid, csn, record_kind FROM log WHERE csn >= 100 AND csn < 200", catalog)
area.chain("tmp_changes_transitions", "object(user).changes(from: 100, to: 400, mode: state_transitions).select(goid, csn, last_type, spent)", "WITH " + LOG.format(where="") + " SELECT goid, csn, last_type, spent FROM hist WHERE csn >= 100 AND csn < 400", catalog)
area.chain("tmp_changes_final", "object(user).changes(from: 100, to: 400, mode: final_rows).select(goid, csn, live, last_type, spent)", "WITH " + LOG.format(where="WHERE event_id < 400") + " SELECT goid, csn, record_kind <> 'tombstone' AS live, last_type, spent FROM hist WHERE from_end = 1 AND goid IN (SELECT goid FROM log WHERE csn >= 100)", catalog)
area.frame("tmp_changes_diffs", lambda s, d: temporal.property_diffs(records(s, d), 100, 400).select("goid", "csn", "name", "change", "old_value", "new_value"),
           "WITH " + LOG.format(where="") + """, steps AS (
  SELECT goid, csn, last_type, spent, lag(last_type) OVER w AS old_type, lag(spent) OVER w AS old_spent FROM hist WINDOW w AS (PARTITION BY goid ORDER BY ts_us, csn)
), both_names AS (
  SELECT goid, csn, 'last_type' AS name, old_type AS old_value, last_type AS new_value FROM steps
  UNION ALL SELECT goid, csn, 'spent', old_spent, spent FROM steps
)
SELECT goid, csn, name, CASE WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'removed' ELSE 'changed' END AS change, old_value, new_value
FROM both_names WHERE csn >= 100 AND csn < 400 AND old_value IS DISTINCT FROM new_value""")  # fmt: skip
area.frame("tmp_asof_role", lambda s, d: temporal.as_of_role(records(s, d), "spent", "3").select("goid", "csn", F.element_at("props", F.lit("last_type")).alias("last_type")),
           "WITH " + LOG.format(where="") + """, cuts AS (
  SELECT goid, arg_max(csn, (spent_now, ts_us, csn)) AS cut FROM log WHERE spent_now <= '3' GROUP BY goid
), upto AS (
  SELECT h.*, row_number() OVER (PARTITION BY h.goid ORDER BY h.ts_us DESC, h.csn DESC) AS place FROM hist h JOIN cuts c ON c.goid = h.goid AND h.csn <= c.cut
)
SELECT goid, csn, last_type FROM upto WHERE place = 1 AND record_kind <> 'tombstone'""")  # fmt: skip
# ---- branches: users with an odd id live on another branch
area.chain("tmp_branch", 'object(user).branch("side").groupBy(last_type).select(last_type, n: count(*))', "WITH " + LOG.format(where="WHERE user_id % 2 = 1") + " SELECT last_type, count(*) AS n FROM hist WHERE from_end = 1 AND record_kind <> 'tombstone' GROUP BY 1", lambda s, d: _branched(s, d))
area.chain("tmp_branch_default", "object(user).select(goid, csn)", "WITH " + LOG.format(where="WHERE user_id % 2 = 0") + " SELECT goid, csn FROM hist WHERE from_end = 1 AND record_kind <> 'tombstone'", lambda s, d: _branched(s, d))


def _on_branches(log):
    return log.withColumn("branch_key", F.col("goid").cast("long") % 2)


def _branched(spark, folder):
    out = catalog(spark, folder)
    out.records = _on_branches(out.records)
    out.branches = {"main": 0, "side": 1}
    return out


# ---- associations: each user's membership of a group, opened, changed and ended by the same events
def memberships(spark, folder) -> Catalog:
    out = catalog(spark, folder)
    ends = F.create_map(F.lit("source_goid"), F.concat(F.lit("u"), "goid"), F.lit("target_goid"), F.concat(F.lit("g"), F.col("goid").cast("long") % 7))
    out.edge_records = out.records.withColumn("object_type", F.lit("member_of")).withColumn("props", F.when(F.col("record_kind") == "baseline", F.map_concat("props", ends)).otherwise(F.col("props")))
    return out


def _branched_memberships(spark, folder) -> Catalog:
    out = memberships(spark, folder)
    out.edge_records, out.branches = _on_branches(out.edge_records), {"side": 1}
    return out


ENDS = "'u' || goid AS source_goid, 'g' || (CAST(goid AS BIGINT) % 7) AS target_goid"
#: Only memberships that were ever opened have ends.
OPENED = "goid IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'signup')"
MEMBER = "association(member_of).{0}select(assoc_goid, source_goid, target_goid, csn, last_type, spent)"
MEMBERS = "SELECT goid AS assoc_goid, " + ENDS + ", csn, last_type, spent FROM hist WHERE " + OPENED
for _name, _scope, _where, _keep in (
    ("latest", "", "", "AND from_end = 1 AND record_kind <> 'tombstone'"),
    ("asof_csn", f"asOf(csn: {CUT}).", f"WHERE event_id <= {CUT}", "AND from_end = 1 AND record_kind <> 'tombstone'"),
    ("asof_time", 'asOf(time: "2024-01-03T00:00:00Z").', "WHERE ts <= TIMESTAMP '2024-01-03'", "AND from_end = 1 AND record_kind <> 'tombstone'"),
    ("tombstones", "includeTombstones(true).", "", "AND from_end = 1"),
    ("history", "history().", "", ""),
    ("transitions", "changes(from: 100, to: 400, mode: state_transitions).", "", "AND csn >= 100 AND csn < 400"),
    ("final", "changes(from: 100, to: 400, mode: final_rows).", "WHERE event_id < 400", "AND from_end = 1 AND goid IN (SELECT goid FROM log WHERE csn >= 100)"),
):
    area.chain(f"tmp_association_{_name}", MEMBER.format(_scope), "WITH " + LOG.format(where=_where) + " " + MEMBERS + " " + _keep, memberships)
area.chain("tmp_association_branch", MEMBER.format('branch("side").'), "WITH " + LOG.format(where="WHERE user_id % 2 = 1") + " " + MEMBERS + " AND from_end = 1 AND record_kind <> 'tombstone'", _branched_memberships)
area.chain("tmp_association_records", "association(member_of).changes(from: 100, to: 400, mode: records).select(assoc_goid, source_goid, target_goid, csn, record_kind)", "WITH " + LOG.format(where="") + " SELECT goid AS assoc_goid, " + ENDS + ", csn, record_kind FROM log WHERE csn >= 100 AND csn < 400 AND " + OPENED, memberships)
area.chain("tmp_association_diffs", "association(member_of).changes(from: 100, to: 400, mode: property_diffs).where(name == \"spent\").select(assoc_goid, source_goid, csn, change, old_value, new_value)", "WITH " + LOG.format(where="") + """, steps AS (SELECT goid, csn, spent, lag(spent) OVER (PARTITION BY goid ORDER BY ts_us, csn) AS old_value FROM hist)
SELECT goid AS assoc_goid, 'u' || goid AS source_goid, csn, CASE WHEN old_value IS NULL THEN 'added' WHEN spent IS NULL THEN 'removed' ELSE 'changed' END AS change, old_value, spent AS new_value
FROM steps WHERE csn >= 100 AND csn < 400 AND old_value IS DISTINCT FROM spent AND """ + OPENED, memberships)  # fmt: skip
area.chain("tmp_association_hop", "object(member).select(goid, n: count(out(member_of)))", "WITH " + LOG.format(where="") + ", live AS (SELECT 'u' || goid AS source_goid FROM hist WHERE from_end = 1 AND record_kind <> 'tombstone' AND " + OPENED + ") SELECT 'u' || user_id AS goid, count(source_goid) AS n FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN live ON source_goid = 'u' || user_id GROUP BY 1", lambda s, d: _members(s, d))


def _members(spark, folder) -> Catalog:
    """Users as objects under the names that their memberships use."""
    out = memberships(spark, folder)
    users = out.records.select("goid").distinct()
    out.records = users.select(F.lit("member").alias("object_type"), F.lit(0).cast("long").alias("branch_key"), F.concat(F.lit("u"), "goid").alias("goid"), F.col("goid").alias("record_id"), F.lit(0).cast("long").alias("ts_us"), F.lit(0).cast("long").alias("csn"), F.lit("baseline").alias("record_kind"), F.create_map(F.lit("last_type"), F.lit("none")).alias("props"))
    return out


def _chain(spark, folder):
    log = records(spark, folder)
    return temporal.chain(log.where("csn <= 300"), log.where("csn > 300 and csn <= 600"), log.where("csn > 600"))


area.frame("delta_chain_read", lambda s, d: temporal.states(_chain(s, d)).select("goid", "csn", F.element_at("props", F.lit("last_type")).alias("last_type"), F.element_at("props", F.lit("spent")).alias("spent")), LATEST.format(where=""))
area.frame("delta_prune", lambda s, d: temporal.states(temporal.as_of(_chain(s, d).where(F.col("chain_ordinal").isin(temporal.pruned_chain([{"least_csn": 0, "least_ts_us": 0}, {"least_csn": 301, "least_ts_us": 0}, {"least_csn": 601, "least_ts_us": 0}], csn=500))), csn=500)).select("goid", "csn"), "WITH " + LOG.format(where="WHERE event_id <= 500") + " SELECT goid, csn FROM hist WHERE from_end = 1 AND record_kind <> 'tombstone'")
area.frame("delta_compact", lambda s, d: temporal.states(temporal.compacted(_chain(s, d).drop("chain_ordinal"))).select("goid", "csn", F.element_at("props", F.lit("last_type")).alias("last_type"), F.element_at("props", F.lit("spent")).alias("spent")), LATEST.format(where=""))
area.frame("delta_checkpoint", lambda s, d: temporal.states(temporal.checkpointed(_chain(s, d).drop("chain_ordinal"), 600)).select("goid", "csn", F.element_at("props", F.lit("last_type")).alias("last_type"), F.element_at("props", F.lit("spent")).alias("spent")), LATEST.format(where=""))
area.frame("delta_checkpoint_records", lambda s, d: temporal.checkpointed(records(s, d), 600).groupBy("record_kind").agg(F.count("*").alias("n")), "WITH " + LOG.format(where="") + ", kept AS (SELECT CASE WHEN record_kind = 'tombstone' THEN record_kind ELSE 'snapshot' END AS record_kind FROM (SELECT *, row_number() OVER (PARTITION BY goid ORDER BY ts_us DESC, csn DESC) AS last FROM log WHERE csn <= 600) WHERE last = 1 UNION ALL SELECT record_kind FROM log WHERE csn > 600) SELECT record_kind, count(*) AS n FROM kept GROUP BY 1")
area.frame("delta_touched", lambda s, d: _chain(s, d).where("chain_ordinal = 2").select("goid").distinct(), "SELECT DISTINCT CAST(user_id AS VARCHAR) AS goid FROM events WHERE event_id > 600")


area.frame("delta_patch", lambda s, d: _patched(s, d), """
WITH base AS (SELECT CAST(c_custkey AS VARCHAR) AS goid, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, c_custkey FROM customer)
SELECT goid, CASE WHEN segment = 'BUILDING' THEN 'patched' ELSE segment END AS segment, CASE WHEN segment = 'FURNITURE' THEN NULL ELSE nation END AS nation FROM base WHERE segment <> 'HOUSEHOLD'""")


def _patched(spark, folder):
    key = [F.lit("customer").alias("object_type"), F.lit(0).cast("long").alias("branch_key"), F.col("c_custkey").cast("string").alias("goid")]
    rows = read(spark, folder, "customer")
    base = rows.select(*key, F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("props"))
    segment = F.col("c_mktsegment")
    op = F.when(segment == "BUILDING", "set").when(segment == "FURNITURE", "unset").when(segment == "HOUSEHOLD", "tombstone")
    patches = rows.select(*key, F.lit(1).cast("long").alias("csn"), op.alias("op"), F.when(segment == "FURNITURE", "nation").otherwise("segment").alias("name"), F.lit("patched").alias("value")).where("op is not null")
    return temporal.patched(base, patches).select("goid", F.element_at("props", F.lit("segment")).alias("segment"), F.element_at("props", F.lit("nation")).alias("nation"))


# ---- streams: the operators on the events as a batch, and a log that a stream appends to
area.frame("stream_tumbling_equiv", lambda s, d: events.windowed(read(s, d, "events"), "1 hour").select(F.unix_micros("start").alias("start_us"), "event_type", "n"), "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
area.frame("stream_sliding_equiv", lambda s, d: events.windowed(read(s, d, "events"), "2 hours", "1 hour").select(F.unix_micros("start").alias("start_us"), "event_type", "n"), "SELECT epoch_us(start) AS start_us, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start, event_type FROM events) GROUP BY 1, 2")
area.frame("stream_running_totals", lambda s, d: events.running_totals(read(s, d, "events")).select("user_id", "n", F.round("total", 4).alias("total")), "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
area.frame("stream_deduplicated", lambda s, d: events.deduplicated(read(s, d, "events").unionAll(read(s, d, "events"))).select("event_id"), "SELECT event_id FROM events")
area.frame("stream_appended_log", lambda s, d: _appended(s, d), LATEST.format(where=""))


def _appended(spark, folder):
    """The states of a log that a stream of the events wrote, batch by batch, into the shared checkpoint folder."""
    at = f"{checkpoints.folder(spark)}/loomspark-stream-{uuid.uuid4().hex}"
    stream = events.source(spark, f"{folder}/[e]vents.parquet", read(spark, folder, "events").schema)
    events.append_log(stream, log_of, f"{at}/log", f"{at}/state").awaitTermination()
    checkpoints.delete_at_end(spark, at)
    return temporal.states(spark.read.parquet(f"{at}/log").drop("batch")).select("goid", "csn", *[F.element_at("props", F.lit(c)).alias(c) for c in ("last_type", "spent")])


area.frame("stream_session_equiv", lambda s, d: events.sessions(read(s, d, "events"), "30 minutes").select(F.unix_micros("start").alias("start_us"), "user_id", "n"),
           """WITH marked AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
sessions AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM marked)
SELECT epoch_us(min(ts)) AS start_us, user_id, count(*) AS n FROM sessions GROUP BY user_id, session""")  # fmt: skip
