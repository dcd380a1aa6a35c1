"""The versioned object log: folds to states, as-of cuts, history, change feeds, and delta chains.

Records are rows (object_type, branch_key, goid, record_id, ts_us, csn, record_kind, props), props a map of text that
may hold nulls: a delta that sets null differs from one that does not mention a property. A baseline or snapshot
replaces the state, a delta overlays it, a tombstone ends it.

The fold is two aggregates by key: the order of the last full record, and the last value of each property at or after
it. No group is gathered: both are maxima that Spark combines before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import QueryError

KEY = ("object_type", "branch_key", "goid")
FULL = ("baseline", "snapshot")
ORDER = ("ts_us", "csn", "record_id")
#: Source operations and the kinds of records that they make.
OPERATION_KINDS = {
    "fact": "delta", "insert": "baseline", "upsert": "delta", "patch": "delta", "replace": "snapshot", "correction": "delta", "close_association": "delta", "expire_association": "delta",
    "tombstone": "tombstone", "object_tombstone": "tombstone", "association_tombstone": "tombstone", "redact": "delta", "snapshot": "snapshot",
}


def order_of() -> Column:
    return F.struct(*ORDER)


def states(records: DataFrame, tombstones: bool = False) -> DataFrame:
    """(key, props, csn, ts_us, record_id, live) of each object's last state."""
    full = F.max(F.when(F.col("record_kind").isin(*FULL), order_of()))
    # The last end of life matters too: what comes after a tombstone does not see what was before it.
    last = records.groupBy(*KEY).agg(full.alias("full"), F.max(F.when(F.col("record_kind") == "tombstone", order_of())).alias("dead"), F.max(order_of()).alias("last"), F.max_by("record_kind", order_of()).alias("kind"))
    since = F.greatest("full", "dead")
    values = (
        records.where(F.col("record_kind") != "tombstone")
        .join(last.select(*KEY, since.alias("since"), F.col("full").alias("full")), list(KEY))
        .where(F.col("since").isNull() | (order_of() >= F.col("since")))
        .select(*KEY, order_of().alias("at"), F.explode("props").alias("name", "value"))
        .groupBy(*KEY, "name")
        .agg(F.max_by("value", "at").alias("value"))
        .groupBy(*KEY)
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("props"))
    )
    out = last.join(values, list(KEY), "left").select(*KEY, F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"), "last.csn", "last.ts_us", "last.record_id", (F.col("kind") != "tombstone").alias("live"))
    return out if tombstones else out.where("live")


def as_of(records: DataFrame, csn: int | None = None, time_us: int | None = None) -> DataFrame:
    """Records up to a commit number or time; both cuts reach the scan."""
    if csn is not None:
        records = records.where(F.col("csn") <= csn)
    if time_us is not None:
        records = records.where(F.col("ts_us") <= time_us)
    return records


def as_of_role(records: DataFrame, bound: str, value: str) -> DataFrame:
    """States at the last record whose own property ``bound`` is at most ``value``, object by object."""
    bound_at = F.col("props")[bound]
    latest = records.where(bound_at <= value).groupBy(*KEY).agg(F.max_by("csn", F.struct(bound_at.alias("b"), *ORDER)).alias("cut"))
    return states(records.join(latest, list(KEY)).where(F.col("csn") <= F.col("cut")).drop("cut"))


def history(records: DataFrame) -> DataFrame:
    """The state after every record: a running fold, by one window for each key and property.

    A record at which a property is not mentioned carries the value since the last full record or tombstone."""
    running = Window.partitionBy(*KEY).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    epoch = F.sum(F.when(F.col("record_kind").isin(*FULL, "tombstone"), 1).otherwise(0)).over(running)
    numbered = records.withColumn("epoch", epoch).withColumn("turn", F.row_number().over(Window.partitionBy(*KEY).orderBy(*ORDER)))
    names = records.select(*KEY, F.explode(F.map_keys("props")).alias("name")).distinct()
    # one row for each record and property that its object ever has
    grid = numbered.join(names, list(KEY), "left").withColumn("said", F.when(F.map_contains_key("props", F.col("name")), F.struct(F.element_at("props", F.col("name")).alias("value"))))
    by_name = Window.partitionBy(*KEY, "name", "epoch").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.withColumn("now", F.last("said", ignorenulls=True).over(by_name))
    columns = ["record_id", "ts_us", "csn", "record_kind", "turn"]
    entry = F.when(F.col("now").isNotNull() & (F.col("record_kind") != "tombstone"), F.struct(F.col("name"), F.col("now.value").alias("value")))
    return filled.groupBy(*KEY, *columns).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("props")).withColumn("live", F.col("record_kind") != "tombstone")


def between(df: DataFrame, start: int, end: int, by: str = "csn") -> DataFrame:
    """The half-open window [start, end)."""
    return df.where((F.col(by) >= start) & (F.col(by) < end))


def needed(records: DataFrame, start: int, end: int, by: str) -> DataFrame:
    """The records that the states in a window depend on: those of the keys that it touches, up to their last one in it."""
    last = between(records, start, end, by).groupBy(*KEY).agg(F.max(order_of()).alias("_last"))
    return records.join(last, list(KEY)).where(order_of() <= F.col("_last")).drop("_last")


def property_diffs(records: DataFrame, start: int, end: int, by: str = "csn") -> DataFrame:
    """added, removed and changed properties against the state before, of records in the window."""
    before = Window.partitionBy(*KEY).orderBy("turn")
    told = history(needed(records, start, end, by)).withColumn("old", F.coalesce(F.lag("props").over(before), F.create_map().cast("map<string,string>")))
    told = between(told, start, end, by)
    names = F.array_union(F.map_keys("props"), F.map_keys("old"))
    rows = told.withColumn("name", F.explode(names)).select(*KEY, "record_id", "csn", "name", F.element_at("old", F.col("name")).alias("old_value"), F.element_at("props", F.col("name")).alias("new_value"), F.map_contains_key("old", F.col("name")).alias("was"), F.map_contains_key("props", F.col("name")).alias("is"))
    change = F.when(~F.col("was"), "added").when(~F.col("is"), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return rows.withColumn("change", change).where("change is not null").drop("was", "is")


def final_rows(records: DataFrame, start: int, end: int, by: str = "csn") -> DataFrame:
    """The states at the window's end of the objects that it touches."""
    touched = between(records, start, end, by).select(*KEY).distinct()
    upto = as_of(records, csn=end - 1) if by == "csn" else as_of(records, time_us=end - 1)
    return states(upto.join(touched, list(KEY), "left_semi"), tombstones=True)


def changes(records: DataFrame, start: int, end: int, mode: str = "state_transitions", by: str = "csn") -> DataFrame:
    if mode == "records":
        return between(records, start, end, by)
    if mode == "state_transitions":
        return between(history(needed(records, start, end, by)), start, end, by).drop("turn")
    if mode == "property_diffs":
        return property_diffs(records, start, end, by)
    if mode == "final_rows":
        return final_rows(records, start, end, by)
    raise QueryError("E_METHOD_CONFLICT", f"no change mode {mode}")


def on_branch(records: DataFrame, selector: str | int | None, branches: dict[str, int]) -> DataFrame:
    """default: branch 0; reject_ambiguous: raises where an object has several; else a name or number."""
    if selector in (None, "default"):
        return records.where("branch_key = 0")
    if selector == "reject_ambiguous":
        from .relational import fails

        several = Window.partitionBy("object_type", "goid")
        spread = records.withColumn("_least", F.min("branch_key").over(several)).withColumn("_most", F.max("branch_key").over(several))
        return spread.where(fails(F.col("_least") != F.col("_most"), "E_AMBIGUOUS_BRANCH")).drop("_least", "_most")
    key = branches.get(selector, selector) if isinstance(selector, str) else selector
    if isinstance(key, str):
        raise QueryError("E_UNKNOWN_BINDING", f"branch {selector}")
    return records.where(F.col("branch_key") == key)


def check_chain(records: DataFrame) -> DataFrame:
    """Records whose prev_ref is not the record before them."""
    before = F.lag("record_id").over(Window.partitionBy(*KEY).orderBy(*ORDER))
    return records.withColumn("expected_ref", before).where(~F.col("prev_ref").eqNullSafe(F.col("expected_ref")))


def chain(base: DataFrame, *deltas: DataFrame) -> DataFrame:
    """A base and its deltas in order, each record with its place in the chain."""
    out = base.withColumn("chain_ordinal", F.lit(0).cast("long"))
    for i, delta in enumerate(deltas, 1):
        out = out.unionByName(delta.withColumn("chain_ordinal", F.lit(i).cast("long")))
    return out


def pruned_chain(summaries: list[dict], csn: int | None = None, time_us: int | None = None) -> list[int]:
    """The ordinals of the deltas that an as-of read needs, from their least commit numbers and times."""
    keep = []
    for i, s in enumerate(summaries):
        if (csn is None or s["least_csn"] <= csn) and (time_us is None or s["least_ts_us"] <= time_us):
            keep.append(i)
    return keep


def validate_chain(manifest: list[dict]) -> None:
    """Every delta must name the digest of its parent, in rising order of commit numbers."""
    for before, now in zip(manifest, manifest[1:], strict=False):
        if now.get("parent") != before.get("digest"):
            raise QueryError("E_REF_INVALID", f"{now.get('digest')} does not follow {before.get('digest')}")
        if now["least_csn"] <= before["most_csn"]:
            raise QueryError("E_REF_INVALID", "commit numbers overlap")


def patched(base: DataFrame, patches: DataFrame) -> DataFrame:
    """Sparse patches (key, csn, op, name, value) over states (key, props): set, unset, and tombstone."""
    # a tombstone wipes what came before it in the chain
    wipe = patches.where("op = 'tombstone'").groupBy(*KEY).agg(F.max("csn").alias("wiped"))
    last = patches.groupBy(*KEY).agg(F.max_by("op", "csn").alias("last_op"))
    own = base.select(*KEY, F.explode("props").alias("name", "value")).withColumn("csn", F.lit(-1).cast("long")).withColumn("op", F.lit("set"))
    both = own.unionByName(patches.where("op <> 'tombstone'").select(*KEY, "name", "value", "csn", "op")).join(wipe, list(KEY), "left").where("wiped is null or csn > wiped")
    kept = both.groupBy(*KEY, "name").agg(F.max_by(F.struct("op", "value"), "csn").alias("x")).where("x.op = 'set'")
    props = kept.groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "x.value")))).alias("props"))
    keys = base.select(*KEY).unionByName(patches.select(*KEY)).distinct()
    out = keys.join(last, list(KEY), "left").where("last_op is null or last_op <> 'tombstone'").drop("last_op").join(props, list(KEY), "left")
    return out.select(*KEY, F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))


def compacted(records: DataFrame) -> DataFrame:
    """One baseline for each live object, and a tombstone for each dead one: the same states in one file."""
    kind = F.when(F.col("live"), "baseline").otherwise("tombstone")
    return states(records, tombstones=True).select(*KEY, "record_id", "ts_us", "csn", kind.alias("record_kind"), "props")


def checkpointed(records: DataFrame, csn: int) -> DataFrame:
    """A chain with what it says up to a commit number as one snapshot of each object, and the records after it as they
    are: later reads have the same states from fewer records, but none before that number."""
    upto, after = records.where(F.col("csn") <= csn), records.where(F.col("csn") > csn)
    kind = F.when(F.col("record_kind") == "baseline", "snapshot").otherwise(F.col("record_kind"))
    return compacted(upto).withColumn("record_kind", kind).unionByName(after.select(*KEY, "record_id", "ts_us", "csn", "record_kind", "props"))


def read_advice(base_rows: int, delta_rows: int, deltas: int, most_deltas: int = 8, most_share: float = 0.5) -> str:
    """What to do about read amplification: nothing, checkpoint or compact."""
    if base_rows and delta_rows / base_rows > most_share:
        return "compact"
    return "checkpoint" if deltas > most_deltas else "none"
