"""Entity resolution and mapping: identity keys, merges, candidates, conflicts, associations, evidence, projections."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import QueryError
from ..functions.normalize import pipeline
from .graph import min_labels
from .checkpoints import cut
from .relational import fails

#: Confidence classes, the strongest first, and alias misses.
CLASSES = ("authoritative", "strong_deterministic", "source_scoped", "candidate")
MISSES = ("reject", "candidate_only", "source_scoped", "normalized_value")


@dataclass
class IdentityRule:
    """How a source's rows are identified: components (column, steps), and how sure that makes."""

    name: str
    object_type: str
    components: list[tuple[str, list[str]]]
    confidence: str = "authoritative"
    auto_merge: bool | None = None
    nulls: str = "reject"
    order: int = 0


@dataclass
class Source:
    name: str
    rows: DataFrame
    row_key: str
    rules: list[IdentityRule] = field(default_factory=list)
    priority: int = 0


def encoded(parts: list[Column]) -> Column:
    """Parts as one text in which lengths come first, so that different tuples differ; null has a mark of its own."""
    return F.concat(*[F.when(p.isNull(), F.lit("n;")).otherwise(F.concat(F.char_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"), F.lit(";"))) for p in parts])


def join_key(rule: IdentityRule) -> Column:
    parts = [pipeline(F.col(c).cast("string"), steps) for c, steps in rule.components]
    if rule.nulls == "reject":
        missing = parts[0].isNull()
        for p in parts[1:]:
            missing = missing | p.isNull()
        return F.when(~missing, encoded(parts))
    return encoded(parts)


def plan_identities(sources: list[Source]) -> DataFrame:
    """(source, row, object_type, rule, class_rank, rule_order, source_order, key, merge_group) of every row and rule.

    Rows of one merge group are one object: authoritative groups are global, source-scoped ones hold within a source,
    and others are alone. Different rules never share a group."""
    out = None
    for place, source in enumerate(sources):
        for rule in source.rules:
            key = join_key(rule)
            merges = rule.confidence == "authoritative" and rule.auto_merge is not False or rule.confidence == "strong_deterministic" and rule.auto_merge is True
            row = F.col(source.row_key).cast("string")
            scope = [F.lit(rule.object_type), F.lit(rule.name)]
            if merges:
                group = encoded([*scope, key])
            elif rule.confidence == "source_scoped":
                group = encoded([*scope, F.lit(source.name), key])
            else:
                group = encoded([*scope, F.lit(source.name), row, F.lit("alone")])
            part = source.rows.select(
                F.lit(source.name).alias("source"), row.alias("row"), F.lit(rule.object_type).alias("object_type"), F.lit(rule.name).alias("rule"), F.lit(CLASSES.index(rule.confidence)).alias("class_rank"),
                F.lit(rule.order).alias("rule_order"), F.lit(place).alias("source_order"), key.alias("key"), F.when(key.isNotNull(), F.sha2(group, 256)).alias("merge_group"),
            )
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise QueryError("E_UNKNOWN_BINDING", "no identity rules")
    return out


def merge(planned: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """(source, row, component): connected over merge groups and reviewed same_object pairs (a_source, a_row, b_source, b_row, decision).

    A do_not_merge pair that ends in one component raises."""
    node = F.sha2(encoded([F.col("source"), F.col("row")]), 256)
    rows = cut(planned.where("merge_group is not null").select("source", "row", "merge_group", node.alias("node")))
    if reviewed is None and rows.groupBy("node").agg(F.min("merge_group").alias("one"), F.max("merge_group").alias("other")).where("one <> other").isEmpty():
        # every row is in one group, so the groups are the components: one aggregate instead of rounds
        least = rows.groupBy("merge_group").agg(F.min("node").alias("component"))
        return rows.select("source", "row", "merge_group").distinct().join(least, "merge_group").select("source", "row", "component")
    edges = rows.select(F.col("node").alias("src"), F.concat(F.lit("g"), "merge_group").alias("dst"))
    if reviewed is not None:
        pairs = reviewed.select("decision", F.sha2(encoded([F.col("a_source"), F.col("a_row")]), 256).alias("src"), F.sha2(encoded([F.col("b_source"), F.col("b_row")]), 256).alias("dst"))
        edges = edges.unionByName(pairs.where("decision = 'same_object'").select("src", "dst"))
    labels = min_labels(edges.withColumn("edge", F.lit(0)))
    out = rows.select("source", "row", "node").distinct().join(labels, "node")
    if reviewed is not None:
        apart = pairs.where("decision = 'do_not_merge'")
        own = labels.select(F.col("node").alias("src"), F.col("label").alias("a"))
        other = labels.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        broken = apart.join(own, "src").join(other, "dst").where("a = b").select(F.col("a").alias("label"), F.lit(True).alias("broken")).distinct()
        out = out.join(broken, "label", "left").where(fails(F.coalesce("broken", F.lit(False)), "E_REF_INVALID: do_not_merge")).drop("broken")
    return out.select("source", "row", F.col("label").alias("component"))


def anchors(planned: DataFrame, merged: DataFrame) -> DataFrame:
    """(component, source, row, rule, key): the strongest identity of each component."""
    order = F.struct("class_rank", "rule_order", "source_order", "key", "row")
    best = planned.where("merge_group is not null").join(merged, ["source", "row"]).groupBy("component", "object_type").agg(F.min_by(F.struct("source", "row", "rule", "key"), order).alias("a"))
    return best.select("component", "object_type", "a.*")


def goid(mapping: str, version: str, object_type: Column, key: Column, scope: str = "") -> Column:
    """32 hexadecimal digits from the digest of the length-prefixed parts."""
    return F.substring(F.sha2(encoded([F.lit(mapping), F.lit(version), object_type, F.lit("anchor"), key, F.lit(scope)]), 256), 1, 32)


def resolve_aliases(observed: DataFrame, column: str, catalog: DataFrame, steps: list[str], on_miss: str = "normalized_value", redact: bool = False) -> DataFrame:
    """Adds normalized, canonical and resolution; ``catalog(alias, canonical)`` is normalised by the same steps.

    An alias of several canonical values is ambiguous and stays a candidate."""
    if on_miss not in MISSES:
        raise QueryError("E_UNKNOWN_BINDING", on_miss)
    known = catalog.select(pipeline(F.col("alias"), steps).alias("_alias"), "canonical").groupBy("_alias").agg(F.min("canonical").alias("_canonical"), F.count_distinct("canonical").alias("_many"))
    joined = observed.withColumn("normalized", pipeline(F.col(column), steps)).join(known, F.col("normalized") == F.col("_alias"), "left")
    hit, clear = F.col("_many").isNotNull(), F.col("_many") == 1
    if on_miss == "reject":
        joined = joined.where(fails(~hit, "E_UNKNOWN_BINDING"))
    miss = {"normalized_value": F.col("normalized"), "source_scoped": F.col(column), "candidate_only": F.lit(None), "reject": F.lit(None)}[on_miss]
    out = joined.withColumn("canonical", F.when(clear, F.col("_canonical")).when(~F.coalesce(hit, F.lit(False)), miss))
    out = out.withColumn("resolution", F.when(clear, "resolved").when(hit, "ambiguous").otherwise(on_miss)).drop("_alias", "_canonical", "_many")
    return out.withColumn(column, F.lit("<redacted>")) if redact else out


def import_aliases(spark, path: str, alias: str = "alias", canonical: str = "canonical", steps: list[str] | None = None) -> DataFrame:
    """A catalogue (alias, canonical) from a tabular file: blank rows go, repeats count once, and an alias that names two
    canonical values raises when the catalogue is read."""
    from ..sources.files import read

    rows = read(spark, path)
    for c in (alias, canonical):
        if c not in rows.columns:
            raise QueryError("E_UNKNOWN_BINDING", f"no column {c}")
    told = rows.select(F.trim(F.col(alias).cast("string")).alias("alias"), F.trim(F.col(canonical).cast("string")).alias("canonical")).where("alias <> '' and canonical <> ''")
    told = told.withColumn("_key", pipeline(F.col("alias"), steps or []))
    out = told.groupBy("_key").agg(F.min("alias").alias("alias"), F.min("canonical").alias("canonical"), F.max("canonical").alias("_other"))
    return out.where(fails(F.col("canonical") != F.col("_other"), "E_REF_INVALID: alias of two values")).select("alias", "canonical")


def candidates(rows: DataFrame, key: str, value: str, steps: list[str], prefix: int | None, threshold: int, scale: int = 100, pair_limit: int | None = None) -> DataFrame:
    """(left, right, block, score): pairs that share a token, within blocks of equal normalised prefixes, by token Jaccard.

    Two rows of a Jaccard of t or more share one of the n - ceil(t n) + 1 rarest tokens of each, so only these are joined:
    common words, which meet everything, are seldom among them. Rows of a block without a common token never meet
    (their score is 0). With a pair limit a rule that exceeds it gives no pairs at all."""
    normal = pipeline(F.col(value), steps)
    told = rows.select(F.col(key).cast("string").alias("id"), normal.alias("text")).where("text is not null")
    told = told.withColumn("block", F.substring("text", 1, prefix) if prefix else F.lit("")).withColumn("tokens", F.array_distinct(F.filter(F.split("text", r"\s+"), lambda t: t != "")))
    told = cut(told.select("id", "block", "tokens"))
    each = told.select("id", "block", "tokens", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("often"))
    rare = each.join(often, "token").groupBy("id", "block", "tokens").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("t"))
    keep = F.greatest(F.lit(0), F.size("t") - F.ceil(F.size("t") * F.lit(threshold) / F.lit(scale) - 1e-9).cast("int") + 1)
    first = cut(rare.select("id", "block", "tokens", F.explode(F.slice("t", 1, F.least(F.size("t"), keep))).alias("x")).select("id", "block", "tokens", "x.token"))
    a, b = first.select(F.col("id").alias("left"), "block", "token", F.col("tokens").alias("a")), first.select(F.col("id").alias("right"), "block", "token", F.col("tokens").alias("b"))
    short = lambda x, y: F.least(F.size(x), F.size(y)) * scale >= F.greatest(F.size(x), F.size(y)) * threshold
    common = F.size(F.array_intersect("a", "b"))
    score = F.floor(common * scale / (F.size("a") + F.size("b") - common)).cast("long")
    met = a.join(b, ["block", "token"]).where("left < right").where(short("a", "b")).select("left", "right", "block", score.alias("score"))
    found = met.where(F.col("score") >= threshold).distinct()
    if pair_limit is not None:
        found = cut(found)
        if found.limit(pair_limit + 1).count() > pair_limit:
            return found.limit(0)
    return found


def candidate_id(rule: str) -> Column:
    return F.sha2(F.to_json(F.struct(F.lit(rule).alias("rule"), "left", "right", "block", "score")), 256)


def assertions(source: Source, goids: DataFrame, bindings: dict[str, str | Column], missing: str = "null", order: int = 0) -> DataFrame:
    """(goid, property, value, source, row, priority, source_order): one row for each object, property and source row."""
    named = [F.struct(F.lit(name).alias("property"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("value")) for name, c in bindings.items()]
    rows = source.rows.withColumn("row", F.col(source.row_key).cast("string")).join(goids.where(F.col("source") == source.name).select("row", "goid"), "row")
    out = rows.select("goid", "row", F.explode(F.array(*named)).alias("p")).select("goid", "p.property", "p.value", F.lit(source.name).alias("source"), "row", F.lit(source.priority).alias("priority"), F.lit(order).alias("source_order"))
    return out.where(fails(F.col("value").isNull(), "E_UNKNOWN_PROPERTY: missing value")) if missing == "reject" else out


def settle(asserted: DataFrame, policy: str = "reject_conflict") -> DataFrame:
    """(goid, property, value, suppressed long): one value for each; null never overwrites."""
    told = asserted.where("value is not null")
    if policy == "reject_conflict":
        out = told.groupBy("goid", "property").agg(F.min("value").alias("value"), F.max("value").alias("other"))
        return out.where(fails(F.col("value") != F.col("other"), "E_PROPERTY_CONFLICT")).select("goid", "property", "value", F.lit(0).cast("long").alias("suppressed"))
    if policy == "source_priority_wins":
        best = F.min_by("value", F.struct("priority", "source_order", "row"))
        return told.groupBy("goid", "property").agg(best.alias("value"), (F.count("*") - 1).alias("suppressed"))
    raise QueryError("E_UNKNOWN_BINDING", policy)


def associations(rows: DataFrame, source_ids: DataFrame, target_ids: DataFrame, source_key: Column, target_key: Column, assoc_type: str, valid_from: Column | None = None, valid_to: Column | None = None, missing: str = "skip") -> DataFrame:
    """Edges between identities ``(key, goid)``; an endpoint that is missing is skipped or raises."""
    none = F.lit(None).cast("string")
    told = rows.select(source_key.alias("_s"), target_key.alias("_t"), (none if valid_from is None else valid_from).alias("valid_from"), (none if valid_to is None else valid_to).alias("valid_to"))
    how = "left" if missing == "error" else "inner"
    joined = told.join(source_ids.select(F.col("key").alias("_s"), F.col("goid").alias("source_goid")), "_s", how).join(target_ids.select(F.col("key").alias("_t"), F.col("goid").alias("target_goid")), "_t", how)
    if missing == "error":
        joined = joined.where(fails(F.col("source_goid").isNull() | F.col("target_goid").isNull(), "E_UNKNOWN_BINDING: endpoint"))
    return joined.select(F.lit(assoc_type).alias("assoc_type"), F.substring(F.sha2(encoded([F.lit(assoc_type), F.col("source_goid"), F.col("target_goid")]), 256), 1, 32).alias("assoc_goid"), "source_goid", "target_goid", "valid_from", "valid_to")


def valid_at(edges: DataFrame, when: Column) -> DataFrame:
    """valid_from <= when < valid_to; a null bound is open."""
    return edges.where((F.col("valid_from").isNull() | (F.col("valid_from") <= when)) & (F.col("valid_to").isNull() | (when < F.col("valid_to"))))


def evidence(asserted: DataFrame, kind: str = "property") -> DataFrame:
    """One entry for each assertion, with a digest of what was asserted."""
    return asserted.select(F.lit(kind).alias("grain"), "goid", "property", "source", "row", F.sha2(encoded([F.col("goid"), F.col("property"), F.col("value"), F.col("source"), F.col("row")]), 256).alias("digest"))


def multi_value(rows: DataFrame, key: list[str], value: str, order: str, policy: str) -> DataFrame:
    """(key, value) under reject, first, last, list or explode (an empty list gives one null row)."""
    listed = rows.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))
    if policy == "reject":
        return listed.where(fails(F.size("values") > 1, "E_PROJECTION_MULTI_VALUE")).select(*key, F.try_element_at("values", F.lit(1)).alias(value))
    if policy in ("first", "last"):
        return listed.select(*key, F.try_element_at("values", F.lit(1 if policy == "first" else -1)).alias(value))
    if policy == "list":
        return listed.withColumnRenamed("values", value)
    if policy == "explode":
        return listed.select(*key, F.explode_outer("values").alias(value))
    raise QueryError("E_UNKNOWN_PROJECTION", policy)


def associated(objects: DataFrame, edges: DataFrame, target: DataFrame, column: str, function: str) -> DataFrame:
    """For each of ``objects(goid)`` an aggregate over the associated rows of ``target(goid, column)``."""
    values = edges.select(F.col("source_goid").alias("goid"), F.col("target_goid")).join(target.select(F.col("goid").alias("target_goid"), column), "target_goid")
    functions = {
        "count": F.count(column), "list": F.sort_array(F.collect_list(column)), "distinct_count": F.count_distinct(column), "min": F.min(column), "max": F.max(column), "sum": F.sum(F.col(column).cast("double")), "avg": F.avg(F.col(column).cast("double")),
    }
    found = objects.select("goid").join(values.groupBy("goid").agg(functions[function].alias("value")), "goid", "left")
    empty = {"count": F.lit(0), "distinct_count": F.lit(0), "sum": F.lit(0.0), "list": F.array()}.get(function)
    return found if empty is None else found.withColumn("value", F.coalesce("value", empty.cast(dict(found.dtypes)["value"])))


def property_versions(objects: DataFrame) -> DataFrame:
    """(goid, property, value), one row for each property of ``objects(goid, props)``."""
    return objects.select("goid", F.explode("props").alias("property", "value"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other; empty if both are equal."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def diff_maps(old: dict, new: dict) -> dict[str, list[str]]:
    return {"added": sorted(new.keys() - old.keys()), "removed": sorted(old.keys() - new.keys()), "changed": sorted(k for k in old.keys() & new.keys() if old[k] != new[k])}


def semantic_delta(before: DataFrame, after: DataFrame, csn: int, ts_us: int) -> DataFrame:
    """Delta records that turn the states ``before`` into ``after``, both (object_type, branch_key, goid, props)."""
    key = ["object_type", "branch_key", "goid"]
    both = before.select(*key, F.col("props").alias("old")).join(after.select(*key, F.col("props").alias("new")), key, "full")
    # maps do not compare; their sorted entries do
    entries = lambda c: F.to_json(F.sort_array(F.map_entries(c)))
    kind = F.when(F.col("new").isNull(), "tombstone").when(F.col("old").isNull(), "baseline").when(entries("old") != entries("new"), "snapshot")
    told = both.withColumn("record_kind", kind).where("record_kind is not null")
    return told.select(*key, F.concat(F.lit(f"d{csn}-"), "goid").alias("record_id"), F.lit(ts_us).cast("long").alias("ts_us"), F.lit(csn).cast("long").alias("csn"), "record_kind", F.coalesce("new", F.create_map().cast("map<string,string>")).alias("props"))


def worklist(found: DataFrame, rule: str, decided: DataFrame | None = None) -> DataFrame:
    """Candidates that wait for a decision: (candidate_id, left, right, score, status)."""
    items = found.withColumn("candidate_id", candidate_id(rule)).select("candidate_id", "left", "right", "score", F.lit("open").alias("status"))
    return items if decided is None else items.join(decided.select("candidate_id"), "candidate_id", "left_anti")


def decisions(items: DataFrame, verdicts: DataFrame, source: str) -> DataFrame:
    """Verdicts (candidate_id, decision) on items of a worklist as reviewed pairs for ``merge``."""
    return items.join(verdicts, "candidate_id").select(F.lit(source).alias("a_source"), F.col("left").alias("a_row"), F.lit(source).alias("b_source"), F.col("right").alias("b_row"), "decision")


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order: the sum of 60-bit parts of row digests."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    part = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    row = df.agg(F.count("*").alias("n"), F.sum(part).alias("s")).first()
    return f"{row['n']}:{row['s'] or 0}"


def stale(recorded: dict[str, str], now: dict[str, DataFrame]) -> list[str]:
    """The names whose tables no longer have the digest that was recorded when a mapping was built."""
    return sorted(name for name, df in now.items() if recorded.get(name) != content_digest(df))


def kinds_of(operation: Column) -> Column:
    """The record kind of a source operation; unknown ones raise."""
    from .temporal import OPERATION_KINDS

    out = None
    for name, kind in OPERATION_KINDS.items():
        out = F.when(operation == name, kind) if out is None else out.when(operation == name, kind)
    return out.otherwise(F.raise_error(F.concat(F.lit("E_UNKNOWN_BINDING: "), operation)).cast("string"))


def records_of(rows: DataFrame, object_type: str, key: Column, operation: Column, csn: Column, ts_us: Column, properties: list[str]) -> DataFrame:
    """Log records of source rows: a tombstone carries no properties."""
    kind = kinds_of(operation)
    entries = F.create_map(*[x for p in properties for x in (F.lit(p), F.col(p).cast("string"))])
    empty = F.create_map().cast("map<string,string>")
    return rows.select(
        F.lit(object_type).alias("object_type"), F.lit(0).cast("long").alias("branch_key"), key.cast("string").alias("goid"), F.sha2(encoded([key, csn]), 256).alias("record_id"), ts_us.cast("long").alias("ts_us"), csn.cast("long").alias("csn"),
        kind.alias("record_kind"), F.when(kind == "tombstone", empty).otherwise(entries).alias("props"),
    )
