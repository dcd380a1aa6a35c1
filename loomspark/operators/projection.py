"""Projections of a mapped model: grains, temporal modes, the column expressions of projections, and row semantics.

A projection names what one of its rows stands for (its grain), which time it shows (its temporal mode), and an
expression for each column. Expressions become Columns: properties and literals stay in the plan as they are, and each
association that an expression asks for is one aggregate by the object, joined once."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from . import temporal
from .checkpoints import cut
from .mapping import kinds_of

#: What one row of a projection stands for.
GRAINS = ("one_row_per_object", "one_row_per_event_object", "one_row_per_object_as_of_time", "one_row_per_association", "one_row_per_link_object", "one_row_per_property_version", "one_row_per_evidence_assertion")
#: The time that a projection shows; the cuts take a number behind a colon or an equals sign.
MODES = ("latest_committed", "full_history", "commit_order", "valid_time", "observed_time")
TIME_CUTS, CSN_CUTS = ("as_of_timestamp_us", "timestamp_us", "as_of_time"), ("as_of_csn", "csn")
#: The properties that a surface must have for a mode.
NEEDS = {"valid_time": ("valid_from", "valid_to"), "observed_time": ("observed_at",)}
#: Names of an expression that are not properties.
SYSTEM = {"temporal.timestamp_us": "ts_us", "timestamp_us": "ts_us", "temporal.csn": "csn", "csn": "csn", "temporal.branch_key": "branch_key", "branch_key": "branch_key", "record.id": "record_id", "record.record_id": "record_id", "record.kind": "record_kind", "goid": "goid", "object.goid": "goid", "association.goid": "goid"}
OPERATORS = ("==", "!=", ">=", "<=", ">", "<")
AGGREGATES = ("count", "distinct_count", "sum", "avg", "min", "max", "list")


@dataclass
class Model:
    """A log of objects, a log of associations whose props hold source_goid and target_goid, evidence, and the types of
    properties (text, where nothing is said)."""

    records: DataFrame | None = None
    edge_records: DataFrame | None = None
    evidence: DataFrame | None = None
    types: dict[str, str] = field(default_factory=dict)


def at_time(records: DataFrame, mode: str, types: dict[str, str], when: str | None = None) -> DataFrame:
    """(key, props, csn, ts_us, record_id, record_kind) of the log as a temporal mode shows it."""
    cut = re.fullmatch(r"(\w+)[:=](\d+)", mode)
    latest = lambda rows: temporal.states(rows).withColumn("record_kind", F.lit("state")).drop("live")
    if cut and cut[1] in TIME_CUTS:
        return latest(temporal.as_of(records, time_us=int(cut[2])))
    if cut and cut[1] in CSN_CUTS:
        return latest(temporal.as_of(records, csn=int(cut[2])))
    if mode not in MODES:
        raise QueryError("E_UNKNOWN_PROJECTION", f"temporal mode {mode}")
    missing = [c for c in NEEDS.get(mode, ()) if c not in types]
    if missing:
        raise QueryError("E_UNKNOWN_PROJECTION", f"{mode} needs the property {missing[0]}")
    if mode == "latest_committed":
        return latest(records)
    if mode == "valid_time":
        rows = latest(records)
        if when is None:
            return rows
        start, end = (F.element_at("props", F.lit(c)).cast(types[c]) for c in NEEDS[mode])
        at = F.lit(when).cast(types["valid_from"])
        return rows.where((start.isNull() | (start <= at)) & (end.isNull() | (at < end)))
    rows = records.select(*temporal.KEY, "props", "csn", "ts_us", "record_id", "record_kind")
    if mode == "observed_time":
        return rows.where(F.element_at("props", F.lit("observed_at")).isNotNull())
    return rows


def projected(model: Model, grain: str, anchor: str, columns: dict[str, str], mode: str = "latest_committed", when: str | None = None) -> DataFrame:
    """The rows of a projection. ``anchor`` is the type of its objects or associations; ``columns`` are expressions.

    Property versions have property, value and csn, one row for each record that says something about a property;
    assertions are the evidence of the anchor's objects."""
    if grain not in GRAINS:
        raise QueryError("E_UNKNOWN_PROJECTION", f"grain {grain}")
    linked = grain in ("one_row_per_association", "one_row_per_link_object")
    log = model.edge_records if linked else model.records
    if log is None:
        raise QueryError("E_UNKNOWN_PROJECTION", f"{grain} has no rows to show")
    log = log.where(F.col("object_type") == anchor)
    if grain == "one_row_per_evidence_assertion":
        if model.evidence is None:
            raise QueryError("E_UNKNOWN_PROJECTION", "no evidence")
        return model.evidence.join(log.select("goid").distinct(), "goid", "left_semi").select(*columns.values()).toDF(*columns)
    if grain == "one_row_per_property_version":
        rows = at_time(log, "full_history" if mode == "latest_committed" else mode, model.types, when)
        rows = rows.where("record_kind <> 'tombstone'").select(*temporal.KEY, "csn", "ts_us", "record_id", "record_kind", F.explode("props").alias("property", "value"))
        rows = rows.withColumn("props", F.create_map(F.lit("property"), F.col("property"), F.lit("value"), F.col("value"))).drop("property", "value")
    elif grain == "one_row_per_object_as_of_time" and mode == "full_history":
        rows = temporal.history(log).where("live").drop("turn", "live")
    else:
        rows = at_time(log, mode, model.types, when)
    return Expressions(model, rows).select(columns)


class Expressions:
    """Compiles the expressions of one projection over its rows."""

    def __init__(self, model: Model, rows: DataFrame):
        self.model, self.rows, self.joined = model, rows, 0
        self.edges: dict[str, DataFrame] = {}  # the associations of each type, folded once

    def select(self, columns: dict[str, str]) -> DataFrame:
        if any("association" in text for text in columns.values()):
            self.rows = cut(self.rows)
        made = {name: self.value(text) for name, text in columns.items()}
        return self.rows.select(*[x.alias(n) for n, x in made.items()])

    def value(self, text: str) -> Column:
        text = text.strip()
        if call := re.fullmatch(r"([a-z_]+)\((.*)\)", text, re.DOTALL):
            return self.call(call[1], split_arguments(call[2]))
        if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
            return F.lit(text[1:-1])
        if re.fullmatch(r"-?\d+", text):
            return F.lit(int(text)).cast("long")
        if re.fullmatch(r"-?\d+\.\d+", text):
            return F.lit(float(text))
        if text in ("true", "false"):
            return F.lit(text == "true")
        if text == "null":
            return F.lit(None).cast("string")
        if text in SYSTEM:
            return F.col(SYSTEM[text])
        if text.startswith("association."):
            return self.associated(text, "list")
        name = text.rsplit(".", 1)[-1]
        if not re.fullmatch(r"\w+", name):
            raise QueryError("E_UNKNOWN_PROJECTION", f"expression {text}")
        x = F.element_at("props", F.lit(name))
        return x.cast(self.model.types[name]) if name in self.model.types else x

    def call(self, function: str, arguments: list[str]) -> Column:
        if function in ("if", "ifelse") and len(arguments) == 3:
            return F.when(self.condition(arguments[0]), self.value(arguments[1])).otherwise(self.value(arguments[2]))
        if function == "coalesce" and arguments:
            return F.coalesce(*map(self.value, arguments))
        if function == "association":
            return self.associated(f"association({', '.join(arguments)})", "list")
        if len(arguments) != 1:
            raise QueryError("E_UNKNOWN_PROJECTION", f"{function} with {len(arguments)} arguments")
        (inner,) = arguments
        if function in AGGREGATES and inner.startswith("association"):
            return self.associated(inner, function)
        x = self.value(inner)
        if function == "exists":
            return x.isNotNull()
        if function == "identity":
            return x
        if function == "trim":
            return F.trim(x)
        if function in ("lower", "lowercase", "upper", "uppercase"):  # ASCII letters only
            small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
            return F.translate(x, large, small) if function.startswith("l") else F.translate(x, small, large)
        if function == "count":
            return x.isNotNull().cast("long")
        raise QueryError("E_UNKNOWN_PROJECTION", f"function {function}")

    def condition(self, text: str) -> Column:
        """A comparison by the first operator in it, else whether a value is true: not null, false, zero or empty."""
        for op in OPERATORS:
            if op in text:
                left, right = (x.strip() for x in text.split(op, 1))
                return self.compared(left, right, op)
        x = self.value(text)
        kind = self.kind(x)
        if kind == "boolean":
            return F.coalesce(x, F.lit(False))
        if kind == "string":
            return F.coalesce(x != "", F.lit(False))
        return F.coalesce(F.size(x) > 0 if kind.startswith(("array", "map")) else x != 0, F.lit(False))

    def kind(self, x: Column) -> str:
        return self.rows.select(x.alias("x")).dtypes[0][1]

    def compared(self, left: str, right: str, op: str) -> Column:
        """Numbers compare as numbers; all else as JSON text, in which null is a word and text stands in quotes. Values of
        different kinds are never equal."""
        a, b = self.value(left), self.value(right)
        numbers = [self.kind(x) in ("tinyint", "smallint", "int", "bigint", "float", "double") or self.kind(x).startswith("decimal") for x in (a, b)]
        if not all(numbers):
            texts = []
            for x in (a, b):
                quoted = F.concat(F.lit('"'), x, F.lit('"')) if self.kind(x) == "string" else F.to_json(x) if self.kind(x).startswith(("array", "map", "struct")) else x.cast("string")
                texts.append(F.coalesce(quoted, F.lit("null")))
            a, b = texts
        if op == "==":
            return a.eqNullSafe(b)
        if op == "!=":
            return ~a.eqNullSafe(b)
        compare = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
        return F.coalesce(compare, F.lit(False))

    def associated(self, text: str, function: str) -> Column:
        """association.Type[.role].property, association(Type[, role]): an aggregate over the associations at whose end
        ``role`` (either, if none is said) the object stands, of a property or of their ids."""
        if found := re.fullmatch(r"association\(\s*(\w+)\s*(?:,\s*(\w+)\s*)?\)", text):
            kind, role, name = found[1], found[2], None
        elif found := re.fullmatch(r"association\.(\w+)(?:\.(source|target))?\.(\w+)", text):
            kind, role, name = found.groups()
        else:
            raise QueryError("E_UNKNOWN_PROJECTION", f"expression {text}")
        if self.model.edge_records is None or role not in (None, "source", "target"):
            raise QueryError("E_UNKNOWN_PROJECTION", f"expression {text}")
        if kind not in self.edges:
            self.edges[kind] = cut(temporal.states(self.model.edge_records.where(F.col("object_type") == kind)))
        edges = self.edges[kind]
        ends = [r for r in ("source", "target") if role in (None, r)]
        value = F.col("goid") if name is None else F.element_at("props", F.lit(name))
        typed = value.cast(self.model.types[name]) if name in self.model.types else value
        at = F.explode(F.array_distinct(F.array(*[F.element_at("props", F.lit(f"{e}_goid")) for e in ends])))
        told = edges.select(at.alias("_at"), typed.alias("_v"), F.col("ts_us").alias("_t"), F.col("goid").alias("_g")).where("_at is not null")
        result = {"count": F.count("_v"), "distinct_count": F.count_distinct("_v"), "sum": F.sum(F.col("_v").cast("double")), "avg": F.avg(F.col("_v").cast("double")), "min": F.min("_v"), "max": F.max("_v"), "list": F.transform(F.sort_array(F.collect_list(F.struct("_t", "_g", "_v"))), lambda x: x["_v"])}[function]
        self.joined += 1
        column = f"_associated{self.joined}"
        found = told.groupBy("_at").agg(result.alias(column))
        self.rows = self.rows.join(found, F.col("goid") == F.col("_at"), "left").drop("_at")
        if function in ("count", "distinct_count"):
            return F.coalesce(column, F.lit(0))
        return F.coalesce(F.col(column), F.array()) if function == "list" else F.col(column)


def split_arguments(text: str) -> list[str]:
    """Arguments between commas that stand outside brackets and quotes."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and depth == 0:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()] if text.strip() else []


# ---- row semantics

#: The kinds of row rules, and whether they make objects and associations.
ROW_KINDS = {
    "Object": (True, True), "EventObject": (True, True), "LinkObject": (True, True), "Composite": (True, True), "Dispatched": (True, True), "KeyValueFragment": (True, True),
    "Tombstone": (True, False), "AssociationOnly": (False, True), "EvidenceOnly": (False, False), "ProjectionOnly": (False, False),
}


@dataclass
class RowRule:
    """What a source row means. ``links`` are (association type, column of the target's id). A composite has ``parts``, each
    a rule of its own for the same row; a dispatched rule takes the one of ``by_value`` for the row's ``dispatch`` column;
    a key-value fragment names its property and value by two columns."""

    kind: str
    object_type: str = ""
    key: str = ""
    properties: list[str] = field(default_factory=list)
    operation: str = "fact"
    links: list[tuple[str, str]] = field(default_factory=list)
    parts: list[RowRule] = field(default_factory=list)
    dispatch: str = ""
    by_value: dict[str, RowRule] = field(default_factory=dict)
    name_column: str = "name"
    value_column: str = "value"


RECORD = "object_type string, branch_key long, goid string, record_id string, ts_us long, csn long, record_kind string, props map<string,string>"


def materialised(rows: DataFrame, rule: RowRule, csn: str = "csn", ts_us: str = "ts_us") -> dict[str, DataFrame]:
    """The records, edge_records and evidence (goid, row digest) that ``rows`` make under a rule."""
    if rule.kind not in ROW_KINDS:
        raise QueryError("E_UNKNOWN_BINDING", f"row semantics {rule.kind}")
    if rule.kind in ("Composite", "Dispatched"):
        inner = [(rows, part) for part in rule.parts] if rule.kind == "Composite" else [(rows.where(F.col(rule.dispatch) == v), part) for v, part in rule.by_value.items()]
        if not inner:
            raise QueryError("E_UNKNOWN_BINDING", f"{rule.kind} without rules")
        made = [materialised(own, part, csn, ts_us) for own, part in inner]
        out = made[0]
        for other in made[1:]:
            out = {k: df.unionByName(other[k]) for k, df in out.items()}
        return out
    spark = rows.sparkSession
    objects, links = ROW_KINDS[rule.kind]
    kind = F.lit("tombstone") if rule.kind == "Tombstone" else kinds_of(F.lit(rule.operation))
    goid, none = F.col(rule.key).cast("string"), F.create_map().cast("map<string,string>")

    def record(object_type: str, id_: Column, props: Column) -> DataFrame:
        told = F.when(kind == "tombstone", none).otherwise(props)
        made = rows.where(id_.isNotNull()).select(F.lit(object_type).alias("object_type"), F.lit(0).cast("long").alias("branch_key"), id_.alias("goid"), F.sha2(F.concat_ws(":", F.lit(object_type), id_, F.col(csn).cast("string")), 256).alias("record_id"), F.col(ts_us).cast("long").alias("ts_us"), F.col(csn).cast("long").alias("csn"), kind.alias("record_kind"), told.alias("props"))
        return made

    empty = spark.createDataFrame([], RECORD)
    records, edges = empty, empty
    if objects:
        if rule.kind == "KeyValueFragment":
            props = F.create_map(F.col(rule.name_column).cast("string"), F.col(rule.value_column).cast("string"))
        else:
            props = F.create_map(*[x for p in rule.properties for x in (F.lit(p), F.col(p).cast("string"))]).cast("map<string,string>") if rule.properties else none
        records = record(rule.object_type, goid, props)
    if links:
        for association, target in rule.links:
            to = F.col(target).cast("string")
            ends = F.create_map(F.lit("source_goid"), goid, F.lit("target_goid"), to)
            edges = edges.unionByName(record(association, F.concat_ws(">", F.lit(association), goid, to), ends).where(F.col("props")["target_goid"].isNotNull() | (F.col("record_kind") == "tombstone")))
    proof = rows.select(goid.alias("goid"), F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256).alias("digest"))
    return {"records": records, "edge_records": edges, "evidence": proof if rule.kind != "ProjectionOnly" else proof.limit(0)}
