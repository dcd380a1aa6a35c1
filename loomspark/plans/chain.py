"""A query chain to a DataFrame.

Methods take effect by kind, not by place: temporal scope, lookups, joins, set operations, windows, ``where``, groups
and aggregates, order, skip and take. Sorting of aggregates comes after the aggregation, as in SQL."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..lang.parser import parse
from ..lang.tree import AGGREGATES, WINDOW_ONLY, Arg, Both, Call, Compare, Literal, Not, Path, Query, render, walk
from ..operators import graph, relational, temporal, vectors
from ..sources.catalog import Catalog
from .expressions import Scope, predicate, value, window_of

RELATIONAL = ("where", "select", "groupBy", "orderBy", "take", "skip", "join", "semiJoin", "antiJoin", "lookup", "union", "intersect", "except", "with", "withRecursive", "window", "policy")
TEMPORAL = ("asOf", "history", "changes", "branch", "includeTombstones")
GRAPH = ("traverse", "reachable", "shortestPath", "allPaths", "kShortestPaths", "connectedComponents", "degree", "pageRank", "hits", "centrality", "triangleCount", "clusteringCoefficient", "community", "spanningTree", "in", "out", "either")
AI = ("similar", "hybrid", "rerank", "embedding")
#: The profile of each root; roots of different ones are joined over a declared bridge only.
PROFILES = {"object": "object", "association": "object", "evidence": "object", "node": "graph", "edge": "graph", "path": "graph"}
#: Fixed value: rows that a query may return without an explicit take, where the caller asks for that guard.
MOST_ROWS = 10_000


def query(catalog: Catalog, text: str | Query, row_budget: bool = False) -> DataFrame:
    tree = parse(text) if isinstance(text, str) else text
    return Planner(catalog).run(tree, row_budget)


def fingerprint(text: str | Query) -> str:
    tree = parse(text) if isinstance(text, str) else text
    return hashlib.sha256(render(tree).encode()).hexdigest()


#: What an explanation may be asked for.
EXPLAIN_MODES = ("public", "developer", "proof", "coded", "ai", "forensic")


def explain(catalog: Catalog, text: str | Query, mode: str | None = None) -> str:
    """An explanation: one line of JSON, and under it a plan of Spark where the mode has one. ``mode`` comes before that
    of the chain's own ``explain`` directive.

    public: the chain alone, no names of columns or plans. developer: also the columns and the formatted plan. proof:
    the filters and columns that reach each scan, as evidence of what is not read. coded: the optimised logical plan.
    ai: whether vectors or texts leave the engine. forensic: everything, with the extended plan."""
    tree = parse(text) if isinstance(text, str) else text
    mode = mode or (tree.explain if isinstance(tree.explain, str) else None) or "developer"
    if mode not in EXPLAIN_MODES:
        raise QueryError("E_PARSE", f"explain {mode}")
    df = query(catalog, tree)
    execution, modes = df._jdf.queryExecution(), df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    shown = lambda kind: execution.explainString(modes.fromString(kind))
    told = {"mode": mode, "root": render(tree.root), "methods": [m.name if mode == "public" else render(m) for m in tree.methods], "fingerprint": fingerprint(tree)}
    if mode in ("developer", "forensic"):
        told["columns"] = df.dtypes
    if mode in ("proof", "forensic"):
        lines = [x.strip() for x in shown("formatted").splitlines()]
        told["scans"] = [x for x in lines if x.startswith(("PushedFilters", "PartitionFilters", "ReadSchema", "DataFilters"))]
    if mode in ("ai", "forensic"):
        told["ai"] = {"methods": [m.name for m in tree.methods if m.name in AI], "vectors_returned": any(k.startswith("array<float") or k.startswith("array<double") for _, k in df.dtypes)}
    plan = {"developer": "formatted", "coded": "cost", "forensic": "extended"}.get(mode)
    return json.dumps(told) + ("\n" + shown(plan) if plan else "")


def word(node) -> str:
    return node.name if isinstance(node, Path) else str(node.value)


class Planner:
    def __init__(self, catalog: Catalog):
        self.catalog, self.bound = catalog, {}

    # ---- roots

    def source(self, root: Call, methods: list[Call]) -> DataFrame:
        kind = root.name
        if kind in ("in", "out", "either"):
            return self.source(root.plain()[0], methods)
        name = word(root.plain()[0]) if root.plain() and isinstance(root.plain()[0], Path | Literal) else ""
        if kind == "table":
            return self.bound[name] if name in self.bound else self.catalog.table(name)
        if kind == "projection":
            return self.catalog.projection(name)
        if kind in ("object", "node"):
            return self.objects(name, methods)
        if kind in ("association", "edge"):
            return self.associations(name, methods)
        if kind == "evidence":
            return self.evidence(root)
        if kind == "path":
            return self.path(root, methods)
        raise QueryError("E_PARSE", f"{kind} is not a root")

    def objects(self, name: str, methods: list[Call]) -> DataFrame:
        if self.catalog.records is None:
            raise QueryError("E_UNKNOWN_OBJECT_TYPE", name)
        return self.timed(self.catalog.records.where(F.col("object_type") == name), methods, self.flat)

    def timed(self, records: DataFrame, methods: list[Call], flat) -> DataFrame:
        """States, history or changes of log records, as the temporal methods say; ``flat`` makes properties columns."""
        options = {m.name: m for m in methods}
        scopes = [m for m in ("asOf", "history", "changes") if m in options]
        if len(scopes) > 1:
            raise QueryError("E_METHOD_CONFLICT", " and ".join(scopes))
        branch = options.get("branch")
        records = temporal.on_branch(records, branch.plain()[0].value if branch and isinstance(branch.plain()[0], Literal) else word(branch.plain()[0]) if branch else None, self.catalog.branches)
        if self.catalog.hidden is not None:
            records = records.join(self.catalog.hidden.select("goid").distinct(), "goid", "left_anti")
        dead = bool(options["includeTombstones"].plain()[0].value) if "includeTombstones" in options else False
        if "history" in options:
            return flat(self.past(records, options["history"]))
        if "changes" in options:
            return self.changed(records, options["changes"], flat)
        if "asOf" in options:
            (arg,) = options["asOf"].args
            if arg.label == "csn":
                records = temporal.as_of(records, csn=arg.value.value)
            elif arg.label in (None, "time", "commit_time"):
                records = temporal.as_of(records, time_us=self.micros(arg.value.value))
            elif arg.label in self.catalog.bounds:
                return flat(temporal.as_of_role(records, self.catalog.bounds[arg.label], arg.value.value))
            else:
                raise QueryError("E_UNKNOWN_BINDING", arg.label)
        return flat(temporal.states(records, dead))

    def past(self, records: DataFrame, method: Call) -> DataFrame:
        mode = word(method.named().get("mode", Path(("states",))))
        if mode == "records":
            return records
        states = temporal.history(records).drop("turn")
        if mode == "states":
            return states
        if mode != "records_and_states":
            raise QueryError("E_METHOD_CONFLICT", f"no history mode {mode}")
        tag = lambda df, grain: df.select(*temporal.KEY, "record_id", "ts_us", "csn", "record_kind", "props", F.lit(grain).alias("output_grain"))
        return tag(records, "record").unionByName(tag(states, "state"))

    def changed(self, records: DataFrame, method: Call, flat) -> DataFrame:
        named = method.named()
        plain = method.plain()
        start, end = (named.get("from"), named.get("to")) if "from" in named else plain[:2] if len(plain) >= 2 else (None, None)
        if start is None or end is None:
            raise QueryError("E_METHOD_CONFLICT", "changes needs from and to")
        by = "ts_us" if isinstance(start.value, str) else "csn"
        bounds = [self.micros(x.value) if by == "ts_us" else x.value for x in (start, end)]
        out = temporal.changes(records, *bounds, word(named.get("mode", Path(("state_transitions",)))), by)
        return flat(out) if "props" in out.columns else out

    def micros(self, text: str) -> int:
        from datetime import UTC, datetime

        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
        return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1_000_000)

    def flat(self, df: DataFrame) -> DataFrame:
        """Properties that the catalogue declares become columns."""
        for name, kind in self.catalog.bounds.get("properties", {}).items() if isinstance(self.catalog.bounds.get("properties"), dict) else []:
            df = df.withColumn(name, F.element_at("props", F.lit(name)).cast(kind))
        return df

    def associations(self, name: str, methods: list[Call]) -> DataFrame:
        """Associations as they stand, or, with a log of them, as the temporal methods say."""
        valid = [m for m in methods if m.name == "asOf" and m.args[0].label == "association_valid_time"]
        scopes = [m for m in methods if m.name in TEMPORAL and m not in valid]
        if self.catalog.edge_records is not None:
            out = self.timed(self.catalog.edge_records.where(F.col("object_type") == name), scopes, lambda df: df)
            out = self.ends(out, name)
        elif scopes:
            raise QueryError("E_METHOD_CONFLICT", f"{scopes[0].name} needs a log of associations")
        elif self.catalog.edges is None:
            raise QueryError("E_UNKNOWN_ASSOCIATION_TYPE", name)
        else:
            out = self.catalog.edges.where(F.col("assoc_type") == name)
        for m in valid:
            from ..operators.mapping import valid_at

            out = valid_at(out, F.lit(m.args[0].value.value.replace("Z", "")).cast(dict(out.dtypes)["valid_from"]))
        if self.catalog.hidden is not None:
            gone = self.catalog.hidden.select("goid").distinct()
            out = out.join(gone.withColumnRenamed("goid", "source_goid"), "source_goid", "left_anti").join(gone.withColumnRenamed("goid", "target_goid"), "target_goid", "left_anti")
        return out

    def ends(self, rows: DataFrame, name: str) -> DataFrame:
        """Log rows as associations. An association's ends identify it, so they are those of any of its records, and rows
        of one that never had any are left out; the other properties are the row's own."""
        told = self.catalog.edge_records.where(F.col("object_type") == name).groupBy("goid").agg(*[F.max(F.element_at("props", F.lit(c))).alias(c) for c in ("source_goid", "target_goid")])
        out = rows.join(told.where("source_goid is not null and target_goid is not null"), "goid")
        if "props" in rows.columns:
            out = out.withColumns({c: F.element_at("props", F.lit(c)) for c in ("valid_from", "valid_to")})
            out = self.flat(out)
        return out.withColumnRenamed("goid", "assoc_goid").withColumn("assoc_type", F.lit(name))

    def evidence(self, root: Call) -> DataFrame:
        if self.catalog.evidence is None:
            raise QueryError("E_UNKNOWN_BINDING", "evidence")
        grain = root.named().get("grain")
        return self.catalog.evidence if grain is None else self.catalog.evidence.where(F.col("grain") == word(grain))

    def edges_of(self, rel: Call) -> tuple[DataFrame, str]:
        """(edge, src, dst) and the direction of a relationship such as out(edge(E)).to(node(B))."""
        target = None
        if rel.name == "to":
            rel, target = rel.plain()[0], rel.plain()[1]
        inner = rel.plain()[0]
        edges = self.associations(word(inner.plain()[0]), [])
        out = edges.select(F.col("assoc_goid").alias("edge"), F.col("source_goid").alias("src"), F.col("target_goid").alias("dst"), *([F.col("weight")] if "weight" in edges.columns else []))
        if target is not None and self.catalog.records is not None:
            nodes = self.objects(word(target.plain()[0]), []).select(F.col("goid").alias("dst" if rel.name != "in" else "src"))
            out = out.join(nodes, nodes.columns[0], "left_semi")
        return out, rel.name

    def path(self, root: Call, methods: list[Call]) -> DataFrame:
        """path(node(A) as a.out(edge(E) as e).to(node(B) as b)...): one row for each chain of hops."""
        steps, node = [], root.plain()[0]
        while isinstance(node, Call) and node.name in ("to", "in", "out", "either"):
            steps.append(node)
            node = node.plain()[0]
        steps.reverse()
        start = node.alias or "start"
        rows, at = self.objects(word(node.plain()[0]), methods).select(F.col("goid").alias(start)), start
        for i, step in enumerate(steps):
            if step.name == "to":
                target = step.plain()[1]
                rows = rows.withColumnRenamed(at, target.alias or f"node{i}")
                at = target.alias or f"node{i}"
                keep = self.objects(word(target.plain()[0]), []).select(F.col("goid").alias(at))
                rows = rows.join(keep, at, "left_semi")
                continue
            edge = step.plain()[1]
            pairs = graph.oriented(self.edges_of(Call(step.name, (Arg(edge),)))[0], step.name)
            there, name = f"_to{i}", edge.alias or f"edge{i}"
            rows = rows.join(pairs.select(F.col("src").alias(at), F.col("edge").alias(name), F.col("dst").alias(there)), at)
            at = there
        return rows.drop(*[c for c in rows.columns if c.startswith("_to")])

    # ---- the chain

    def run(self, tree: Query, row_budget: bool = False) -> DataFrame:
        methods = list(tree.methods)
        for m in methods:
            if m.name not in (*RELATIONAL, *TEMPORAL, *GRAPH, *AI):
                raise QueryError("E_UNSUPPORTED_PROFILE_METHOD", m.name)
        self.check_order(methods)
        self.root = tree.root
        for m in methods:
            if m.name == "with":
                for arg in m.args:
                    self.bound[arg.label] = self.source(arg.value, [])
            elif m.name == "withRecursive":
                named = m.named()
                self.bound[word(named["name"])] = relational.recursive_append(self.source(named["seed"], []), self.source(named["step"], []), word(named["key"]), self.bounded(named))
        df = self.source(tree.root, methods)
        name = word(tree.root.plain()[0]) if tree.root.plain() and isinstance(tree.root.plain()[0], Path) else None
        graphs, searches = ([m for m in methods if m.name in kind] for kind in (GRAPH, AI))
        if len(graphs) + len(searches) > 1:
            raise QueryError("E_METHOD_CONFLICT", " and ".join(m.name for m in graphs + searches))
        if graphs:
            df = self.graph(df, graphs[0])
        if searches:
            df = self.search(df, searches[0])
        scope = Scope.of(df, tree.root.alias, name)
        for kinds in (("lookup",), ("join", "semiJoin", "antiJoin")):
            for m in methods:
                if m.name in kinds:
                    scope = self.join(scope, m)
        for m in methods:
            if m.name in ("union", "intersect", "except"):
                every = m.named().get("all")
                out = relational.set_operation(scope.df, self.source(m.plain()[0], []), m.name, every is None or every.value)
                scope = Scope(out, scope.bare, scope.qualified)
        for m in methods:
            if m.name == "window":
                scope = window_of(m, scope)
        for m in methods:
            if m.name == "where":
                scope = self.where(scope, m.plain()[0])
        scope, methods = self.counted(scope, methods)
        return self.finish(scope, methods, row_budget)

    def check_order(self, methods: list[Call]) -> None:
        names = [m.name for m in methods]
        if "groupBy" in names and "where" in names[names.index("groupBy") :]:
            raise QueryError("E_UNSUPPORTED_AGGREGATE_FILTER", "where after groupBy")
        late = [i for i, n in enumerate(names) if n in TEMPORAL]
        early = [i for i, n in enumerate(names) if n in ("lookup", "traverse")]
        if late and early and min(early) < max(late):
            raise QueryError("E_METHOD_CONFLICT", "temporal scopes come before lookup and traverse")

    def bounded(self, named) -> int:
        if "maxIterations" not in named or "key" not in named:
            raise QueryError("E_METHOD_CONFLICT", "withRecursive needs key and maxIterations")
        return int(named["maxIterations"].value)

    def join(self, scope: Scope, m: Call) -> Scope:
        root, named = m.plain()[0], m.named()
        if "on" not in named:
            raise QueryError("E_PARSE", f"{m.name} needs on")
        right = self.source(root, [])
        name = word(root.plain()[0])
        own, other = PROFILES.get(self.root.name, "table"), PROFILES.get(root.name, "table")
        if own != other and (word(self.root.plain()[0]), name) not in self.catalog.bridges:
            raise QueryError("E_UNKNOWN_BRIDGE", f"{own} and {other} meet without a bridge")
        alias = root.alias or name
        added = {c: f"{alias}.{c}" for c in right.columns}
        taken = set(scope.df.columns)
        added = {c: p if p not in taken else f"{p}#{len(taken)}" for c, p in added.items()}
        renamed = right.select(*[F.col(f"`{c}`").alias(p) for c, p in added.items()])
        both = Scope(scope.df.limit(0).crossJoin(renamed.limit(0)), *self.names(scope, alias, name, added))
        condition = named["on"]
        if named.get("nulls_match") is not None and named["nulls_match"].value:
            if not (isinstance(condition, Compare) and condition.op == "==" and isinstance(condition.left, Path) and isinstance(condition.right, Path)):
                raise QueryError("E_METHOD_CONFLICT", "nulls_match needs a single path == path")
            on = value(condition.left, both)[0].eqNullSafe(value(condition.right, both)[0])
        else:
            on = predicate(condition, both)
        kind = {"join": word(named.get("kind", Path(("inner",)))), "semiJoin": "semi", "antiJoin": "anti", "lookup": "left"}[m.name]
        unmatched = word(named.get("unmatched", Path(("nulls",))))
        if m.name == "lookup" and "required" in named and named["required"].value:
            unmatched = "reject"
        cardinality = word(named.get("cardinality", Path(("one" if m.name == "lookup" else "many",))))
        duplicate = "first" if word(named.get("duplicate", Path(("reject",)))) in ("many", "emit_all") else "reject"
        out = relational.guarded_join(scope.df, renamed, on, kind, cardinality, unmatched, duplicate, label="LOOKUP" if m.name == "lookup" else "JOIN")
        if kind in ("semi", "anti"):
            return Scope(out, scope.bare, scope.qualified)
        return Scope(out, *self.names(scope, alias, name, added))

    @staticmethod
    def names(scope: Scope, alias: str, name: str, added: dict[str, str]):
        bare, qualified = dict(scope.bare), dict(scope.qualified)
        for c, p in added.items():
            bare.setdefault(c, p)
        qualified[alias] = added
        qualified.setdefault(name, added)
        return bare, qualified

    def where(self, scope: Scope, node) -> Scope:
        """exists(table(...), on:) and exists(association) become semi and anti joins; the rest is one filter."""
        parts = node.parts if isinstance(node, Both) else (node,)
        plain = []
        for part in parts:
            negated = isinstance(part, Not)
            inner = part.part if negated else part
            if isinstance(inner, Call) and inner.name == "exists" and inner.plain() and isinstance(inner.plain()[0], Call) and inner.plain()[0].name in ("table", "association", "edge", "out", "in", "either", "evidence"):
                scope = self.exists(scope, inner, negated)
            else:
                plain.append(part)
        if not plain:
            return scope
        if any(isinstance(x, Call) and x.name in AGGREGATES and x.name != "exists" for p in plain for x in walk(p)) and scope.window is None:
            raise QueryError("E_UNSUPPORTED_AGGREGATE_FILTER", "an aggregate in where")
        whole = plain[0] if len(plain) == 1 else Both(tuple(plain))
        uses_window = any(isinstance(x, Call) and x.name in (*WINDOW_ONLY, *AGGREGATES) for x in walk(whole)) and scope.window is not None
        if not uses_window:
            return replace_frame(scope, scope.df.where(predicate(whole, scope)))
        marked = scope.df.withColumn("_keep", predicate(whole, scope))
        # other window columns see all rows too, so they are computed before rows go
        return replace_frame(scope, marked, "_keep")

    def exists(self, scope: Scope, node: Call, negated: bool) -> Scope:
        root, how = node.plain()[0], "left_anti" if negated else "left_semi"
        if root.name == "table":
            m = Call("antiJoin" if negated else "semiJoin", (Arg(root), Arg(node.named()["on"], "on")))
            return replace_frame(scope, self.join(scope, m).df)
        if root.name == "evidence":
            return replace_frame(scope, scope.df.join(self.evidence(root).select("goid").distinct(), "goid", how))
        side = root.name if root.name in ("in", "out", "either") else "either"
        edges = self.associations(word((root.plain()[0] if isinstance(root.plain()[0], Path) else root.plain()[0].plain()[0])), [])
        ends = {"out": ["source_goid"], "in": ["target_goid"], "either": ["source_goid", "target_goid"]}[side]
        ids = edges.select(F.col(ends[0]).alias("goid"))
        for e in ends[1:]:
            ids = ids.union(edges.select(F.col(e).alias("goid")))
        return replace_frame(scope, scope.df.join(ids.distinct(), "goid", how))

    # ---- select, groups, order

    def counted(self, scope: Scope, methods: list[Call]) -> tuple[Scope, list[Call]]:
        """count, exists and distinct_count of a row's associations or evidence: a column joined by goid, which groups
        add up."""
        select = next((m for m in methods if m.name == "select"), None)
        if select is None:
            return scope, methods
        grouped, args = any(m.name == "groupBy" for m in methods), []
        for i, a in enumerate(select.args):
            node = a.value
            inner = node.plain()[0] if isinstance(node, Call) and node.name in ("count", "exists", "distinct_count") and node.plain() else None
            if not (isinstance(inner, Call) and inner.name in ("in", "out", "either", "association", "evidence")):
                args.append(a)
                continue
            if inner.name == "evidence":
                rows = self.evidence(inner).select("goid", F.col("digest").alias("_other"))
            else:
                first = inner.plain()[0]
                edges = self.associations(word(first if isinstance(first, Path) else first.plain()[0]), [])
                out = edges.select(F.col("source_goid").alias("goid"), F.col("target_goid").alias("_other"))
                into = edges.select(F.col("target_goid").alias("goid"), F.col("source_goid").alias("_other"))
                rows = {"in": into, "out": out}.get(inner.name, out.unionByName(into))
            number = F.count_distinct("_other") if node.name == "distinct_count" else F.count(F.lit(1))
            name = f"_associated{i}"
            df = scope.df.join(rows.groupBy("goid").agg(number.alias(name)), "goid", "left")
            df = df.withColumn(name, F.coalesce(name, F.lit(0)))
            scope = replace_frame(scope, df)
            scope.bare = {**scope.bare, name: name}
            column = Path((name,))
            total = Call("sum", (Arg(column),)) if grouped else column
            args.append(Arg(Compare(">", total, Literal(0)) if node.name == "exists" else total, a.label or node.name))
        return scope, [Call("select", tuple(args)) if m is select else m for m in methods]

    def item_name(self, arg: Arg) -> str:
        if arg.label:
            return arg.label
        node = arg.value
        if isinstance(node, Path):
            return node.parts[-1] if len(node.parts) > 1 else node.name
        if isinstance(node, Call):
            return node.name
        return "literal" if isinstance(node, Literal) else "if"

    def finish(self, scope: Scope, methods: list[Call], row_budget: bool) -> DataFrame:
        select = next((m for m in methods if m.name == "select"), None)
        group = next((m for m in methods if m.name == "groupBy"), None)
        items = [(self.item_name(a), a.value) for a in select.args] if select else None
        aggregated = group is not None or items is not None and scope.window is None and any(isinstance(x, Call) and x.name in AGGREGATES and not self.is_scalar_exists(x) for _, n in items for x in walk(n))
        orders = [m for m in methods if m.name == "orderBy"]
        if aggregated:
            df, out_scope = self.grouped(scope, group, items or [], self.threshold(methods))
            keys = [self.order_key(m, out_scope) for m in orders]
            names = None
        else:
            base = scope.df
            if items is None:
                items = [(c, Path((c,))) for c in scope.bare]
            columns, seen = [], set()
            for name, node in items:
                if name in seen:
                    raise QueryError("E_AMBIGUOUS_PATH", name)
                seen.add(name)
                columns.append(value(node, scope)[0].alias(name))
            order_columns = [value(m.plain()[0], scope)[0].alias(f"_order{i}") for i, m in enumerate(orders)]
            keep = [F.col("_keep")] if "_keep" in base.columns else []
            df = base.select(*columns, *order_columns, *keep)
            if keep:
                df = df.where("_keep").drop("_keep")
            keys = [relational.sort_key(F.col(f"_order{i}"), *self.directions(m)) for i, m in enumerate(orders)]
            names = [n for n, _ in items]
        take = next((m.plain()[0].value for m in methods if m.name == "take"), None)
        skip = next((m.plain()[0].value for m in methods if m.name == "skip"), 0)
        if keys or take is not None or skip:
            ties = [F.col(f"`{c}`").asc_nulls_last() for c, k in df.dtypes if not c.startswith("_order") and not k.startswith("map")]
            df = relational.top_rows(df, [*keys, *ties], take, skip)
        if row_budget and take is None and df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
            raise QueryError("E_RESOURCE_LIMIT", f"more than {MOST_ROWS} rows without take")
        return df if names is None else df.select(*[F.col(f"`{n}`") for n in names])

    @staticmethod
    def is_scalar_exists(node: Call) -> bool:
        return node.name == "exists" and bool(node.plain()) and isinstance(node.plain()[0], Path)

    @staticmethod
    def directions(m: Call) -> tuple[str, str | None]:
        words = [word(x) for x in m.plain()[1:]]
        direction = next((w for w in words if w in ("asc", "desc")), "asc")
        return direction, next((w for w in words if w.startswith("nulls_")), None)

    def order_key(self, m: Call, scope: Scope):
        node = m.plain()[0]
        if isinstance(node, Path) and node.parts[-1] in scope.bare:
            node = Path((node.parts[-1],))
        return relational.sort_key(value(node, scope)[0], *self.directions(m))

    @staticmethod
    def threshold(methods: list[Call]) -> int | None:
        for m in methods:
            if m.name == "policy":
                for x in m.plain():
                    if isinstance(x, Call) and x.name == "allow_thresholded":
                        return int(x.plain()[0].value)
                    raise QueryError("E_AGGREGATE_DISCLOSURE_FORBIDDEN", word(x))
        return None

    def grouped(self, scope: Scope, group: Call | None, items: list, least: int | None) -> tuple[DataFrame, Scope]:
        keys = list(group.plain()) if group else []
        inner = Scope(scope.df, scope.bare, scope.qualified, grouped=True)
        key_names = {render(k): f"_key{i}" for i, k in enumerate(keys)}
        by_key = scope.df.groupBy(*[value(k, scope)[0].alias(key_names[render(k)]) for k in keys])
        aggregates, out = [], []
        for name, node in items:
            if render(node) in key_names:
                out.append((name, key_names[render(node)]))
                continue
            if not any(isinstance(x, Call) and x.name in AGGREGATES for x in walk(node)):
                if isinstance(node, Literal):
                    aggregates.append(value(node, scope)[0].alias(name))
                    out.append((name, name))
                    continue
                raise QueryError("E_GROUPING", f"{render(node)} is neither grouped nor aggregated")
            x = value(node, inner)[0]
            if least is not None:
                shown, small = relational.thresholded(x, least)
                aggregates += [shown.alias(name), small.alias(f"{name}_suppressed")]
                out += [(name, name), (f"{name}_suppressed", f"{name}_suppressed")]
            else:
                aggregates.append(x.alias(name))
                out.append((name, name))
        df = by_key.agg(*(aggregates or [F.count(F.lit(1)).alias("_n")]))
        df = df.select(*[F.col(f"`{p}`").alias(n) for n, p in out])
        return df, Scope.of(df)

    # ---- graphs and vectors

    def graph(self, nodes: DataFrame, m: Call) -> DataFrame:
        ids = nodes.select(F.col("goid").alias("id"))
        rel = next((x for x in m.plain() if isinstance(x, Call)), None)
        named = m.named()
        number = lambda k, d: named[k].value if k in named else d
        kind = word(named["kind"]) if "kind" in named else None
        if m.name in ("in", "out", "either"):
            rel = m
        if rel is not None:
            edges, direction = self.edges_of(rel)
        elif self.catalog.edges is not None:
            edges, direction = self.catalog.edges.select(F.col("assoc_goid").alias("edge"), F.col("source_goid").alias("src"), F.col("target_goid").alias("dst"), *([F.col("weight")] if "weight" in self.catalog.edges.columns else [])), "out"
        else:
            raise QueryError("E_UNKNOWN_ASSOCIATION_TYPE", m.name)
        if direction not in ("in", "out", "either"):
            direction = "out"
        if m.name in ("in", "out", "either"):
            return graph.traverse(ids, edges, 1, 1, direction=direction)
        if m.name == "traverse":
            return graph.traverse(ids, edges, number("min", 1), number("max", 1), word(named.get("mode", Path(("walk",)))), word(named.get("distinct", Path(("none",)))), direction)
        deepest = number("maxDepth", graph.DEEPEST)
        if m.name == "reachable":
            return graph.reachable(ids, edges, deepest, direction)
        if m.name == "shortestPath":
            return graph.shortest(ids, edges, None, deepest, direction)
        if m.name in ("allPaths", "kShortestPaths"):
            return graph.all_paths(ids, edges, deepest, named["k"].value if "k" in named else None, direction)
        steps = {"iterations": number("maxIterations", graph.ITERATIONS)}
        if m.name == "connectedComponents":
            return graph.strong_components(ids, edges) if kind == "strong" else graph.weak_components(ids, edges)
        if m.name == "centrality":
            return {"degree": graph.degree_centrality, "betweenness": graph.betweenness}.get(kind, graph.closeness)(ids, edges)
        if m.name == "spanningTree":
            return graph.spanning_tree(ids, edges, kind or "bfs", word(named["weight"]) if "weight" in named else None)
        if m.name in ("pageRank", "hits"):
            tolerance = float(number("tolerance", graph.TOLERANCE))
            return (graph.page_rank if m.name == "pageRank" else graph.hits)(ids, edges, tolerance=tolerance, **steps)
        if m.name == "community":
            return graph.communities(ids, edges, **steps)
        return {"degree": graph.degree, "triangleCount": graph.triangles, "clusteringCoefficient": graph.clustering}[m.name](ids, edges)

    def search(self, df: DataFrame, m: Call) -> DataFrame:
        named = m.named()
        if m.name == "embedding":
            return df.where(F.col("vec_id") == named["vectorRef"].value)
        if ("vectorRef" in named) == ("fileCode" in named):
            raise QueryError("E_AI_ARGUMENT_REQUIRED", "one of vectorRef and fileCode")
        reference = (named.get("vectorRef") or named.get("fileCode")).value
        k = named["k"].value if "k" in named else 10
        metric, index = word(named.get("metric", Path(("cosine",)))), word(named.get("index", Path(("auto",))))
        out = vectors.indexed(df, vectors.vector_of(df, reference), k, metric, index)
        return out.withColumn("result_authority", F.lit("advisory")) if m.name in ("hybrid", "rerank") else out


def replace_frame(scope: Scope, df: DataFrame, keep: str | None = None) -> Scope:
    out = Scope(df, scope.bare, scope.qualified, scope.window, scope.frame, scope.grouped)
    if scope.window is not None:
        out.keyed = scope.keyed
    return out
