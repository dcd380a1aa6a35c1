"""The query language: text and builder, resolution, guards, and its rules of order."""

from decimal import Decimal

import pytest
from loomspark.errors import QueryError
from loomspark.lang import Q, agg, col, fn, lit, parse
from loomspark.lang.builder import Word
from loomspark.lang.tree import render
from loomspark.plans.chain import explain, fingerprint, query
from loomspark.sources.catalog import Catalog


@pytest.fixture(scope="module")
def catalog(spark):
    out = Catalog(spark)
    people = [(1, "Ann", 10, None), (2, "Bob", None, "x"), (3, "Cid", 30, "y"), (4, "Dee", 30, None)]
    out.add("people", spark.createDataFrame(people, "id long, name string, score int, tag string"), ("id",))
    out.add("teams", spark.createDataFrame([(1, "red"), (3, "blue"), (3, "green"), (None, "none")], "id long, team string"))
    out.add("more", spark.createDataFrame([(4, "Dee", 30, None), (5, "Eve", 5, "z")], "id long, name string, score int, tag string"))
    return out


def rows(catalog, text):
    return [tuple(r) for r in query(catalog, text).collect()]


def code(catalog, text):
    with pytest.raises(Exception) as caught:
        query(catalog, text).collect()
    return str(caught.value)


def test_text_and_builder_agree():
    text = '''table(people) as p.join(table(teams) as t, on: p.id == t.id, kind: left).where(p.score > 5 && !(p.name == "Bob")).select(p.name, n: t.team).orderBy(name, desc).take(3)'''
    built = (
        Q("table", "people", "p").join(Q("table", "teams", "t"), on=col("p.id") == col("t.id"), kind=Word("left"))
        .where((col("p.score") > 5) & ~(col("p.name") == "Bob")).select(col("p.name"), n=col("t.team")).orderBy(col("name"), Word("desc")).take(3)
    )
    assert parse(text) == built.tree() and fingerprint(text) == fingerprint(built.tree())
    assert parse(render(parse(text))) == parse(text)


def test_builder_runs(catalog):
    tree = Q("table", "people").groupBy(col("score")).select(col("score"), n=agg("count"), low=agg("min", col("name"))).orderBy(col("n"), Word("desc")).tree()
    assert [tuple(r) for r in query(catalog, tree).collect()] == [(30, 2, "Cid"), (10, 1, "Ann"), (None, 1, "Bob")]
    assert [r[0] for r in query(catalog, Q("table", "people").where(fn("startsWith", col("name"), lit("A"))).select(col("id")).tree()).collect()] == [1]


def test_directives_literals_and_explain():
    tree = parse('# version: 0.1\nEXPLAIN developer table(t).where(a == uuid"00112233-4455-6677-8899-AABBCCDDEEFF" || b == x"0aff" || c == 1.50 || d in [-1, null, true])')
    assert tree.explain == "developer" and tree.directives
    kinds = [p.right for p in tree.methods[0].args[0].value.parts[:3]]
    assert kinds[0].value == "00112233445566778899aabbccddeeff" and kinds[1].value == b"\x0a\xff" and kinds[2].value == Decimal("1.50")
    assert parse("table(t).explain(proof)").explain == "proof"


@pytest.mark.parametrize("text", ["table(t", "table(t).where(", "table(t).where(a =)", "nope(t)", "table(t) table(u)", 'table(t).where(a in [b])', "table(t).where(a == 'x')"])
def test_bad_text(text):
    with pytest.raises(QueryError) as caught:
        parse(text)
    assert caught.value.code == "E_PARSE"


def test_duplicate_method():
    with pytest.raises(QueryError, match="E_DUPLICATE_METHOD"):
        parse("table(t).select(a).select(b)")


def test_three_valued_logic(catalog):
    assert rows(catalog, "table(people).where(score != 10).select(id)") == [(3,), (4,)]
    assert rows(catalog, "table(people).where(!(score == 10)).select(id)") == [(3,), (4,)]
    assert rows(catalog, "table(people).where(score in [10, null]).select(id)") == [(1,)]
    assert rows(catalog, "table(people).where(!(score in [10, null])).select(id)") == []
    assert rows(catalog, "table(people).where(score.isNull() || tag.isNotNull()).select(id)") == [(2,), (3,)]
    assert rows(catalog, 'table(people).where(score == "10").select(id)') == []


def test_order_skip_take_and_nulls(catalog):
    assert rows(catalog, "table(people).select(id).orderBy(score)") == [(1,), (3,), (4,), (2,)]
    assert rows(catalog, "table(people).select(id).orderBy(score, desc)") == [(2,), (3,), (4,), (1,)]
    assert rows(catalog, "table(people).select(id).orderBy(score, desc, nulls_last).skip(1).take(2)") == [(4,), (1,)]


def test_aggregates(catalog):
    assert rows(catalog, "table(people).where(id > 99).select(n: count(*), s: sum(score), e: exists(*))") == [(0, None, False)]
    assert rows(catalog, "table(people).select(n: count(score), d: distinct_count(score), a: avg(score))")[0][:2] == (3, 2)
    assert rows(catalog, "table(people).groupBy(score).policy(allow_thresholded(2)).select(score, n: count(*)).orderBy(score)") == [(10, None, True), (30, 2, False), (None, None, True)]
    assert "E_GROUPING" in code(catalog, "table(people).groupBy(score).select(name)")
    assert "E_UNSUPPORTED_AGGREGATE_FILTER" in code(catalog, "table(people).groupBy(score).where(score > 1).select(score)")
    assert "E_UNSUPPORTED_AGGREGATE_FILTER" in code(catalog, "table(people).where(count(*) > 1)")
    assert "E_AGGREGATE_DISCLOSURE_FORBIDDEN" in code(catalog, "table(people).groupBy(score).policy(reject).select(n: count(*))")


def test_order_after_aggregation_diverges_on_purpose(catalog):
    """Groups are sorted and cut after they are aggregated, as in SQL."""
    assert rows(catalog, "table(people).groupBy(score).select(score, n: count(*)).orderBy(n, desc).take(1)") == [(30, 2)]


def test_joins_and_guards(catalog):
    join = "table(people) as p.join(table(teams) as t, on: p.id == t.id{}).select(p.id, t.team)"
    assert sorted(rows(catalog, join.format(""))) == [(1, "red"), (3, "blue"), (3, "green")]
    assert len(rows(catalog, join.format(", kind: full"))) == 6
    assert "E_JOIN_DUPLICATE_MATCH" in code(catalog, join.format(", cardinality: one"))
    assert sorted(rows(catalog, join.format(", cardinality: one, duplicate: emit_all"))) == [(1, "red"), (3, "blue")]
    assert "E_JOIN_UNMATCHED_ROW" in code(catalog, join.format(", unmatched: reject"))
    assert "E_LOOKUP_UNMATCHED_ROW" in code(catalog, "table(people) as p.lookup(table(teams) as t, on: p.id == t.id, cardinality: many, required: true).select(p.id)")
    assert "E_LOOKUP_DUPLICATE_MATCH" in code(catalog, "table(people) as p.lookup(table(teams) as t, on: p.id == t.id).select(p.id)")
    assert "E_JOIN_UNMATCHED_ROW" in code(catalog, "table(people) as p.semiJoin(table(teams) as t, on: p.id == t.id, unmatched: reject).select(p.id)".replace("semiJoin(", "join(").replace(", unmatched", ", kind: semi, unmatched"))
    assert rows(catalog, "table(people) as p.antiJoin(table(teams) as t, on: p.id == t.id).select(id)") == [(2,), (4,)]


def test_guard_fires_under_count(catalog):
    with pytest.raises(Exception, match="E_JOIN_DUPLICATE_MATCH"):
        query(catalog, "table(people) as p.join(table(teams) as t, on: p.id == t.id, cardinality: one).select(p.id)").count()


def test_null_safe_join(catalog):
    assert (None,) in [(r[0],) for r in rows(catalog, "table(teams) as a.join(table(teams) as b, on: a.id == b.id, nulls_match: true).select(x: a.id)")]
    assert "E_METHOD_CONFLICT" in code(catalog, "table(teams) as a.join(table(teams) as b, on: a.id > b.id, nulls_match: true)")


def test_unqualified_names_are_the_left_ones(catalog):
    assert sorted(rows(catalog, "table(people) as p.join(table(teams) as t, on: p.id == t.id).select(id, team, other: teams.id)")) == [(1, "red", 1), (3, "blue", 3), (3, "green", 3)]


def test_sets(catalog):
    assert len(rows(catalog, "table(people).union(table(more))")) == 6
    assert len(rows(catalog, "table(people).union(table(more), all: false)")) == 5
    assert [r[0] for r in rows(catalog, "table(people).intersect(table(more))")] == [4]
    assert sorted(r[0] for r in rows(catalog, "table(people).except(table(more))")) == [1, 2, 3]


def test_windows(catalog):
    text = "table(people).window(partitionBy: score, orderBy: id{}).select(id, {}).orderBy(id)"
    assert rows(catalog, text.format("", "r: row_number(), p: lag(id), s: sum(id)")) == [(1, 1, None, 1), (2, 1, None, 2), (3, 1, None, 3), (4, 2, 3, 7)]
    assert rows(catalog, text.format(", frame: range, start: current_row, end: unbounded_following", "s: sum(id)"))[2:] == [(3, 7), (4, 4)]
    assert rows(catalog, "table(people).window(orderBy: score).select(id, k: rank(), d: dense_rank()).orderBy(id)") == [(1, 1, 1), (2, 4, 3), (3, 2, 2), (4, 2, 2)]
    assert rows(catalog, "table(people).window(partitionBy: score, orderBy: id).where(row_number() == 2).select(id, r: row_number())") == [(4, 2)]
    assert "E_WINDOW" in code(catalog, "table(people).select(row_number())")
    assert "E_WINDOW" in code(catalog, "table(people).window(orderBy: id, start: current_row, end: soon).select(n: count(*))")


def test_unknown_things(catalog):
    assert "E_UNKNOWN_PATH" in code(catalog, "table(people).select(nope)")
    assert "E_UNKNOWN_TABLE_SURFACE" in code(catalog, "table(nope)")
    assert "E_UNSUPPORTED_PROFILE_METHOD" in code(catalog, "table(people).frobnicate(1)")
    assert "E_UNSUPPORTED_FUNCTION" in code(catalog, "table(people).select(x: frob(id))")
    assert "E_RESOURCE_LIMIT" in code(catalog, "table(people).select(" + "(" * 70 + "id" + ")" * 70 + ")")


def test_strict_casts(catalog):
    assert "CAST_INVALID_INPUT" in code(catalog, 'table(people).select(x: cast(name, "int64"))')
    assert "E_EXPRESSION" in code(catalog, 'table(people).select(x: cast(name, "bool"))')
    assert "E_EXPRESSION" in code(catalog, 'table(people).select(x: coalesce(name, score))')


def test_recursive_append(catalog):
    text = "table(r).withRecursive(name: r, seed: table(people), step: table(more), key: id, maxIterations: 3).select(id)"
    assert sorted(rows(catalog, text)) == [(1,), (2,), (3,), (4,), (5,)]
    assert "E_METHOD_CONFLICT" in code(catalog, text.replace(", maxIterations: 3", ""))


def test_bridges(spark):
    from loomspark.operators.temporal import KEY

    out = Catalog(spark)
    out.records = spark.createDataFrame([("t", 0, "a", "1", 1, 1, "baseline", {"x": "1"})], ", ".join(f"{k} {'long' if k == 'branch_key' else 'string'}" for k in KEY) + ", record_id string, ts_us long, csn long, record_kind string, props map<string,string>")
    out.bounds = {"properties": {"x": "int"}}
    out.add("facts", spark.createDataFrame([("a", 7)], "k string, v int"))
    text = "object(t) as o.join(table(facts) as f, on: o.goid == f.k).select(o.x, f.v)"
    assert "E_UNKNOWN_BRIDGE" in code(out, text)
    out.bridges.add(("t", "facts"))
    assert rows(out, text) == [(1, 7)]


def test_explain_and_discovery(catalog):
    assert "Physical Plan" in explain(catalog, "table(people).select(id)")
    assert {d["root"] for d in catalog.describe()} == {"table(people)", "table(teams)", "table(more)"}
    catalog.register_views()
    assert catalog.spark.sql("SELECT count(*) FROM people").first()[0] == 4
