"""Plans and results that must hold as tables grow."""

import contextlib
import hashlib
import io

import __spark_entry__ as entry
import numpy as np
from loomspark.operators import checkpoints, graph, packs
from pyspark.sql import functions as F


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_sketches_are_not_grouped_by_exact_keys(spark):
    """No row is doubled for exact counts beside sketches, which would put both sketches into every group."""
    found = entry.queries()["agg_approx_distinct_bound"](spark, "/root/testdata/sf0.001")
    assert "Expand" not in plan_of(found)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    want = (lines.select("l_partkey").distinct().count(), lines.select("l_orderkey").distinct().count(), True, True)
    assert [tuple(r) for r in found.collect()] == [want]


def test_triangles_of_a_graph_of_open_paths(spark):
    """Two sides that are not closed are never a row: a dense two-sided graph has only paths, and one chord closes some."""
    rows = [(f"{i}-{j}", i, 100 + j) if (i + j) % 3 else (f"{i}-{j}", 100 + j, i) for i in range(30) for j in range(40)]
    rows += [("back", 100, 1), ("chord", 3, 9), ("loop", 5, 5), ("again", 3, 9)]
    edges = spark.createDataFrame(rows, "edge string, src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(31), *range(100, 140)]], "id long")
    out = {}
    for _, a, b in rows:
        out.setdefault(a, set()).add(b)
    want = {r["id"]: sum(1 for x in out.get(r["id"], set()) - {r["id"]} for y in out[r["id"]] - {r["id"]} if x != y and y in out.get(x, ())) // 2 for r in nodes.collect()}
    found = graph.triangles(nodes, edges)
    assert "MapInArrow" in plan_of(found)
    assert {r["id"]: r["triangles"] for r in found.collect()} == want and sum(want.values()) > 0


def test_packed_lists_come_back():
    lists = [[], [0], [5, 6, 127, 128, 20_000], [], [1 << 38, (1 << 38) + 1], [3]]
    sizes = np.array([len(x) for x in lists])
    ends, data = packs.pack(sizes, np.array(sum(lists, []), np.int64))
    row, value = packs.unpack(np.diff(np.concatenate([[0], ends])), data)
    assert list(zip(row.tolist(), value.tolist(), strict=True)) == [(i, x) for i, one in enumerate(lists) for x in one]
    assert packs.pack(np.array([0]), np.zeros(0, np.int64))[1].size == 0


def test_both_directions_from_one_reading(spark):
    edges = spark.createDataFrame([("a", 1, 2)], "edge string, src long, dst long")
    both = graph.oriented(edges, "either")
    assert "Union" not in plan_of(both) and sorted(map(tuple, both.collect())) == [("a", 1, 2), ("a", 2, 1)]


def test_components_do_not_read_all_edges_in_every_round(spark, monkeypatch):
    """Rows in groups, and groups linked in a long chain of scattered names: later rounds only hold what is apart."""
    name = lambda x: hashlib.md5(x.encode()).hexdigest()
    rows = [(name(f"r{i}"), name(f"g{i % 100}")) for i in range(3000)] + [(name(f"r{i}"), name(f"r{i + 1}")) for i in range(80)] + [("alone", "alone"), ("y", "z"), ("z", "y")]
    edges = spark.createDataFrame([("e", a, b) for a, b in rows], "edge string, src string, dst string")
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: written.append(cut(df)) or written[-1])
    found = {r["node"]: r["label"] for r in graph.min_labels(edges).collect()}
    want = {x: x for row in rows for x in row}
    while any(want[a] != want[b] for a, b in rows):
        for a, b in rows:
            want[a] = want[b] = min(want[a], want[b])
    assert found == want
    assert sum(df.count() for df in written) < 20 * len(rows)  # 13 times; with every round whole it was 49 times


def test_trees_move_no_edges_in_their_rounds(spark, monkeypatch):
    """A large table of pairs is dealt by each end once, and joins by that end then move only their other side."""
    monkeypatch.setattr(checkpoints, "ROWS_KEYED", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sides = spark.range(300).select(F.concat(F.lit("n"), F.col("id")).alias("src"), F.concat(F.lit("n"), (F.col("id") * 7 + 3) % 300).alias("dst"))
        dealt = checkpoints.keyed(checkpoints.cut(sides), "src")
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, sides.collect()))
        joined = dealt.join(spark.range(9).select(F.concat(F.lit("n"), "id").alias("src")), "src")
        assert plan_of(joined).count("Exchange hashpartitioning") == 1
        tree = {r["id"]: (r["tree_parent"], r["tree_depth"]) for r in graph.spanning_tree(sides.select(F.col("src").alias("id")), sides.withColumn("edge", F.lit(0))).collect()}
        near = {}
        for a, b in map(tuple, sides.collect()):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        want = {}
        for root in sorted(near):
            line = [root] if root not in want else []
            want.update({x: (None, 0) for x in line})
            for x in line:
                for y in sorted(near[x] - set(want)):
                    want[y] = (x, want[x][1] + 1)
                    line.append(y)
        assert tree == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rounds_of_ranks_and_labels_read_dealt_numbers(spark, monkeypatch):
    """Edges with repeats and with ends that are no nodes; ranks read them dealt by src, labels as numbers without names."""
    dealt = []
    monkeypatch.setattr(checkpoints, "ROWS_KEYED", 1)
    monkeypatch.setattr(graph, "keyed", lambda df, end: dealt.append((end, dict(df.dtypes)["src"])) or checkpoints.keyed(df, end))
    names = [f"n{i}" for i in range(12)]
    rows = [(names[i], names[(i * 5 + 2) % 12]) for i in range(11)] * 2 + [("n1", "n7"), ("gone", "n3"), ("n4", "away")]
    nodes, edges = spark.createDataFrame([(x,) for x in names], "id string"), spark.createDataFrame([("e", a, b) for a, b in rows], "edge string, src string, dst string")
    own = {(a, b) for a, b in rows if a in names and b in names}
    ranks = {x: 1 / 12 for x in names}
    for _ in range(4):
        many = {x: sum(a == x for a, _ in own) for x in names}
        lost = sum(ranks[x] for x in names if not many[x])
        ranks = {x: (0.15 + 0.85 * lost) / 12 + 0.85 * sum(ranks[a] / many[a] for a, b in own if b == x) for x in names}
    found = {r["id"]: r["rank"] for r in graph.page_rank(nodes, edges, 4).collect()}
    assert all(abs(found[x] - ranks[x]) < 1e-12 for x in names) and dealt == [("src", "string")]
    labels = {x: i for i, x in enumerate(sorted(names))}
    for _ in range(3):
        votes = {x: [labels[b if a == x else a] for a, b in rows if x in (a, b) and a in names and b in names] for x in names}
        labels = {x: min(votes[x], key=lambda v: (-votes[x].count(v), v)) if votes[x] else labels[x] for x in names}
    assert {r["id"]: r["community"] for r in graph.communities(nodes, edges, 3).collect()} == labels
    assert dealt[1:] == [("src", "bigint"), ("dst", "bigint")]
