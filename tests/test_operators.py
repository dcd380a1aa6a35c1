"""Temporal folds, graphs, mapping, training data, sources and streams on small frames."""

import json

import pytest
from loomspark.errors import QueryError
from loomspark.functions.normalize import pipeline
from loomspark.operators import graph, mapping, temporal, training, vectors
from loomspark.sources import files
from pyspark.sql import functions as F

RECORD = "object_type string, branch_key long, goid string, record_id string, ts_us long, csn long, record_kind string, props map<string,string>"


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        ("t", 0, "a", "1", 10, 1, "baseline", {"x": "1", "y": "1"}), ("t", 0, "a", "2", 20, 2, "delta", {"y": None}), ("t", 0, "a", "5", 50, 5, "snapshot", {"x": "9"}),
        ("t", 0, "b", "3", 30, 3, "delta", {"x": "2"}), ("t", 0, "b", "4", 40, 4, "tombstone", {}), ("t", 0, "b", "6", 60, 6, "delta", {"z": "3"}),
        ("t", 0, "c", "7", 70, 7, "baseline", {}), ("t", 0, "d", "8", 80, 8, "tombstone", None),
    ]
    return spark.createDataFrame(rows, RECORD)


def props(df):
    return {r["goid"]: r["props"] for r in df.collect()}


def test_fold(log):
    assert props(temporal.states(log)) == {"a": {"x": "9"}, "b": {"z": "3"}, "c": {}}
    assert props(temporal.states(temporal.as_of(log, csn=4))) == {"a": {"x": "1", "y": None}}
    assert props(temporal.states(temporal.as_of(log, time_us=30))) == {"a": {"x": "1", "y": None}, "b": {"x": "2"}}
    assert set(props(temporal.states(log, tombstones=True))) == {"a", "b", "c", "d"}
    assert temporal.states(log.limit(0)).count() == 0


def test_history_is_as_of_at_every_record(log):
    told = temporal.history(log).collect()
    for r in told:
        state = props(temporal.states(temporal.as_of(log.where(F.col("goid") == r["goid"]), csn=r["csn"]))).get(r["goid"])
        assert (r["props"] if r["live"] else None) == state
    assert len(told) == log.count()


def test_changes(log):
    diffs = {(r["goid"], r["name"], r["change"]) for r in temporal.property_diffs(log, 2, 6).collect()}
    assert diffs == {("a", "y", "changed"), ("b", "x", "added"), ("b", "x", "removed"), ("a", "y", "removed"), ("a", "x", "changed")}
    assert {r["goid"] for r in temporal.final_rows(log, 3, 5).collect()} == {"b"}
    with pytest.raises(QueryError, match="E_METHOD_CONFLICT"):
        temporal.changes(log, 0, 1, "what")


def test_compaction_and_chains(log):
    assert props(temporal.states(temporal.compacted(log))) == props(temporal.states(log))
    chain = temporal.chain(log.where("csn <= 3"), log.where("csn > 3"))
    assert props(temporal.states(chain)) == props(temporal.states(log))
    with pytest.raises(QueryError, match="E_REF_INVALID"):
        temporal.validate_chain([{"digest": "a", "most_csn": 3}, {"digest": "b", "parent": "x", "least_csn": 4, "most_csn": 5}])
    assert temporal.read_advice(100, 80, 2) == "compact" and temporal.read_advice(100, 1, 20) == "checkpoint"


def test_branches(log, spark):
    two = log.unionByName(log.where("goid = 'a'").withColumn("branch_key", F.lit(1).cast("long")))
    assert temporal.on_branch(two, "dev", {"dev": 1}).count() == 3
    with pytest.raises(Exception, match="E_AMBIGUOUS_BRANCH"):
        temporal.on_branch(two, "reject_ambiguous", {}).collect()


def test_record_chain(spark):
    rows = [("t", 0, "a", "1", 1, 1, None), ("t", 0, "a", "2", 2, 2, "1"), ("t", 0, "a", "3", 3, 3, "9")]
    df = spark.createDataFrame(rows, "object_type string, branch_key long, goid string, record_id string, ts_us long, csn long, prev_ref string")
    assert [r["record_id"] for r in temporal.check_chain(df).collect()] == ["3"]


@pytest.fixture(scope="module")
def net(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    edges = spark.createDataFrame([("a", 1, 2, 1.0), ("b", 2, 3, 1.0), ("c", 3, 1, 5.0), ("d", 3, 4, 1.0), ("e", 5, 6, 1.0), ("f", 6, 5, 2.0), ("g", 1, 3, 2.0)], "edge string, src long, dst long, weight double")
    return nodes, edges


def as_dict(df, *columns):
    return {r[0]: r[1] if len(columns) == 1 else tuple(r)[1:] for r in df.select("id", *columns).collect()}


def test_graph_algorithms(net):
    nodes, edges = net
    assert as_dict(graph.weak_components(nodes, edges), "component_id") == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 0, 8: 0}
    assert as_dict(graph.strong_components(nodes, edges), "component") == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}
    assert as_dict(graph.degree(nodes, edges), "out_degree", "in_degree")[3] == (2, 2)
    assert as_dict(graph.reachable(nodes, edges), "reachable_count") == {1: 3, 2: 3, 3: 3, 4: 0, 5: 1, 6: 1, 7: 0, 8: 0}
    assert as_dict(graph.shortest(nodes, edges, nodes.where("id = 4")), "shortest_distance") == {1: 2, 2: 2, 3: 1, 4: None, 5: None, 6: None, 7: None, 8: None}
    tree = as_dict(graph.spanning_tree(nodes, edges), "tree_parent", "tree_depth")
    assert tree[1] == (None, 0) and tree[3] == (1, 1) and tree[4] == (3, 2) and tree[8] == (None, 0) and len(tree) == 8
    assert as_dict(graph.spanning_tree(nodes, edges, "dfs"), "tree_parent")[4] == 3
    assert as_dict(graph.spanning_tree(nodes, edges, "min_weight", "weight"), "tree_parent")[3] == 2


def test_trees_and_triangles_against_brute_force(spark):
    """Several components with ties of weights and edges in both directions, against sequential algorithms."""
    import random

    rng = random.Random(9)
    rows = [(f"e{i}", rng.randrange(40), rng.randrange(40), float(rng.randrange(4))) for i in range(60)] + [(f"f{i}", 100 + i, 101 + i, 1.0) for i in range(5)]
    edges = spark.createDataFrame(rows, "edge string, src long, dst long, weight double")
    nodes = spark.createDataFrame([(i,) for i in [*range(42), *range(100, 107)]], "id long")

    def bfs(pairs):
        near = {n: set() for p in pairs for n in p}
        for a, b in pairs:
            near[a].add(b)
            near[b].add(a)
        out, seen = {}, set()
        for start in sorted(near):
            if start in seen:
                continue
            seen.add(start)
            out[start] = (None, 0)
            line = [start]
            while line:
                node = line.pop(0)
                for x in sorted(near[node]):
                    if x not in seen:
                        seen.add(x)
                        out[x] = (node, out[node][1] + 1)
                        line.append(x)
        return out

    every = [(a, b) for _, a, b, _ in rows]
    alone = {r["id"]: (None, 0) for r in nodes.collect()}
    assert as_dict(graph.spanning_tree(nodes, edges), "tree_parent", "tree_depth") == alone | bfs(every)
    root, kept = {n: n for p in every for n in p}, []
    find = lambda x: x if root[x] == x else find(root[x])
    for _, a, b, _ in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if find(a) != find(b):
            root[find(b)] = find(a)
            kept.append((a, b))
    loops = {a: (None, 0) for a, b in every if a == b}
    assert as_dict(graph.spanning_tree(nodes, edges, "min_weight", "weight"), "tree_parent", "tree_depth") == alone | loops | bfs(kept)
    out = {}
    for a, b in every:
        if a != b:
            out.setdefault(a, set()).add(b)
    want = {n: sum(y in out.get(x, ()) for x in out.get(n, ()) for y in out.get(n, ()) if x != y) // 2 for n in alone}
    assert as_dict(graph.triangles(nodes, edges), "triangles") == want


def test_candidates_against_all_pairs(spark):
    import random

    from loomspark.operators import mapping

    rng = random.Random(4)
    words = ["company", "ltd", *(f"w{i}" for i in range(30))]
    rows = [(i, " ".join(["company", *rng.choices(words, k=rng.randint(0, 5))])) for i in range(120)]
    sets = {str(i): set(t.split()) for i, t in rows}
    for threshold in (0, 30, 60, 100):
        got = {(r["left"], r["right"], r["score"]) for r in mapping.candidates(spark.createDataFrame(rows, "id long, t string"), "id", "t", [], None, threshold).collect()}
        want = {(a, b, 100 * len(x & y) // len(x | y)) for a, x in sets.items() for b, y in sets.items() if a < b}
        assert got == {w for w in want if w[2] >= threshold}


def test_alias_import(spark, tmp_path):
    from loomspark.operators import mapping

    path = f"{tmp_path}/aliases.csv"
    with open(path, "w") as out:
        out.write("alias,canonical\nAcme,acme\n ACME ,acme\n,none\nOther,other\n")
    told = mapping.import_aliases(spark, path, steps=["trim_lower"])
    assert {(r["alias"], r["canonical"]) for r in told.collect()} == {("ACME", "acme"), ("Other", "other")}
    with open(path, "a") as out:
        out.write("acme,another\n")
    with pytest.raises(Exception, match="E_REF_INVALID"):
        mapping.import_aliases(spark, path, steps=["trim_lower"]).collect()


def test_quantised_search_recall(spark):
    """At least 0.9 of the ten best, over many queries, against the exact search."""
    import numpy as np

    from loomspark.operators import vectors

    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    hit = 0
    for i in range(0, 800, 50):
        best = set(np.argsort(-(x @ x[i]), kind="stable")[:10].tolist())
        hit += len(best & {r["vec_id"] for r in vectors.pq_search(df, x[i].tolist()).collect()})
    assert hit >= 0.9 * 10 * 16


def test_projection_expressions(spark):
    from loomspark.operators import projection

    records = spark.createDataFrame([("o", 0, "a", "r1", 1, 1, "baseline", {"name": " Ab ", "n": "3", "none": None, "empty": "", "flag": "false"}), ("o", 0, "b", "r2", 1, 1, "baseline", {"name": "é"})], "object_type string, branch_key long, goid string, record_id string, ts_us long, csn long, record_kind string, props map<string,string>")
    told = projection.Model(records, types={"n": "long", "flag": "boolean"})
    text = {
        "trimmed": "upper(trim(name))", "up": "upper('é x')", "first": "coalesce(none, empty, name)", "eq": "if(none == null, 1, 0)", "text": "if('b' > \"a\", 1, 0)", "mixed": "if(n == '3', 1, 0)", "number": "if(n >= 3, 'y', 'n')",
        "empty_is": "if(empty, 1, 0)", "flag_is": "ifelse(flag, 1, 0)", "nested": "if(n < 2, 'a, b', lower(identity('C)')))", "counted": "count(n)", "there": "exists(none)",
    }
    got = {r["id"]: r.asDict() for r in projection.projected(told, "one_row_per_object", "o", {"id": "goid", **text}).collect()}
    assert got["a"] == {"id": "a", "trimmed": "AB", "up": "é X", "first": "", "eq": 1, "text": 1, "mixed": 0, "number": "y", "empty_is": 0, "flag_is": 0, "nested": "c)", "counted": 1, "there": False}
    assert got["b"]["number"] == "n" and got["b"]["first"] == "é" and got["b"]["counted"] == 0
    for bad in (("one_row_per_day", "latest_committed", "goid"), ("one_row_per_object", "sometimes", "goid"), ("one_row_per_object", "valid_time", "goid"), ("one_row_per_object", "latest_committed", "nothing(goid)"), ("one_row_per_association", "latest_committed", "goid")):
        with pytest.raises(QueryError):
            projection.projected(told, bad[0], "o", {"x": bad[2]}, bad[1])


def test_ranks_against_dense_iteration(net):
    import numpy as np

    nodes, edges = net
    a = np.zeros((8, 8))
    for r in edges.collect():
        a[r["src"] - 1, r["dst"] - 1] = 1
    x = np.full(8, 1 / 8)
    out = a.sum(axis=1)
    for _ in range(20):
        x = 0.15 / 8 + 0.85 * (a.T @ np.divide(x, out, out=np.zeros(8), where=out > 0) + x[out == 0].sum() / 8)
    got = as_dict(graph.page_rank(nodes, edges), "rank")
    assert [got[i] for i in range(1, 9)] == pytest.approx(x.tolist())
    between = as_dict(graph.betweenness(nodes, edges), "centrality")
    assert between[3] == pytest.approx(3.0) and between[4] == 0


def test_communities(net):
    """Against the same steps over plain lists."""
    from collections import Counter

    near = [(r["src"], r["dst"]) for r in net[1].collect()]
    near += [(b, a) for a, b in near]
    labels = {i: i - 1 for i in range(1, 9)}
    for _ in range(5):
        new = {}
        for i, own in labels.items():
            votes = Counter(labels[b] for a, b in near if a == i)
            new[i] = min(votes, key=lambda v: (-votes[v], v)) if votes else own
        labels = new
    assert as_dict(graph.communities(*net, 5), "community") == labels


def test_traversal_limits(net):
    nodes, edges = net
    with pytest.raises(QueryError, match="E_RESOURCE_LIMIT"):
        graph.traverse(nodes, edges, 1, 3, limit=2)
    paths = graph.all_paths(nodes.where("id = 1"), edges, 4, k=1)
    assert {(r["node"], r["depth"]) for r in paths.collect()} == {(2, 1), (3, 1), (4, 2)}


def test_normalisation(spark):
    df = spark.createDataFrame([("  Ａcme   Widgets,\tInc. LLC ",), ("Ltd",), ("ß",), (None,)], "s string")
    steps = ["unicode_nfkc", "unicode_casefold", "strip_punctuation", "collapse_whitespace", "strip_legal_suffix", "sort_tokens"]
    assert [r[0] for r in df.select(pipeline(F.col("s"), steps)).collect()] == ["acme widgets", "ltd", "ss", None]
    with pytest.raises(QueryError):
        pipeline(F.col("s"), ["trim"], declared={"identity"})
    with pytest.raises(Exception, match="E_EXPRESSION"):
        df.select(pipeline(F.col("s"), ["parse_decimal"])).collect()


def rule(**more):
    return mapping.IdentityRule("r", "t", [("name", ["trim_lower"])], **more)


def test_identity_classes(spark):
    rows = spark.createDataFrame([(1, "A "), (2, "a"), (3, None)], "id int, name string")
    count = lambda *rules: mapping.merge(mapping.plan_identities([mapping.Source(f"s{i}", rows, "id", [r]) for i, r in enumerate(rules)])).groupBy("component").count().count()
    assert count(rule(), rule()) == 1
    assert count(rule(confidence="source_scoped"), rule(confidence="source_scoped")) == 2
    assert count(rule(confidence="strong_deterministic"), rule(confidence="candidate")) == 4
    assert count(rule(nulls="keep")) == 2


def test_reviewed_decisions(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, name string")
    planned = mapping.plan_identities([mapping.Source("s", rows, "id", [rule()])])
    pair = lambda a, b, d: spark.createDataFrame([("s", a, "s", b, d)], "a_source string, a_row string, b_source string, b_row string, decision string")
    assert mapping.merge(planned, pair("1", "2", "same_object")).select("component").distinct().count() == 1
    with pytest.raises(Exception, match="do_not_merge"):
        mapping.merge(planned, pair("1", "3", "do_not_merge")).collect()


def test_conflicts(spark):
    told = spark.createDataFrame([("g", "p", "1", "a", "r1", 1, 0), ("g", "p", "2", "b", "r2", 0, 1), ("g", "p", None, "c", "r3", 0, 0)], "goid string, property string, value string, source string, row string, priority int, source_order int")
    assert [tuple(r) for r in mapping.settle(told, "source_priority_wins").collect()] == [("g", "p", "2", 1)]
    with pytest.raises(Exception, match="E_PROPERTY_CONFLICT"):
        mapping.settle(told).collect()


def test_candidates_and_limits(spark):
    df = spark.createDataFrame([(1, "Tesco PLC"), (2, "tesco"), (3, "Tesco Stores PLC"), (4, "other")], "id int, name string")
    found = {(r["left"], r["right"]): r["score"] for r in mapping.candidates(df, "id", "name", ["trim_lower"], 3, 50).collect()}
    assert found == {("1", "2"): 50, ("1", "3"): 66}
    assert mapping.candidates(df, "id", "name", ["trim_lower"], 3, 0, pair_limit=1).count() == 0


def test_splits_and_ids(spark):
    import hashlib

    rows = spark.range(300).select("id", training.split_of(F.col("id")).alias("s"), training.sample_id(F.col("id")).alias("n")).collect()
    for r in rows:
        n = int.from_bytes(hashlib.sha256(str(r["id"]).encode()).digest()[:8], "little")
        part = n % 1_000_000
        assert int(r["n"]) == n and r["s"] == ("train" if part < 980_000 else "validation" if part < 990_000 else "test")


def test_imports(spark):
    df = spark.createDataFrame([("do", "", "x"), ("do", "this", "y")], "instruction string, input string, output string")
    assert [r["input"] for r in training.import_rows(df, "instruction").collect()] == ["do", "do\nthis"]
    chat = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "alien", "z")], "conv_id int, turn int, role string, text string")
    assert {r["conv_id"]: (r["target"], r["valid"]) for r in training.import_chat(chat).collect()} == {1: ("a", True), 2: (None, False)}


def test_cosine_of_zero_is_an_error(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id int, embedding array<double>")
    with pytest.raises(Exception, match="zero vector"):
        vectors.search(df, [1.0, 0.0]).collect()
    assert [r["vec_id"] for r in vectors.search(df, [1.0, 0.0], 1, "l2").collect()] == [2]
    assert vectors.indexed(df.where("vec_id = 2"), [1.0, 0.0], 1, "dot", "hnsw").first()["authority"] == "ExactFlatFallback"


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id long, s string")
    for kind in ("parquet", "orc", "jsonl", "csv"):
        files.write(df, f"{tmp_path}/t.{kind}")
        assert sorted(r["id"] for r in files.read(spark, f"{tmp_path}/t.{kind}").collect()) == [1, 2]
    import pyarrow as pa

    with pa.ipc.new_file(f"{tmp_path}/t.arrow", pa.schema([("id", pa.int64())])) as out:
        out.write_table(pa.table({"id": [3, 4]}))
    assert sorted(r["id"] for r in files.read(spark, f"{tmp_path}/t.arrow").collect()) == [3, 4]
    assert json.loads(files.rendered(df, "json"))[0] == {"id": 1, "s": "a,b"} and "a,b" in files.rendered(df)
    assert sum(r["members"] for r in files.tar_shards(df, "id", "s", 2).collect()) == 2
    files.write(df, f"{tmp_path}/p.parquet", partition_by=("id",))
    assert files.read(spark, f"{tmp_path}/p.parquet").where("id = 2").count() == 1
    two = files.read_dataset(spark, [f"{tmp_path}/t.parquet", f"{tmp_path}/t.parquet"])
    assert {r["file_ordinal"] for r in two.collect()} == {0, 1}
    with pytest.raises(QueryError):
        files.overlay(df, None, "id")


def test_streams_equal_batches(spark, tmp_path):
    from loomspark.streaming import events

    rows = [(i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", i % 3, ("view", "click")[i % 2], float(i)) for i in range(150)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.source(spark, f"{tmp_path}/in", df.schema)
    q = events.windowed(stream, "30 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").exceptAll(events.windowed(df, "30 minutes")).isEmpty() and spark.table("w").count() == events.windowed(df, "30 minutes").count()
    q = events.append_log(stream, lambda b: b.select("event_id"), f"{tmp_path}/log", f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 150


def test_ivf_is_exact(spark):
    """Noise without clusters, where few probes find about half, and rows that no cluster takes."""
    import random

    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(600)]
    df = spark.createDataFrame([*rows, (1000, None)], "vec_id long, embedding array<float>")
    for metric in vectors.METRICS:
        for i in (0, 300) if metric == "cosine" else (50,):
            query = list(map(float, rows[i][1]))
            got = [tuple(r) for r in vectors.ivf_search(df, query, 10, metric).collect()]
            assert got == [tuple(r) for r in vectors.search(df, query, 10, metric).collect()] and len(got) == 10


def test_semi_join_with_unmatched_rows(spark):
    """Left rows stay as often as they are; one without a match raises."""
    from loomspark.operators import relational

    left, right = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (2,), (2,)], "j int")
    out = relational.guarded_join(left, right, left["k"] == right["j"], "semi", unmatched="reject")
    assert sorted(r["k"] for r in out.collect()) == [1, 1, 2]
    with pytest.raises(Exception, match="UNMATCHED_ROW"):
        relational.guarded_join(left, right.where("j = 1"), left["k"] == right["j"], "semi", unmatched="reject").collect()


def test_checkpoint_tables_are_deleted(spark, tmp_path):
    import os

    from loomspark.operators import checkpoints

    with checkpoints.scratch() as kept:
        one, other = checkpoints.cut(spark.range(5)), checkpoints.cut(spark.range(6), 6)
        kept.append(other)
    here = lambda df: os.path.exists(df._cut_path.removeprefix("file:"))
    assert not here(one) and here(other) and other.count() == 6
    checkpoints.drop(other)
    assert not here(other)


def test_sums_beyond_the_range(spark):
    from loomspark.operators import relational

    df = spark.createDataFrame([(1, 2**63 - 1), (1, 5), (2, -(2**63)), (2, -7), (3, 4), (3, None)], "k int, v long")
    told = lambda policy: {r["k"]: r["s"] for r in df.groupBy("k").agg(relational.summed("v", policy).alias("s")).collect()}
    assert told("saturating") == {1: 2**63 - 1, 2: -(2**63), 3: 4}
    assert told("wrapping") == {1: -(2**63) + 4, 2: 2**63 - 7, 3: 4}
    assert {k: int(v) for k, v in told("widened").items()} == {1: 2**63 + 4, 2: -(2**63) - 7, 3: 4}
    with pytest.raises(Exception, match="overflow"):
        told("checked")
    assert df.where("k = 3").agg(relational.summed("v").alias("s")).first()["s"] == 4
