"""Registration, templates, policies, review, replay and exports."""

import pytest
from loomspark.errors import QueryError
from loomspark.lang.templates import BUILT_IN, Template
from loomspark.operators import mapping, policy, temporal, training
from loomspark.plans.chain import query
from loomspark.sources import register
from loomspark.sources.catalog import Catalog
from pyspark.sql import functions as F


def test_templates(spark):
    by_name = {t.name: t for t in BUILT_IN}
    catalog = Catalog(spark).add("t", spark.createDataFrame([("a",), ("a",), ("b",)], "k string"))
    assert [tuple(r) for r in query(catalog, by_name["count_by"].render(table="t", column="k")).collect()] == [("a", 2), ("b", 1)]
    assert query(catalog, by_name["equal"].render(table="t", column="k", value='a" || true')).count() == 0
    with pytest.raises(QueryError, match="E_LITERAL"):
        by_name["top"].render(table="t", column="k", n="3")
    with pytest.raises(QueryError, match="E_UNKNOWN_BINDING"):
        by_name["top"].render(table="t")
    with pytest.raises(QueryError, match="E_PARSE"):
        Template("bad", "table({t}", {"t": "name"}).render(t="x")


def test_registration(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, s string")
    df.write.parquet(f"{tmp_path}/a.parquet")
    register.register_file(spark, "surface_a", f"{tmp_path}/a.parquet")
    assert spark.sql("SELECT count(*) FROM surface_a").first()[0] == 2
    register.register_overlay(spark, "surface_b", df, df.where("id = 1"), "id")
    assert [r[0] for r in spark.sql("SELECT id FROM surface_b").collect()] == [2]
    with pytest.raises(QueryError):
        register.register_dataset(spark, "surface_c", [f"{tmp_path}/a.parquet"], trusted=False)
    catalog = Catalog(spark)
    catalog.projections["p"] = lambda: df
    assert register.register_projections(catalog) == ["p"] and query(catalog, "projection(p).where(id == 2).select(s)").first()[0] == "y"
    df.write.json(f"{tmp_path}/m.jsonl")
    assert query(register.mount(catalog, "m", f"{tmp_path}/m.jsonl"), "table(m).select(n: count(*))").first()[0] == 2
    entries = [{"path": "a", "least_csn": 1}]
    assert register.publish(spark, f"{tmp_path}/manifest.json", entries) and register.publish(spark, f"{tmp_path}/manifest.json", entries)
    assert register.manifest(spark, f"{tmp_path}/manifest.json") == entries
    assert register.result(df, "arrow").num_rows == 2 and len(list(register.result(df, "iterator"))) == 2
    assert register.blocking_reason(["where", "orderBy"]) == "orderBy" and register.blocking_reason(["where"]) is None


def test_policies(spark):
    df = spark.createDataFrame([("a", 1, "s"), ("a", 2, None), ("b", 3, "t")], "k string, v int, s string")
    assert [tuple(r) for r in policy.redacted(df, ["s", "v"], F.col("k") == "b").collect()] == [("a", 1, "s"), ("a", 2, None), ("b", None, "<redacted>")]
    got = {r["k"]: (r["n"], r["suppressed"]) for r in policy.disclosed(df, ["k"], {"n": F.count("*")}, "thresholded", 2).collect()}
    assert got == {"a": (2, False), "b": (None, True)}
    with pytest.raises(QueryError):
        policy.disclosed(df, ["k"], {"n": F.count("*")}, "reject")
    with pytest.raises(QueryError):
        policy.row_budget(df, 2)
    assert policy.row_budget(df, 3).count() == 3


def test_review_and_replay(spark):
    df = spark.createDataFrame([(1, "acme one"), (2, "acme two"), (3, "acme one")], "id int, name string")
    items = mapping.worklist(mapping.candidates(df, "id", "name", ["trim_lower"], None, 90), "r")
    row = items.first()
    assert (row["left"], row["right"], items.count()) == ("1", "3", 1)
    verdict = spark.createDataFrame([(row["candidate_id"], "same_object")], "candidate_id string, decision string")
    rule = mapping.IdentityRule("r", "t", [("id", [])])
    planned = mapping.plan_identities([mapping.Source("s", df, "id", [rule])])
    assert mapping.merge(planned, mapping.decisions(items, verdict, "s")).select("component").distinct().count() == 2
    assert mapping.worklist(mapping.candidates(df, "id", "name", ["trim_lower"], None, 90), "r", verdict).count() == 0
    recorded = {"df": mapping.content_digest(df)}
    assert mapping.stale(recorded, {"df": df.orderBy(F.desc("id"))}) == [] and mapping.stale(recorded, {"df": df.limit(2)}) == ["df"]


def test_source_operations(spark):
    rows = spark.createDataFrame([("a", "insert", 1, "x"), ("a", "patch", 2, "y"), ("b", "insert", 1, "z"), ("b", "tombstone", 3, None)], "k string, op string, n int, v string")
    log = mapping.records_of(rows, "t", F.col("k"), F.col("op"), F.col("n"), F.col("n"), ["v"])
    assert [(r["goid"], r["props"]) for r in temporal.states(log).collect()] == [("a", {"v": "y"})]
    with pytest.raises(Exception, match="E_UNKNOWN_BINDING"):
        mapping.records_of(rows.withColumn("op", F.lit("dance")), "t", F.col("k"), F.col("op"), F.col("n"), F.col("n"), ["v"]).collect()


def test_sequences_and_export(spark, tmp_path):
    elements = spark.createDataFrame([(1, 1, "image", "b"), (1, 0, "text", "a")], "sequence_id int, place int, kind string, asset string")
    assert training.multimodal(elements).first()["kinds"] == "text,image"
    samples = spark.range(20).select("id", training.sample_id(F.col("id")).alias("sample_id"), training.split_of(F.col("id")).alias("split"), F.lit("t").alias("text"))
    ids = [r["sample_id"] for r in training.iterate(samples)]
    assert ids == sorted(ids) and len(ids) == 20
    for kind in ("jsonl", "parquet", "webdataset"):
        training.export(samples, f"{tmp_path}/{kind}", kind)
    assert spark.read.parquet(f"{tmp_path}/webdataset").groupBy().sum("members").first()[0] == 20
    assert training.mapped(samples, {"a": "id", "b": "none"}).columns == ["a", "b"]


def test_manifest_digests(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, s string")
    path = f"{tmp_path}/t.parquet"
    df.write.parquet(path)
    right = register.file_digest(spark, path)
    register.register_dataset(spark, "surface_d", [path], trusted=False, digests={path: right})
    assert spark.sql("SELECT count(*) FROM surface_d").first()[0] == 2
    with pytest.raises(QueryError):
        register.register_dataset(spark, "surface_e", [path], trusted=False, digests={path: "wrong"})


def test_publish_replaces_in_one_step(spark, tmp_path):
    path = f"{tmp_path}/manifest.json"
    for n in range(3):
        register.publish(spark, path, [{"path": f"part-{n}"}])
        assert register.manifest(spark, path) == [{"path": f"part-{n}"}]


def test_arrow_files(spark, tmp_path):
    from loomspark.sources import files

    df = spark.range(1000).select("id", F.col("id").cast("string").alias("s"), F.array("id").alias("a")).repartition(3)
    report = files.export_arrow(df, f"{tmp_path}/t.arrow")
    assert report["rows"] == 1000 and not any(c["lossy"] for c in report["columns"])
    back = files.read(spark, f"{tmp_path}/t.arrow")
    assert back.dtypes == df.dtypes and back.exceptAll(df).isEmpty() and back.count() == 1000
    assert files.export_arrow(df.limit(0), f"{tmp_path}/none.arrow")["rows"] == 0
    training.export(df, f"{tmp_path}/u.arrow", "arrow")
    assert files.read(spark, f"{tmp_path}/u.arrow").count() == 1000
    with pytest.raises(QueryError):
        files.write(df, f"{tmp_path}/v.arrow")


def test_conversion_reports(spark):
    from loomspark.sources import files

    df = spark.sql("SELECT 1 AS i, 'x' AS s, current_timestamp() AS t, map('a', 1) AS m, timestamp_ntz'2024-01-01' AS n, X'00' AS b")
    lossy = lambda kind: [c["column"] for c in files.conversion_report(df, kind) if c["lossy"]]
    assert lossy("archive") == ["t", "m"] and lossy("csv") == ["s", "t", "m", "b"] and lossy("json") == ["i", "t", "b"] and lossy("parquet") == []
    with pytest.raises(QueryError):
        files.conversion_report(df, "xml")


def test_methods_that_would_be_dropped_raise(spark):
    catalog = Catalog(spark)
    catalog.edges = spark.createDataFrame([("e", "a", "x", "y")], "assoc_type string, assoc_goid string, source_goid string, target_goid string")
    for chain in ("association(e).asOf(csn: 1)", "association(e).history()", 'association(e).branch("nope")', "association(e).changes(from: 1, to: 2)"):
        with pytest.raises(QueryError, match="E_METHOD_CONFLICT"):
            query(catalog, chain)
    catalog.records = spark.createDataFrame([("o", 0, "x", "r", 1, 1, "baseline", {"a": "b"})], "object_type string, branch_key long, goid string, record_id string, ts_us long, csn long, record_kind string, props map<string,string>")
    for chain in ("object(o).degree().pageRank()", "object(o).history(mode: everything)"):
        with pytest.raises(QueryError, match="E_METHOD_CONFLICT"):
            query(catalog, chain)


def test_explain_modes(spark):
    import json

    from loomspark.plans.chain import EXPLAIN_MODES, explain

    catalog = Catalog(spark).add("t", spark.range(5).withColumn("secret", F.lit("s")))
    text = {m: explain(catalog, "table(t).where(id > 2).select(id)", m) for m in EXPLAIN_MODES}
    told = {m: json.loads(x.split("\n")[0]) for m, x in text.items()}
    assert all(told[m]["mode"] == m for m in EXPLAIN_MODES) and len({x.split("\n", 1)[0] for x in text.values()}) == len(EXPLAIN_MODES)
    assert "\n" not in text["public"] and "Physical Plan" in text["developer"] and "Analyzed" in text["forensic"] and "scans" in told["proof"] and told["ai"]["ai"]["methods"] == []
    assert json.loads(explain(catalog, "table(t).select(id).explain(proof)").split("\n")[0])["mode"] == "proof"
