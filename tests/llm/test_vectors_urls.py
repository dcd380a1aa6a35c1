"""Vector operators, URL filters and the pipeline, against brute force."""

from collections import Counter

import numpy as np
import pytest
from loomspark.llm import common, near_vectors, topk, url_filter


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    rows = [(i * 10, (base[i % 40] + rng.normal(scale=0.12, size=16)).tolist()) for i in range(300)]
    rows += [(5, None), (15, []), (25, [0.0] * 16), (35, [1.0] * 15 + [None]), (45, [1.0] * 15 + [float("nan")]), (55, [1.0, 2.0]), (65, [2.0, 4.0]), (300, rows[30][1]), (None, rows[0][1])]
    return spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, label int, cell string, row int")


def complete(rows):
    out = []
    for i, r in enumerate(rows):
        v = r["embedding"]
        if r["vec_id"] is not None and v and all(x is not None and np.isfinite(x) for x in v):
            out.append((i, r["vec_id"], np.array(v, np.float64)))
    return out


def test_near_vectors(spark, embeddings):
    rows = embeddings.collect()
    found = [(i, n, v / np.linalg.norm(v)) for i, n, v in complete(rows) if np.abs(v).max() > 0]
    links, group = Counter(), {n: n for _, n, _ in found}
    for a, (i, m, v) in enumerate(found):
        for j, n, w in found[:a]:
            if len(v) == len(w) and v @ w >= 0.95:
                links[i] += 1
                links[j] += 1
                x, y = group[m], group[n]
                group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
    want = Counter((r["vec_id"], links[i], group.get(r["vec_id"], r["vec_id"]), r["vec_id"] == group.get(r["vec_id"], r["vec_id"])) for i, r in enumerate(rows))
    assert Counter(map(tuple, near_vectors.near_vectors(embeddings).collect())) == want
    assert near_vectors.near_vectors(embeddings.limit(0)).count() == 0


def test_multi_sequence_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(5)
    a[2] = b[3] = 0
    got = list(near_vectors.multi_sequence(a, b, 0.8))
    want = sorted((a[i] + b[j], i, j) for i in range(7) for j in range(5) if a[i] + b[j] <= 0.8)
    assert [a[i] + b[j] for i, j in got] == pytest.approx([w[0] for w in want])


@pytest.mark.parametrize("power", [0.0, 1.0, 1.5])
def test_index_recall_against_brute_force(power):
    """Links around many bases, with more codes than the small tables get: in even noise, and in noise and bases whose
    spread falls with the component, as it does in trained embeddings."""
    rng = np.random.default_rng(3)
    scale = np.arange(1.0, 65.0) ** -power
    base = rng.normal(size=(400, 64)) * scale
    x = np.repeat(base, 5, axis=0) + rng.normal(scale=0.2, size=(2000, 64)) * scale
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = near_vectors.Index(x[::2], 64 * near_vectors.CELL_BYTES // 512)
    assert [len(b) for b in index.books] == [8, 8]
    cells = index.cells(x)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    met = sum(cells[i][0] in cells[j] or cells[j][0] in cells[i] for i, j in zip(a, b, strict=True))
    assert len(a) > 500 and met == len(a)


def test_near_vectors_in_units(spark, monkeypatch):
    """A cell of many units, with equal vectors, guests and a chain of links, by brute force."""
    monkeypatch.setattr(near_vectors, "UNIT_BYTES", 16 * 64)
    monkeypatch.setattr(near_vectors, "CHUNK", 5)
    rng = np.random.default_rng(12)
    base = rng.normal(size=(3, 8))
    x = [base[i % 3] + rng.normal(scale=0.25, size=8) for i in range(260)] + [base[0]] * 90
    angle = np.linspace(0, 3, 25)
    x += [np.array([np.cos(t), np.sin(t), 0, 0, 0, 0, 0, 0]) for t in angle]
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(int(order[i]) % 360, v.astype(np.float32).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = df.collect()
    unit = np.array([near_vectors.unit_of(np.array(r["embedding"], np.float32)) for r in rows])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    group = {r["vec_id"]: r["vec_id"] for r in rows}
    for i, j in zip(*np.nonzero(near), strict=True):
        p, q = group[rows[i]["vec_id"]], group[rows[j]["vec_id"]]
        if p != q:
            group = {k: min(p, q) if g in (p, q) else g for k, g in group.items()}
    want = Counter((r["vec_id"], int(near[i].sum()), group[r["vec_id"]], r["vec_id"] == group[r["vec_id"]]) for i, r in enumerate(rows))
    assert Counter(map(tuple, near_vectors.near_vectors(df).collect())) == want


def brute_topk(rows, every=100, k=10):
    found = [(i, n, np.floor(1024 * v).astype(np.int64)) for i, n, v in complete(rows)]
    want = Counter()
    for i, n, q in found:
        if n % every == 0:
            ranked = sorted((-int(q @ w), m) for j, m, w in found if j != i and len(w) == len(q))[:k]
            want.update((n, place + 1, m, -s) for place, (s, m) in enumerate(ranked))
    return want


def test_topk(embeddings):
    """Two rows of the fixture have the id 300: each is a query, and a candidate of the other."""
    got = Counter(tuple(r)[:4] for r in topk.search(embeddings).collect())
    assert got == brute_topk(embeddings.collect())
    assert len([g for g in got.elements() if g[0] == 300]) == 20
    assert topk.search(embeddings.limit(0)).count() == 0


def test_topk_in_blocks(spark, monkeypatch):
    """Many blocks of vectors and queries, lengths of all sizes and many equal ones, repeated ids, few leaders."""
    for name, value in (("BLOCK_BYTES", 512), ("QUERY_BYTES", 512), ("TOGETHER", 3), ("LEADERS", 12)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 8)) * rng.exponential(size=(700, 1)) ** 2
    x[100:200] = x[100] / np.linalg.norm(x[100])
    rows = [(int(i) % 350, v.tolist()) for i, v in enumerate(x)] + [(50, [0.0] * 8), (100, [1.0, 2.0]), (150, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for every, k in ((10, 10), (1, 3)):
        assert Counter(tuple(r)[:4] for r in topk.search(df, every, k).collect()) == brute_topk(df.collect(), every, k)


def test_topk_of_large_values(spark):
    rows = [(0, [3e9, 1.0]), (1, [2e3, 5.0]), (2, [-1e3, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scaled = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    want = sorted(((-sum(a * b for a, b in zip(scaled[0], scaled[i], strict=True)), i) for i in (1, 2)))
    assert min(abs(s) for s, _ in want) > 1 << 53
    assert [(-r["score"], r["vec_id"]) for r in topk.search(df).orderBy("rank").collect()] == want


URLS = [
    None, "", "no-scheme.org/x", "http://org/", "http://org", "HTTP://A.ORG/es/", "https://example.org/es/1", "https://x.example.org/es/?q", "http://notexample.org/es/", "http://example.org/en/12#t",
    "http://example.org/en/2", "http://com/fr/", "http://a.b.com/de/x", "http://com.net/a.com/fr/", "ftp://u@a.com:80/fr/", "http://é.com/fr/é", "http://x://y.com/fr/", "http://a.com/fr/" + "z" * 500, "http://a.com/fr",
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    for r in url_filter.judge(df).collect():
        host, path = url_filter.host_and_path(r["url"])
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, url_filter.DEFAULT))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best[1], best[2])
    assert url_filter.judge(df.limit(0)).count() == 0
    assert url_filter.host_and_path("http://A.é/P?q#f") == ("a.é", "/P")


def test_automaton_over_many_words():
    rng = np.random.default_rng(2)
    globs = [[url_filter.ANY, *rng.integers(97, 100, rng.integers(1, 9)).tolist(), url_filter.ANY, *rng.integers(97, 100, 2).tolist()] for _ in range(60)]
    texts = [rng.integers(97, 100, rng.integers(0, 30)).astype(np.int16) for _ in range(200)]
    import re

    rules = [re.compile("".join(".*" if c == url_filter.ANY else chr(c) for c in g), re.DOTALL) for g in globs]
    got = url_filter.Automaton(globs).matches(texts)
    assert got.tolist() == [[r.fullmatch("".join(map(chr, t))) is not None for r in rules] for t in texts]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    group = {n: n for e in edges for n in e}
    for a, b in edges:
        x, y = group[a], group[b]
        group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
    got = {r["node"]: r["label"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: g for n, g in group.items() if n in {x for a, b in edges if a != b for x in (a, b)}}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    rows = [(i, f"Word{i} one two three four five six seven eight nine ten number {i} of the day. " * (1 + i % 4), "en", f"s{i % 3}", 10) for i in range(60)]
    rows += [(60, rows[3][1], "en", "s0", 10), (61, None, None, None, None), (62, 'Here token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ends the line.', "en", "s1", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = common.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "bpe encoding":
            assert out.columns == docs.columns
        docs = common.cut(out)
    done = docs.collect()
    assert done and all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in done)
    assert 60 not in {r["doc_id"] for r in done}


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, further columns with names of the operators, repeated ids, equal rows, nulls and a long text."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, _row int, k1 string, size string, _good int"
    long = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    rows = [(i, f"Document {i} says that number {i * 37} of the list is not the number {i} of another.", "en", "a" if i % 2 else None, 1) for i in range(40)]
    rows += [rows[3], (3, "Another text with the same id as one that came before it.", "en", "a", 1), (None, None, None, None, None), (41, "", "en", "b", 0), (42, long, "en", "b", len(long))]
    rows = [(*r, 7, "k", "s", 8) for r in rows]
    for name, own in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(own, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs, seen = common.table(spark, folder, "documents"), {}
        for stage, function in corpus_pipeline.STAGES[:-1]:
            docs = common.cut(function(spark, docs, folder))
            assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
            seen[stage] = docs.collect()
        assert all({(r["_row"], r["k1"], r["size"], r["_good"]) for r in out} <= {(7, "k", "s", 8)} for out in seen.values())
        done = corpus_pipeline.run(spark, folder).collect()
        assert all(r["round_trip"] for r in done)
        if own:
            assert len(seen["quality classifier"]) == len(rows) and len(seen["minhash near-dedup"]) == len(rows) - 1
            assert Counter(r["doc_id"] for r in seen["minhash near-dedup"])[3] == 2 and 42 in {r["doc_id"] for r in done}
        else:
            assert done == [] and not any(seen.values())


def test_long_urls(spark):
    """Urls of a megabyte among thousands of short ones get the same verdicts, without a table as wide as the longest."""
    import tracemalloc

    globs = [[url_filter.ANY, *url_filter.canonical(h, p).tolist(), url_filter.ANY] for h, p, _ in url_filter.RULES]
    rng = np.random.default_rng(4)
    urls = [f"https://{'x' * int(n)}.example.org/{'es' if n % 2 else 'fr'}/{'y' * int(n)}" for n in rng.integers(1, 60, 4000)]
    urls += ["https://a.com/de/" + "z" * (1 << 20), "https://" + "b." * (1 << 19) + "example.org/en/1", "data:" + "c" * (1 << 20)]
    texts = [url_filter.canonical(*url_filter.host_and_path(u)) for u in urls]
    automaton = url_filter.Automaton(globs)
    tracemalloc.start()
    got = automaton.matches(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20
    for u, row in zip(urls, got, strict=True):
        host, path = url_filter.host_and_path(u)
        assert row.tolist() == [(host == h or host.endswith("." + h)) and path.startswith(p) for h, p, _ in url_filter.RULES]
