"""The driver's contract."""

import re

import __spark_entry__ as entry


def test_names_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["segment", "n", "total"] and df.count() == 5


def test_entry_without_the_optional_part():
    """Without the optional subpackage and the pipeline the other queries stay."""
    import importlib
    import sys

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name in ("loomspark.llm", "corpus_pipeline"):
                raise ModuleNotFoundError(name, name=name)

    saved = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("loomspark.llm") or k == "corpus_pipeline"}
    sys.meta_path.insert(0, Missing())
    try:
        fresh = importlib.reload(entry)
        assert not any(re.match(r"op\d", k) or k == "pipeline" for k in fresh.queries())
    finally:
        sys.meta_path.pop(0)
        sys.modules.update(saved)
