import importlib
import sys


def test_entry_runs(spark, small):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["slot", "section", "rank", "ord", "id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_loads_without_llm(monkeypatch):
    import __spark_entry__ as e
    import tidewire.queries as registry

    for name in [n for n in sys.modules if n.startswith("tidewire.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tidewire.llm", None)
    monkeypatch.setattr(registry, "QUERIES", {})
    importlib.reload(e)
    e._load()


def test_core_queries_run(spark, small):
    import __spark_entry__ as e

    for name in ("title_keys", "topic_heat", "keyword_search", "p4_found", "wire_merge", "provider_newsapi"):
        assert e.queries()[name](spark, small).count() >= 0
