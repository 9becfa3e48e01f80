"""Every registered query of the core against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quillon.plans import catalogue


def key(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return f"{float(v):.5f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(key, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def oracle(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, data, oracle, name):
    df = catalogue.queries()[name](spark, data)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if not sql:
        assert df.columns
        return
    found = oracle.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    at = [names.index(n) for n in order]
    assert sorted("|".join(key(r[n]) for n in order) for r in rows) == sorted("|".join(key(r[i]) for i in at) for r in found.fetchall())


def test_cleaning_changes_text(spark, data):
    rows = catalogue.queries()["clean_dirty_text"](spark, data)
    assert rows.where("text <> raw").count() == rows.count() > 0


def test_only_core(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def without(name, *a, **k):
        if "llm" in name or (a and len(a) > 2 and a[2] and "llm" in str(a[2])) or (name.endswith("quillon.llm")):
            raise ImportError(name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", without)
    for m in [m for m in sys.modules if m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, m)
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries() and not any(k[0] == "p" and k[1].isdigit() for k in entry.queries())
    sys.modules.pop("__spark_entry__", None)


@pytest.mark.parametrize("error", [ModuleNotFoundError("No module named 'xxhash'", name="xxhash"), ImportError("numpy is broken"), ImportError("cannot import name 'catalogue' from 'quillon.llm'", name="quillon.llm")])
def test_only_core_if_the_rest_is_missing(monkeypatch, error):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def broken(name, *a, **k):
        if name == "quillon.llm":
            raise error
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", broken)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    with pytest.raises(ImportError) as raised:
        importlib.import_module("__spark_entry__")
    assert raised.value is error
