import sys

import __spark_entry__ as entry


def test_queries_and_twins():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"match_{n}" for n in ("bytehash", "normhash", "name", "nec")} <= set(entry.queries())


def test_without_the_llm_folders(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("quillon.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quillon.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        found = entry.queries()
    except ModuleNotFoundError as e:  # what a None entry raises has the same name as a missing module
        raise AssertionError(e) from e
    assert found and not any(k.startswith("op") or k == "pipeline" for k in found)
