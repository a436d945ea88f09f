import importlib

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("missing,absent", [("marlpit.llm", True), ("corpus_pipeline", True), ("xxhash", False), ("marlpit.llm.mixing", False)])
def test_only_the_operators_themselves_may_be_absent(monkeypatch, missing, absent):
    def fail(name):
        raise ModuleNotFoundError(name, name=missing)

    monkeypatch.setattr(importlib, "import_module", fail)
    if absent:
        assert entry.optional("corpus_pipeline") is None
    else:
        with pytest.raises(ModuleNotFoundError):
            entry.optional("corpus_pipeline")


def test_every_library_query_has_its_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.oracle_sql()) >= 46
