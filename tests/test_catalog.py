"""Every query with SQL gives DuckDB's rows; the others give rows."""

from __future__ import annotations

import pytest

from tests.conftest import DATA, as_lines
from wavelane.plans import catalog


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        assert as_lines(got) == as_lines(duck.execute(catalog.ORACLES[name]).df())
    else:
        assert len(got) > 0


def test_entry_names(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_without_the_text_half(monkeypatch):
    import __spark_entry__ as entry

    whole = set(entry.queries())
    real = entry.importlib.import_module

    def missing(name, *args):
        if name.startswith(("wavelane.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
        return real(name, *args)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert set(entry.queries()) == set(catalog.QUERIES) <= whole and entry.oracle_sql() == catalog.ORACLES
