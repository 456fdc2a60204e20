"""Every query runs over whole tables; those with SQL give its rows."""

import pytest
from oracle import same

from lithoflow import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    if name in registry.ORACLE_SQL:
        same(df, registry.ORACLE_SQL[name], data)
    else:
        assert df.columns and df.count() > 0


def test_entry_point(spark, data):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).columns) > 3


def test_core_does_not_import_llm():
    import pathlib

    root = pathlib.Path(registry.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            text = path.read_text()
            assert "lithoflow.llm" not in text and "from .llm" not in text and "from ..llm" not in text, path
