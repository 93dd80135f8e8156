"""Every registered query runs; those with a DuckDB twin agree with it."""

import pytest

from tests.oracle import SF, compare
from wattline.plans import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    if name in ORACLES:
        compare(df, ORACLES[name])
    else:
        assert df.count() >= 0


def test_entry_and_registry_agree(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_nothing_outside_llm_imports_it():
    from pathlib import Path

    root = Path(registry.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "wattline.llm" not in p.read_text(), p
