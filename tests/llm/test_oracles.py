"""Every operator query with SQL against DuckDB, and all queries' registration."""

import pytest

from granary.llm.queries import ORACLES, QUERIES
from tests.duck import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLES[name])


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
