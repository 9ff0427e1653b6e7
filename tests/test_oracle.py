"""Every registered query against its DuckDB twin (the driver's correctness gate)."""

import pytest

from conftest import SF01
from oracle import compare
from tokenmill import registry

registry.load_all()
NAMES = sorted(registry.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_twin(spark, name):
    builder = registry.QUERIES[name]
    if name not in registry.ORACLE:
        assert builder(spark, SF01).count() >= 0
        return
    s, d = compare(spark, name, builder, registry.ORACLE[name], SF01)
    assert s[0] == d[0], f"rows {s[0]} != {d[0]}"
    assert s[1] == d[1], f"columns {s[1]} != {d[1]}"
    assert s[2] == d[2], "values differ"


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
