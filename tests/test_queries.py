"""Every query of the library against its SQL, and the others for rows."""

from __future__ import annotations

import pytest

from halyard.plans import registry
from tests.compare import oracle, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        want = oracle(registry.ORACLE_SQL[name], SF)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).collect()[0]
    assert (row["n_points"], row["n"], row["tau"]) == (16, 112, 0.116667)
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
