"""Every query of the engine's own operators against its oracle, on the smallest tables."""

import pytest

from setflow.workloads import registry
from tests.oracle import check

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, small, name):
    check(spark, small, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
