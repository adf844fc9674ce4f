"""Every registered query gives the rows of its SQL counterpart."""

import __spark_entry__ as entry
import pytest
from compare import differences, open_oracle

from fleetdrift.plans.all_queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def oracle(small):
    return open_oracle(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, small, oracle):
    df = QUERIES[name](spark, small)
    rows = [tuple(r) for r in df.collect()]
    assert differences(df, rows, oracle, ORACLES[name]) == []


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["pair_id", "n_add", "n_mod", "n_del", "n_conflict"]


def test_entry_registers_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
