"""Registered queries of the package: SQL counterparts, and that each runs on the small tables."""

import pytest
from compare import differences, open_oracle

from fleetdrift.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, small):
    df = QUERIES[name](spark, small)
    rows = [tuple(r) for r in df.collect()]
    assert differences(df, rows, open_oracle(small), ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs_on_whole_tables(name, spark, small):
    rows = QUERIES[name](spark, small).count()
    whole = {"op1_site_templates": "pages", "op9_string_tiling": None, "op10_histogram_packing": None, "op3_hnsw_search": None}
    table = whole.get(name, "documents")
    assert rows > 0 and (table is None or rows == spark.read.parquet(f"{small}/{table}.parquet").count())
