"""Every query of the catalogue that has SQL gives the rows that DuckDB gives."""

import math
import os

import pytest

from gristmill.plans import catalog, oracle

SF = "/root/testdata/sf0.01"
#: A query of every family; the driver compares them all.
NAMES = ["forward_returns_h5_delay1", "rank_ic_daily", "newey_west_t", "feature_shift_profile", "input_staleness_runs", "normal_score", "cost_gate", "entry_constraints", "backtest_drift", "null_matched_buckets", "increment_summary", "bm25_search", "verdict_fold"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(rows):
    none = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(([none(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got = catalog.QUERIES[name](spark, SF)
    res = con.execute(oracle.SQL[name])
    columns = [c[0] for c in res.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(res.fetchall())


def test_every_query_has_sql_or_is_listed():
    without = {"orthogonalize_multi", "matched_selection_null", "random_selection_book", "rolling_fit_predict", "truncation_rebuild", "label_shuffle_refit"}
    assert set(catalog.QUERIES) - set(oracle.SQL) == without
    assert set(oracle.SQL) <= set(catalog.QUERIES)
