import importlib
import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_queries_equal_their_sql(spark):
    import duckdb

    own = importlib.import_module("hexnet.plans.queries")
    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem", "nation"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    row = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    for name in ("graph_merge", "graph_nodes_types", "contract_chains", "within_threshold_many_min", "sp_k_nearest", "sp_with_gap", "diff_stats", "h3_children", "car_profile", "dataset_outer_merge"):
        got = own.QUERIES[name](spark, SF)
        names = sorted(got.columns)
        want = con.sql(f"select {', '.join(names)} from ({own.SQL[name]}) q" if not own.SQL[name].lstrip().startswith("with") else own.SQL[name])
        order = [want.columns.index(c) for c in names]
        expected = sorted((row(r[k] for k in order) for r in want.fetchall()), key=str)
        assert sorted((row(r) for r in got.select(*names).collect()), key=str) == expected, name


def test_entry_lists_every_query_and_works_without_the_training_data_part():
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names)
    assert "sp_k_nearest" in names and "graph_stats" in e.oracle_sql()


def test_entry_runs(spark):
    import __spark_entry__ as e

    if os.path.isdir(SF):
        assert e.entry(spark).count() >= 0
