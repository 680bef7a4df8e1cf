import pytest

from profloom.plans import catalog, formats, profiles, reports, streams  # noqa: F401

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(same_as_duckdb, name):
    same_as_duckdb(catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", ["fit_initial_guess", "fit_iterative", "fit_bisection", "cluster_traces", "match_locations", "local_intervals", "kernel_local_cubic"])
def test_query_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
