"""Every registered query with SQL gives the same rows in Spark and in DuckDB; all others at least run."""

import numpy as np
import pytest

from zonalis.jobs import queries as grid_queries

ORACLES = grid_queries.oracle_sql()


def _sorted(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def same(a, b):
    a, b = _sorted(a), _sorted(b)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind in "fiub" and y.dtype.kind in "fiub":
            x, y = x.to_numpy(float), y.to_numpy(float)
            assert ((x == y) | (np.isnan(x) & np.isnan(y))).all(), c
        else:
            assert (x.astype(str) == y.astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf_dir, duck):
    same(grid_queries.queries()[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df())


def test_every_query_has_sql_but_the_simulation():
    assert set(grid_queries.queries()) - set(ORACLES) == {"simulate_short"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
