"""Every registered query of the tree operators gives the rows of its SQL twin."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from arborscale import plans
from arborscale.plans import registry

plans.load()
DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(x):
    """A value in a form that both engines share."""
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19].replace("T00:00:00", "")
    if isinstance(x, str):
        return x
    return f"{float(x):.6g}" if abs(float(x)) < 1e6 else f"{float(x):.3f}"


def rows(frame: pd.DataFrame) -> list:
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_others_have_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
