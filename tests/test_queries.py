"""Every query with SQL gives the rows that DuckDB gives for it."""

import pandas as pd
import pytest

from recallforge.plans import catalogue
from tests.conftest import SMALL


def rows(df):
    """Rows with the columns by name, in one order, floats to nine places."""
    cell = lambda v: None if pd.isna(v) else round(float(v), 9) if isinstance(v, float) else v if isinstance(v, (str, bool)) else int(v)
    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_run(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLE):
        assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "hybrid_rrf" in e.queries()
