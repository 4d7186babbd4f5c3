"""Every query of the core runs; those with SQL give its rows."""

import pytest

from millrace.plans import catalogue
from tests import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, con, name):
    columns, rows = oracle.rows_of(catalogue.QUERIES[name](spark, sf_dir))
    if name in catalogue.SQL:
        assert (columns, rows) == oracle.sql_rows(con, catalogue.SQL[name])
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["word", "cnt"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
