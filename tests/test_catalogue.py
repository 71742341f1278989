"""Every registered query against its SQL on the small tables."""

import check
import pytest

from corpusmill.catalog import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def duck(sf_dir="/root/testdata/sf0.001"):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    line = check.compare(spark, duck, name, QUERIES[name], SQL.get(name), sf)
    assert not line.startswith("FAIL"), line


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as contract

    rows = contract.entry(spark)
    assert rows.count() == 200
    assert set(rows.columns) == {"idx", "clarity", "response_quality", "diversity", "complexity", "score"}
