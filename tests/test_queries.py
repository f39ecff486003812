"""Each query of the library against its SQL, at the smallest scale."""

import pytest
from sqlcheck import connect, same

from auditloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    query, sql = QUERIES[name]
    df = query(spark, SF)
    if sql:
        same(df, con, sql)
    else:
        assert df.count() > 0


def test_one_and_many_partitions(spark):
    query = QUERIES["a1_thread_rates"][0]
    got = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, query(spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
