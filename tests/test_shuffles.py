"""Role tables that are dealt out for their readers: the rows of their SQL, and one shuffle for the table and the join."""

import datetime

import pytest
from pyspark.sql import functions as F

from cratewise.queries import load_all
from cratewise.queries.roles import ROLE_SQL, Roles

LINES = [
    (1, 33, 5, 1, 2.0), (1, 33, 5, 2, 3.5), (1, 33, 6, 4, 1.0), (1, 33, 5, 1, 2.0), (2, 33, 5, None, 0.5), (2, 20, 7, 3, None), (3, 20, 7, 3, 1.0),
    (3, 21, 7, 1, 4.0), (None, 33, 7, 1, 4.0), (3, None, 7, 1, 4.0), (4, 44, None, 1, 9.0), (9, 44, 8, 1, 9.0), (12, 2_000_000_011, 8, 1, 7.0), (12, 200_000_001, 8, 5, 7.0),
]
ORDERS = [(1, 7), (2, 7), (3, None), (4, 8), (4, 8), (None, 9), (12, 7)]


@pytest.fixture(scope="module")
def roles(spark, tmp_path_factory):
    load_all()
    folder = tmp_path_factory.mktemp("dealt")
    day = datetime.datetime(2020, 1, 1)
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp"
    spark.createDataFrame([(*x, day) for x in LINES], line).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    return Roles(spark, str(folder))


@pytest.mark.parametrize("name", ["listen", "rec_work", "isrc"])
def test_rows_are_those_of_the_sql(roles, name):
    ours, sql = getattr(roles, name), roles._sql(ROLE_SQL[name])
    assert [f.name + f.dataType.simpleString() for f in ours.schema] == [f.name + f.dataType.simpleString() for f in sql.schema]
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, sql.collect())) and ours.count() > 3


@pytest.mark.parametrize("name, key", [("listen", "gid"), ("rec_work", "recording"), ("isrc", "recording")])
def test_a_join_on_the_key_needs_no_further_shuffle(spark, roles, name, key):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        table = getattr(roles, name).select("*")  # planned anew, not run
        other = spark.range(5).select(F.col("id").cast(table.schema[key].dataType).alias(key), "id")
        alone, joined = (plan(df).count("Exchange hashpartitioning") for df in (table, table.join(other, key)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert joined == alone + 1  # that of the other side
