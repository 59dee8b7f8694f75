import os

import pytest
from pyspark.sql import functions as F

from memlattice.operators.position import positioned
from memlattice.session import clear, discard, in_order, materialize, materialize_sorted, passing, shared_dir


def test_tables_in_the_shared_folder(spark):
    df = materialize(spark.range(10).toDF("n"))
    path = df._memlattice_path.removeprefix("file:")
    assert df.count() == 10 and path.startswith(shared_dir(spark).removeprefix("file:")) and os.path.isdir(path)
    discard(df)
    assert not os.path.exists(path)
    discard(spark.range(1))


def test_clear(spark):
    kept = materialize(spark.range(3))._memlattice_path.removeprefix("file:")
    clear(spark)
    assert not os.path.exists(kept)


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_positions(spark, n):
    df = spark.range(n).selectExpr("id % 7 as a", "id as b")
    got = [tuple(r) for r in positioned(df, ["a", "b"], "k").orderBy("k").collect()]
    assert got == [(a, b, k) for k, (a, b) in enumerate(sorted((x % 7, x) for x in range(n)))]


def test_a_hot_key_is_spread(spark):
    df = spark.range(20000).selectExpr("case when id % 3 > 0 then 1 else id end as a", "id as b")
    x = df.repartitionByRange(4, "a", "b").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in x.collect()) < 9000
    assert positioned(df, ["a", "b"], "k").agg(F.sum("k")).first()[0] == 20000 * 19999 // 2


def test_sorted_tables_join_as_they_lie(spark):
    x = materialize_sorted(spark.range(100).selectExpr("id % 50 as a", "id as n").groupBy("a").count(), 4, "a")
    y = materialize_sorted(spark.range(30).selectExpr("id as a", "id as m").repartition(4, "a"), 4, "a")
    with in_order(spark):
        j = x.join(y.hint("merge"), "a")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort [" not in plan and sorted(r["a"] for r in j.collect()) == list(range(30))
    path, name = (df._memlattice_path.removeprefix("file:") for df in (x, y))
    discard(x)
    tables = lambda: {t.name for t in spark.catalog.listTables()}
    assert not os.path.exists(path) and os.path.basename(path) not in tables() and os.path.basename(name) in tables()
    clear(spark)
    assert not os.path.exists(name) and os.path.basename(name) not in tables()


def test_passing_tables(spark):
    before = materialize(spark.range(2))
    with passing(spark) as kept:
        gone = materialize(spark.range(3))
        kept.append(materialize(gone))
    assert kept[0].count() == 3 and before.count() == 2 and not os.path.exists(gone._memlattice_path.removeprefix("file:"))
