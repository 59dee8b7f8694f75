import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from memlattice.functions import moments, selection, stats
from memlattice.operators import equality

NAN, INF = float("nan"), float("inf")


def ordered(values):
    return sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))


def same(a, b):
    return a == b or math.isnan(a) and math.isnan(b)


def groups(seed):
    r = random.Random(seed)
    return {
        "equal": [7.5] * 40, "two": [1.0, 2.0] * 20 + [2.0], "one": [3.0], "wide": [r.choice([-1, 1]) * 10.0 ** r.randint(-30, 30) for _ in range(60)], "extremes": [1.7e308, -1.7e308, 1.6e308, 0.0, -0.0],
        "infinite": [INF, -INF, 1.0, INF, NAN], "nan": [NAN, NAN, 5.0], "close": [1.0 + k * 2.220446049250313e-16 for k in range(50)], "many": [r.gauss(0, 9) for _ in range(500)], None: [4.0, None, 9.0, None], "only infinite": [INF, INF, -INF],
    }


@pytest.mark.parametrize("rank,at", [(lambda n: F.floor(n / 2), lambda n: n // 2), (lambda n: F.lit(0), lambda n: 0), (lambda n: n - 1, lambda n: n - 1)])
def test_any_rank_of_any_values(spark, rank, at):
    data = groups(1)
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double").repartition(3)
    got = {r["g"]: r["v"] for r in selection.select(df, ["g"], "v", rank).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        known = ordered(vs)
        assert same(got[g], known[at(len(known))]), (g, got[g])


def test_without_groups_other_types_and_limits(spark):
    df = spark.createDataFrame([(k % 3, k, Decimal(k) / 4) for k in range(101)], "g int, n int, d decimal(9,2)")
    for c, want in (("n", 50), ("d", Decimal("12.50"))):
        found = selection.select(df, [], c, lambda n: F.floor(n / 2))
        assert found.collect()[0][0] == want and found.schema[c].dataType == df.schema[c].dataType
    assert selection.select(df.where("n < 0"), [], "n", lambda n: F.lit(0)).count() == 0
    assert selection.select(df.where("n < 0"), ["g"], "n", lambda n: F.lit(0)).count() == 0
    assert selection.select(df, ["n"], "g", lambda n: F.lit(0), most_groups=50) is None
    longs = spark.createDataFrame([((1 << 60) + k,) for k in range(9)], "v long")  # doubles can't tell these apart: they are sorted
    assert not selection.told_apart(longs.schema["v"].dataType) and stats.medians(longs, [], "v").first()["median"] == (1 << 60) + 4


def test_medians_exchange_counts_alone(spark):
    df = spark.range(100_000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("medians", "")
    got = {r["g"]: r["median"] for r in stats.medians(df, ["g"], "v").collect()}
    jobs = tracker.getJobIdsForGroup("medians")
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs and len(jobs) < 40
    want = df.groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("s")).collect()
    assert got == {r["g"]: r["s"][len(r["s"]) // 2] for r in want}


@pytest.mark.parametrize("parts", [1, 4, 1000])
def test_merged_states_are_those_of_the_whole(spark, parts):
    r = random.Random(parts)
    data = {"a": [r.gauss(1e6, 3) for _ in range(300)], "b": [5.0] * 9, "c": [2.0], None: [1.0, 2.0, 4.0]}
    df = spark.createDataFrame([(g, v, k) for g, vs in data.items() for k, v in enumerate([*vs, None])], "g string, v double, k int")
    states = df.groupBy("g", (F.col("k") % parts).alias("part")).agg(moments.state(F.col("v")).alias("state"))
    moments.register(spark)
    moments.merged(states, ["g"]).createOrReplaceTempView("merged_states")
    got = {x["g"]: x for x in spark.sql("select g, sample_count(state) n, sample_mean(state) mean, sample_variance(state) var, sample_deviation(state) dev, sample_skewness(state) skew, sample_kurtosis(state) kurt, sample_min(state) lo, sample_max(state) hi from merged_states").collect()}
    want = {x["g"]: x for x in stats.summary(df, ["g"], "v").collect()}
    for g, x in got.items():
        w = want[g]
        assert (x["n"], x["lo"], x["hi"]) == (w["samples"], w["min"], w["max"])
        for c, name in (("mean", "mean"), ("var", "variance"), ("dev", "standard_deviation"), ("skew", "skewness"), ("kurt", "kurtosis")):
            assert same(x[c], w[name]) or x[c] == pytest.approx(w[name], rel=1e-6, abs=1e-9), (g, c)
    whole = moments.merged(states, []).select("state.*").first()
    assert whole["n"] == sum(map(len, data.values())) and whole["least"] == 1.0


def test_states_of_nothing(spark):
    moments.register(spark)
    spark.createDataFrame([], "v double").agg(moments.state(F.col("v")).alias("s")).createOrReplaceTempView("no_states")
    r = spark.sql("select sample_count(s), sample_mean(s), sample_variance(s), sample_skewness(s), sample_kurtosis(s), sample_min(s) from no_states").first()
    assert r[0] == 0 and all(map(math.isnan, r[1:5])) and r[5] is None


def test_fingerprints(spark):
    kind = "a long, b double, c string"
    rows = [(1, 2.0, "x"), (1, 2.0, "x"), (2, None, None), (3, NAN, ""), (None, 0.0, "y")]
    df = spark.createDataFrame(rows, kind)
    assert equality.same_rows(df, spark.createDataFrame(rows[::-1], kind).repartition(3)) and equality.same_rows(df, df.select("c", "a", "b"))
    for other in (rows[1:], rows[1:] + [rows[2]], [(2, 1.0, "x"), *rows[1:]], [(1, 2.0, None), *rows[1:]], [*rows[:2], (None, None, "2"), *rows[3:]]):
        assert not equality.same_rows(df, spark.createDataFrame(other, kind))
    assert not equality.same_rows(df, df.withColumn("a", F.col("a").cast("int"))) and not equality.same_rows(df, df.drop("a"))
    swapped = spark.createDataFrame([(1, None, None, 2)], "p int, q int, r int, s int"), spark.createDataFrame([(None, 1, None, 2)], "p int, q int, r int, s int")
    assert not equality.same_rows(*swapped)
    assert equality.first_difference(df, df, ["a"]) is None
    assert equality.first_difference(df, spark.createDataFrame(rows[1:], kind), ["a"]) == ("left", (1, 2.0, "x"))
    assert equality.first_difference(df.where("a < 3"), spark.createDataFrame([*rows[:3], (0, 1.0, "z")], kind), ["a"]) == ("right", (0, 1.0, "z"))
    empty = df.limit(0)
    assert equality.same_rows(empty, empty) and not equality.same_rows(empty, df)
