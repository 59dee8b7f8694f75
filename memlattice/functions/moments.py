"""Samples' statistics from states that can be stored and merged, and as SQL functions.

A state is the number of values, their mean, the sums of the second, third and fourth powers of their distances from it, and the least and the
largest of them. States of parts (days, runs, sources) are stored; those of a whole follow from them alone, without the values. Of no
values all statistics are NaN but the number, of equal ones skewness and kurtosis are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "struct<n: bigint, mean: double, m2: double, m3: double, m4: double, least: double, largest: double>"

#: Name -> SQL over a state s, by the definitions of functions.stats.
FUNCTIONS = {
    "sample_count": ("bigint", "s.n"),
    "sample_min": ("double", "s.least"),
    "sample_max": ("double", "s.largest"),
    "sample_mean": ("double", "coalesce(s.mean, double('NaN'))"),
    "sample_variance": ("double", "CASE WHEN s.n > 1 THEN s.m2 / (s.n - 1) ELSE double('NaN') END"),
    "sample_deviation": ("double", "CASE WHEN s.n > 1 THEN sqrt(s.m2 / (s.n - 1)) ELSE double('NaN') END"),
    "sample_skewness": ("double", "CASE WHEN s.n > 1 AND s.m2 > 0 THEN (s.m3 / s.n) / power(s.m2 / (s.n - 1), 1.5) ELSE double('NaN') END"),
    "sample_kurtosis": ("double", "CASE WHEN s.n > 0 AND s.m2 > 0 THEN (s.m4 / s.n) / power(s.m2 / s.n, 2) ELSE double('NaN') END"),
}


def state(x: Column) -> Column:
    """The state of a group's values, an aggregate; nulls don't count. Spark merges its moments stably."""
    x = x.cast("double")
    n, v = F.count(x), F.var_pop(x)
    spread = v > 0
    m3, m4 = F.skewness(x) * F.pow(v, F.lit(1.5)) * n, (F.kurtosis(x) + 3) * v * v * n
    zero = F.lit(0.0)
    return F.struct(
        n.alias("n"), F.avg(x).alias("mean"), F.coalesce(v * n, zero).alias("m2"), F.when(spread, m3).otherwise(zero).alias("m3"), F.when(spread, m4).otherwise(zero).alias("m4"),
        F.min(x).alias("least"), F.max(x).alias("largest"),
    )


def merged(states: DataFrame, by: list[str], column: str = "state") -> DataFrame:
    """(by..., column): the states of groups of states. Each is moved to the common mean, and the sums are added up."""
    s = F.col(column)
    common = states.groupBy(*by).agg((F.sum(s["n"] * s["mean"]) / F.sum(F.when(s["mean"].isNotNull(), s["n"]))).alias("_mean"))
    if by:
        common = common.select(*(F.col(c).alias(f"_{c}") for c in by), "_mean")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        x = states.join(common, same[0] if len(same) == 1 else same)
    else:
        x = states.crossJoin(F.broadcast(common))  # one row
    n, d = s["n"], F.coalesce(s["mean"] - F.col("_mean"), F.lit(0.0))
    m2, m3, m4 = s["m2"], s["m3"], s["m4"]
    return x.groupBy(*by).agg(
        F.struct(
            F.sum(n).alias("n"), F.first("_mean").alias("mean"), F.sum(m2 + n * d * d).alias("m2"), F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
            F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"), F.min(s["least"]).alias("least"), F.max(s["largest"]).alias("largest"),
        ).alias(column)
    )


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL: sample_variance(state) and so on."""
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s {STATE}) RETURNS {kind} RETURN {body}")
