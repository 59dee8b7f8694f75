"""The element of a given rank in each group, by narrowing histograms.

Each round counts values in 4,096 equal parts of every group's interval, with partial counts on the map side; the part that holds the
wanted rank becomes the group's interval, from its least to its largest value. Least and largest values fall into different parts, so an
interval shrinks until one value is left: two or three rounds for measurements, however many. Values are never exchanged or sorted.
What is broadcast is one row for each group; with more groups than BROADCAST_GROUPS, or of a type whose values a double can't tell apart, the
caller sorts instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialize

PARTS = 4096
BROADCAST_GROUPS = 100_000


def told_apart(kind: T.DataType) -> bool:
    """Whether doubles hold all values of a type."""
    return isinstance(kind, (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)) or isinstance(kind, T.DecimalType) and kind.precision <= 15


def _part(x: Column) -> Column:
    """A finite value's part of its group's interval; infinities and NaN, which sort as the largest, have parts of their own."""
    v, lo, hi = x.cast("double") / 2, F.col("_lo").cast("double") / 2, F.col("_hi").cast("double") / 2  # halves: no difference overflows
    inf = F.lit(float("inf"))
    at = F.least(F.floor(F.try_divide(v - lo, hi - lo) * PARTS), F.lit(PARTS - 1).cast("long"))
    return F.when(F.isnan(v), PARTS + 1).when(v == inf, PARTS).when(v == -inf, -1).otherwise(F.coalesce(at, F.lit(0)))


def select(df: DataFrame, by: list[str], value: str, rank: Callable[[Column], Column], most_groups: int = BROADCAST_GROUPS) -> DataFrame | None:
    """(by..., value), written: each group's element at the rank that `rank` makes of its size, counted from 0 in ascending order. Nulls
    don't count. None if there are more groups than may be broadcast. by: no columns that begin with _."""
    x = df.where(F.col(value).isNotNull()).select(*by, value)
    finite = F.when(~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) != float("inf")), F.col(value))
    state = x.groupBy(*by).agg(F.count("*").alias("_size"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    # an interval of one value is not known to be all: infinities lie outside of it in the first round
    state = materialize(state.select(*by, rank(F.col("_size")).cast("long").alias("_rank"), "_lo", "_hi", F.lit(True).alias("_open")))
    if state.count() > most_groups:
        discard(state)
        return None
    done = []
    while True:
        if by:
            known = F.broadcast(state.select(*(F.col(c).alias(f"_{c}") for c in by), "_lo", "_hi"))
            read = x.join(known, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)))
        else:
            read = x.crossJoin(F.broadcast(state.select("_lo", "_hi")))  # one row
        inside = F.lit(True) if not done else F.col(value).between(F.col("_lo"), F.col("_hi"))
        counts = read.where(inside).groupBy(*by, _part(F.col(value)).alias("_part")).agg(F.count("*").alias("_n"), F.min(value).alias("_a"), F.max(value).alias("_b"))
        order = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a group's parts
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
        at = state.select(*(F.col(c).alias(f"_{c}") for c in by), "_rank")
        if by:
            counts = counts.join(F.broadcast(at), reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)))
        else:
            counts = counts.crossJoin(F.broadcast(at))
        hit = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
        found = materialize(counts.where(hit).select(*by, (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi")))
        discard(state)
        done.append(found.where("_lo = _hi").select(*by, F.col("_lo").alias(value)))
        state = found.where("_lo <> _hi")
        if state.isEmpty():
            break
        state = materialize(state)
    return materialize(reduce(DataFrame.unionByName, done))
