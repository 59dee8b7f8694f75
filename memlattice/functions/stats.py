"""Descriptive statistics of samples, with the definitions that measurement reports here have always used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.position import positioned
from . import selection

NAN = float("nan")


#: The largest number, and the smallest positive one at full precision.
_LARGEST, _SMALLEST = 1.7976931348623157e308, 2.2250738585072014e-308
_WHOLE = {"byte": 7, "short": 15, "int": 31, "long": 63}


def sample_min(x: Column, kind: str = "double") -> Column:
    """The type's largest value for an empty sample."""
    return F.coalesce(F.min(x), F.lit((1 << _WHOLE[kind]) - 1 if kind in _WHOLE else _LARGEST).cast(kind))


def sample_max(x: Column, kind: str = "double") -> Column:
    """For an empty sample the type's least value, or the smallest positive one if it has fractions."""
    return F.coalesce(F.max(x), F.lit(-(1 << _WHOLE[kind]) if kind in _WHOLE else _SMALLEST).cast(kind))


def mean(x: Column) -> Column:
    """NaN for an empty sample."""
    return F.coalesce(F.avg(x), F.lit(NAN))


def central_moment(x: Column, order: int) -> Column:
    """Moment about the mean, divided by n, from the sums of powers that Spark merges stably."""
    n = F.count(x)
    if order == 2:
        return F.coalesce(F.var_pop(x), F.lit(NAN))
    if order == 3:
        return F.when(n == 0, NAN).otherwise(F.when(F.var_pop(x) == 0, 0.0).otherwise(F.skewness(x) * F.pow(F.var_pop(x), F.lit(1.5))))
    if order == 4:
        return F.when(n == 0, NAN).otherwise(F.when(F.var_pop(x) == 0, 0.0).otherwise((F.kurtosis(x) + 3) * F.pow(F.var_pop(x), F.lit(2.0))))
    raise ValueError("orders 2, 3 and 4 are supported")


def variance(x: Column) -> Column:
    """Divided by n - 1; NaN for fewer than two values."""
    return F.coalesce(F.var_samp(x), F.lit(NAN))


def standard_deviation(x: Column) -> Column:
    return F.sqrt(variance(x))


def skewness(x: Column) -> Column:
    """Third moment (over n) by the cube of the sample deviation (over n - 1)."""
    n = F.count(x)
    return F.when((n < 2) | (F.var_samp(x) == 0), NAN).otherwise(F.skewness(x) * F.pow((n - 1) / n, F.lit(1.5)))


def kurtosis(x: Column) -> Column:
    """Fourth moment by the squared second: 3 for a normal sample."""
    return F.when((F.count(x) == 0) | (F.var_pop(x) == 0), NAN).otherwise(F.kurtosis(x) + 3)


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., median): the element at n div 2 of the sorted sample, the upper middle one of an even number.

    By narrowing histograms, which exchange counts alone; with very many groups, or of values that doubles can't tell apart, by one range
    sort. No group is gathered anywhere.
    """
    if selection.told_apart(df.schema[value].dataType):
        found = selection.select(df, by, value, lambda n: F.floor(n / 2))
        if found is not None:
            return found.withColumnRenamed(value, "median")
    x = positioned(df.where(F.col(value).isNotNull()).select(*by, value), [*by, value], "_p")
    g = x.groupBy(*by).agg(F.min("_p").alias("_p0"), F.count("*").alias("_n"))
    at = g.select(*by, (F.col("_p0") + F.floor(F.col("_n") / 2)).alias("_p"))
    return at.join(x.select("_p", F.col(value).alias("median")), "_p").drop("_p")


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., samples, min, max, mean, median, variance, standard_deviation, skewness, kurtosis) of each group's values."""
    x = F.col(value).cast("double")
    s = df.groupBy(*by).agg(
        F.count(x).alias("samples"), F.min(value).alias("min"), F.max(value).alias("max"), mean(x).alias("mean"), variance(x).alias("variance"),
        standard_deviation(x).alias("standard_deviation"), skewness(x).alias("skewness"), kurtosis(x).alias("kurtosis"),
    )
    return s.join(medians(df, by, value), by, "left") if by else s.crossJoin(medians(df, by, value))


def extrapolated(count: Column, enabled: Column, running: Column) -> Column:
    """A multiplexed counter's count over the whole time it was enabled; 0 if it never ran."""
    return F.when(running == 0, F.lit(0).cast("long")).otherwise(F.floor(count * (enabled / running)).cast("long"))


def event_counts(df: DataFrame, by: list[str], event: str = "event", count: str = "count", extrapolate: bool = True, enabled: str = "time_enabled", running: str = "time_running") -> DataFrame:
    """(by..., counts): a map from event to the sum of its counts, each over the whole time that its counter was enabled, unless
    asked otherwise or the times aren't there. A map has as many keys as there are kinds of events."""
    n = F.col(count)
    if extrapolate and {enabled, running} <= set(df.columns):
        n = extrapolated(n, F.col(enabled), F.col(running))
    each = df.groupBy(*by, event).agg(F.sum(n).alias("_n"))
    return each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(event, "_n"))).alias("counts"))


def event_count(counts: Column, event: str) -> Column:
    """An event's count, 0 if it isn't there."""
    return F.coalesce(F.try_element_at(counts, F.lit(event)), F.lit(0))


def grouped_events(groups: DataFrame, counters: DataFrame) -> DataFrame:
    """groups: (thread, event_groups) of a configuration. counters: (run, thread, event, count[, time_enabled, time_running]).

    (run, thread, event_group, event, count) for every event of every group of a thread: one that several groups list comes
    once for each of them, and one without counters doesn't come.
    """
    each = groups.select("thread", F.posexplode("event_groups").alias("event_group", "g")).select("thread", "event_group", F.explode("g.events").alias("event"))
    n = F.col("count")
    if {"time_enabled", "time_running"} <= set(counters.columns):
        n = extrapolated(n, F.col("time_enabled"), F.col("time_running"))
    found = counters.select("run", "thread", "event", n.alias("count"))
    return found.join(F.broadcast(each), ["thread", "event"]).select("run", "thread", "event_group", "event", "count")  # a configuration's size
