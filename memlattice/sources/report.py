"""JSON reports of traces and profiles."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .config import TraceConfig


def pretty(value) -> str:
    """Two spaces of indent; NaN becomes the string "nan"."""

    def plain(x):
        if isinstance(x, float) and math.isnan(x):
            return "nan"
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(plain(value), indent=2)


def miss_matrices(misses: DataFrame, config: TraceConfig) -> dict[str, list[list[int]]]:
    """cache -> [thread][domain], caches by name; [] for a cache that no thread reaches."""
    out = {c: [[0] * config.num_numa_domains for _ in config.threads] if config.active_threads(c) else [] for c in sorted(config.caches)}
    for r in misses.where("misses > 0").collect():  # as many rows as the configuration has
        out[r["cache"]][r["thread"]][r["numa_domain"]] = r["misses"]
    return out


def trace(config: TraceConfig, kernel: dict, warmup: bool, misses: DataFrame) -> dict:
    return {"trace_config": config.as_json(), "kernel": kernel, "warmup": warmup, "cache_misses": miss_matrices(misses, config)}


def sample(row, unit: str) -> dict:
    return {k: row[k] for k in ("samples", "min", "max", "mean", "median", "variance", "standard_deviation", "skewness", "kurtosis")} | {"unit": unit}


def profile(config: TraceConfig, kernel: dict, times: DataFrame, events: DataFrame | None = None) -> dict:
    """times: (run, ns). events: counters (run, thread, event, count[, time_enabled, time_running]); those that the configuration's
    event groups list are reported, for each thread, group and event."""
    t = stats.summary(times, [], "ns").first()
    found = []
    if events is not None:
        grouped = stats.grouped_events(config.threads_frame(events.sparkSession), events)
        found = stats.summary(grouped, ["thread", "event_group", "event"], "count").orderBy("thread", "event_group", "event").collect()
    return {"trace_config": config.as_json(), "kernel": kernel, "execution_time": sample(t, "ns"), "profiling_events": [{"name": r["event"], "thread": r["thread"], "counts": sample(r, r["event"])} for r in found]}


def as_frame(df: DataFrame) -> DataFrame:
    """Each row as one JSON document, nulls written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
