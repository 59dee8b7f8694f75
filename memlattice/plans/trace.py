"""From a configuration and a kernel to the misses of every cache."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from ..operators import caches as sim
from ..operators.references import Kernel, Threads
from ..sources.config import TraceConfig


def groups(config: TraceConfig, names: list[str] | None = None) -> tuple[list, list]:
    """Caches of the same threads and line size share a stream: (group, thread, line_size) and (cache, group, lines)."""
    active, caches = {}, []
    for c in config.caches.values():
        threads = config.active_threads(c.name)
        if threads and (names is None or c.name in names):
            group = f"{','.join(map(str, threads))}/{c.line_size}"
            active[group] = [(group, t, c.line_size) for t in threads]
            caches.append((c.name, group, c.lines))
    return [r for rows in active.values() for r in rows], caches


def stream(config: TraceConfig, kernel: Kernel, warmup: bool = False, initial: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The references by group of caches, and (cache, group, lines). The references are made once for all caches."""
    refs = kernel.references(Threads(config.domains))
    spark = refs.sparkSession
    active, caches = groups(config)
    refs = sim.interleave(refs.select("thread", "t", "addr", "domain"), spark.createDataFrame(active, "group string, thread int, line_size long"))
    return sim.replayed(refs, warmup, initial), spark.createDataFrame(caches, "cache string, group string, lines long")


def cache_misses(config: TraceConfig, kernel: Kernel, warmup: bool = False, policy: str = "lru", initial: DataFrame | None = None) -> DataFrame:
    """(cache, thread, numa_domain, misses) for every cache that a thread reaches, every thread and every domain."""
    active, kept = groups(config)
    refs = kernel.references(Threads(config.domains)).select("thread", "t", "addr", "domain")
    caches = refs.sparkSession.createDataFrame(kept, "cache string, group string, lines long")
    if policy == "lru":
        found = sim.lru_misses_by_windows(refs, active, kept, warmup, initial)
    else:
        found = sim.simulate_by_windows(refs, active, kept, policy, warmup, initial)
    return sim.full_grid(found, caches, len(config.threads), config.num_numa_domains)


def timed(spark: SparkSession, kernel: Kernel, runs: int, flush: bool = False) -> DataFrame:
    """(run, ns) of that many products after one that doesn't count."""
    out = []
    for n in range(-1, runs):
        if flush:
            spark.catalog.clearCache()
        began = time.perf_counter_ns()
        kernel.run().write.format("noop").mode("overwrite").save()
        if n >= 0:
            out.append((n, time.perf_counter_ns() - began))
    return spark.createDataFrame(out, "run int, ns long")
