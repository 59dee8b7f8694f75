"""Command line: trace or time a kernel under a configuration. Run by spark-submit it uses the session's master, else a local one."""

from __future__ import annotations

import argparse
import os
import sys

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from .errors import MatrixError, TraceConfigError
from .operators.references import KERNELS, Triad
from .plans import trace
from .session import clear, local_session
from .sources import config, events, mtx, report


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="memlattice", description="Cache misses and timings of sparse matrix-vector products.")
    p.add_argument("-m", "--matrix", help="a Matrix Market file: plain, .gz, .tar.gz or .tgz; suffixes __RCM and __GP<n> reorder it")
    p.add_argument("-c", "--trace-config", help="a JSON description of caches and threads")
    p.add_argument("--strict", action="store_true", help="refuse caches that leave out a nullable key")
    p.add_argument("--list-perf-events", metavar="TABLE", help="list the events of a catalogue (CSV, JSON lines or Parquet) and end")
    p.add_argument("--events", metavar="TABLE", help="counters of a profile, as Parquet: run, thread, event, count, time_enabled, time_running")
    p.add_argument("--spmv-format", choices=sorted(KERNELS))
    p.add_argument("--triad", type=int, default=0, metavar="N", help="trace a triad of N elements (24 bytes and 2 operations each)")
    p.add_argument("-p", "--profile", type=int, metavar="N", help="time N runs instead of tracing")
    p.add_argument("--warmup", action="store_true", help="count a second pass over warm caches")
    p.add_argument("--flush-caches", action="store_true", help="drop cached tables between timed runs")
    p.add_argument("-v", "--verbose", action="store_true")
    a = p.parse_args(argv)
    own = SparkSession.getActiveSession() is None
    spark = SparkSession.getActiveSession() or (SparkSession.builder.getOrCreate() if "PYSPARK_GATEWAY_PORT" in os.environ else local_session())
    spark.sparkContext.setLogLevel("WARN" if a.verbose else "ERROR")
    try:
        if a.list_perf_events:
            print(events.listing(events.read(spark, a.list_perf_events)))
            return 0
        if not a.trace_config:
            p.error("--trace-config is needed")
        cfg = config.read(spark, a.trace_config, a.strict)
        if a.spmv_format:
            if not a.matrix:
                p.error("--spmv-format needs --matrix")
            kernel = KERNELS[a.spmv_format](mtx.load(spark, a.matrix), a.matrix)
        else:
            kernel = Triad(spark, a.triad)
        if a.profile:
            counters = spark.read.parquet(a.events) if a.events else None
            found = report.profile(cfg, kernel.info(), trace.timed(spark, kernel, a.profile, a.flush_caches), counters)
        else:
            found = report.trace(cfg, kernel.info(), a.warmup, trace.cache_misses(cfg, kernel, a.warmup))
    except (MatrixError, TraceConfigError, AnalysisException, Py4JJavaError) as e:
        said = e.java_exception.getMessage() if isinstance(e, Py4JJavaError) else str(e)
        print(f"memlattice: {(said or type(e).__name__).splitlines()[0]}", file=sys.stderr)
        return 1
    finally:
        if own:
            clear(spark)
    print(report.pretty(found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
