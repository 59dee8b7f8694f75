"""The published example of this kind of trace, for those who have its matrix (1138 x 1138, 2596 stored entries)."""

import os

import pytest

from memlattice.operators import references
from memlattice.plans import trace
from memlattice.sources import config, mtx, report

PATH = os.environ.get("MEMLATTICE_1138_BUS")

#: The example's caches and threads, and its misses by cache, thread and domain: fixed values.
CACHES = {"L1-0": (32768, "L2-0"), "L1-1": (32768, "L2-1"), "L2-0": (262144, "L3"), "L2-1": (262144, "L3"), "L3": (20971520, None)}
MISSES = {"L1-0": [[423, 0], [0, 0]], "L1-1": [[0, 0], [35, 427]], "L2-0": [[423, 0], [0, 0]], "L2-1": [[0, 0], [35, 427]], "L3": [[396, 0], [23, 427]]}
MATRIX_SIZE = 35708


@pytest.mark.skipif(not PATH, reason="set MEMLATTICE_1138_BUS to the path of the matrix")
def test_published_trace(spark):
    caches = {n: config.Cache(n, size, 64, parent=parent) for n, (size, parent) in CACHES.items()}
    c = config.TraceConfig("example", "", 2, (), caches, (config.Thread(0, "L1-0", 0), config.Thread(1, "L1-1", 1)))
    k = references.Csr(mtx.load(spark, PATH), PATH)
    assert k.info()["matrix_size"] == MATRIX_SIZE
    assert report.miss_matrices(trace.cache_misses(c, k), c) == MISSES
