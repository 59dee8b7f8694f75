"""Caches that follow a stream of references.

Each cache is a keyed state machine: micro-batches bring (cache, pos, line) in the order of pos, the state keeps the lines
held, and every batch gives the misses so far. Late references would change what came after them, so a batch whose
positions lie before those already seen is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.caches import POLICIES
from ..session import ship

OUT = "cache string, references long, misses long"
STATE = "held string, last long, refs long, misses long"


def live_misses(refs: DataFrame, lines: dict[str, int], policy: str = "lru") -> DataFrame:
    """refs: a streaming frame (cache, pos, line). Updates (cache, references, misses) for each cache that a batch touches."""
    if policy not in ("lru", "fifo"):
        raise ValueError("lru and fifo keep their state in the lines' order")
    ship(refs.sparkSession)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name = key[0]
        held, last, n, misses = state.get if state.exists else ("", -1, 0, 0)
        cache = POLICIES[policy](lines[name], [int(x) for x in held.split()])
        pdf = pd.concat(list(batches)).sort_values("pos")
        if len(pdf) and int(pdf["pos"].iloc[0]) <= last:
            raise ValueError(f"cache {name}: references before position {last} have come too late")
        for line in pdf["line"]:
            misses += cache.allocate(int(line))
        if len(pdf):
            last, n = int(pdf["pos"].iloc[-1]), n + len(pdf)
        state.update((" ".join(map(str, cache.held)), last, n, misses))
        yield pd.DataFrame({"cache": [name], "references": [n], "misses": [misses]})

    return refs.groupBy("cache").applyInPandasWithState(follow, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
