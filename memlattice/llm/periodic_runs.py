"""Periodic runs of words: a suffix automaton whose ordered end-position sets are merged small to large.

A run is a stretch of words with a smallest period q, at least `exponent` periods and `least` words long, that no neighbouring word
extends with that period. The automaton's states stand for the phrases of a text; a state's end positions are those of its children
in the link tree, merged from the longest state down, each smaller ordered set into the larger one. A distance between new
neighbours that doesn't exceed the state's length is a square: the phrase overlaps or touches its own next occurrence. Each
square is a seed and is extended to both sides as far as the period holds. Every run of two periods or more is found: the run less
its last period is a phrase whose next occurrence is one period on, and none lies between.

A run's phrases of a few words come back within a period, all of them but the first period's. Stretches where that is so, for periods that fit
the stretch, are found for many texts at once with numpy, and automata are built over these stretches and the period in front of
them alone. This loses no run (a test holds it against all runs), and most texts, which have none, need no automaton. Words are
compared as such; hashes only choose the stretches.

A text is the work of one task, and texts are independent, so copies, hot sources and lost executors are as anywhere. A task needs some
500 bytes for each word of a stretch that repeats itself, and eight for each word of a text. Null and empty texts have no words and no runs,
and collapse to the empty text. Repeated rows each get a row; ids may be null. Runs come in order of start and period, so there are no
ties. Columns other than id and text aren't read; output columns take free names beside an id that is called like one. An empty
table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, sliced, small_batches
from .common import words as split_words
from .word_arrays import chained, mixed, words

LEAST, EXPONENT = 6, 4

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def squares(phrase: list) -> dict[int, list[int]]:
    """Distance -> ends e: the words up to e and the same words up to e + distance touch or overlap."""
    nxt, link, length, ends, last = [{}], [-1], [0], [[]], 0
    for at, word in enumerate(phrase):
        state = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        ends.append([at])
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = state
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if length[q] > length[p] + 1:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                ends.append([])
                link[q] = clone
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = clone
                    p = link[p]
                q = clone
            link[state] = q
        last = state
    del nxt
    found = defaultdict(list)
    for state in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
        parent, small = link[state], ends[state]
        ends[state] = []
        if not parent:
            continue
        large, most = ends[parent], length[parent]
        if len(small) > len(large):
            small, large = large, small
        for k, x in enumerate(small):
            i = bisect_left(large, x)
            if i and x - large[i - 1] <= most:
                found[x - large[i - 1]].append(large[i - 1])
            # the neighbour after it is new unless another of the smaller set comes between
            if i < len(large) and large[i] - x <= most and (k + 1 == len(small) or small[k + 1] > large[i]):
                found[large[i] - x].append(x)
            large.insert(i, x)
        ends[parent] = large
    return found


def extended(text: list, seeds: dict[int, list[int]], offset: int, least: int = LEAST, exponent: int = EXPONENT) -> dict[tuple[int, int], int]:
    """(start, stop) -> period of the runs around the squares, whose ends count from offset."""
    out, n = {}, len(text)
    for d, ends in seeds.items():
        done = 0
        for e in sorted(ends):
            e += offset
            if e + d < done:  # in the run that the last one was extended to
                continue
            lo, hi = e - d + 1, e + d + 1
            while lo and text[lo - 1] == text[lo - 1 + d]:
                lo -= 1
            while hi < n and text[hi] == text[hi - d]:
                hi += 1
            done = hi
            if hi - lo >= max(least, exponent * d):
                out[lo, hi] = min(d, out.get((lo, hi), d))
    return out


def stretches(hashes: np.ndarray, ends: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(text, from, to): stretches of words outside of which no run lies. hashes, ends: of the words of many texts.

    Of a run of period q and length l, the phrases of g words that begin at or after its first period are l - q - g + 1, one after the
    other, and each has an occurrence at most q before it. So a stretch of s phrases that come back is part of runs of a period of at most
    (s + g - 1) / (exponent - 1), and phrases that come back later than that don't count.
    """
    short = min(max(least, exponent * q) - q for q in range(1, least + 1))
    g = min(3, short)
    n = len(hashes) - g + 1
    if n <= 0:
        return []
    rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    phrases = mixed(chained([hashes[k : n + k] for k in range(g)]) ^ mixed(rows[:n].astype(np.uint64)))
    order = np.argsort(phrases, kind="stable")
    again = np.flatnonzero(phrases[order[1:]] == phrases[order[:-1]])
    back = np.zeros(n, np.int64)  # how far before it a phrase stood last, or 0
    back[order[again + 1]] = order[again + 1] - order[again]
    back[rows[:n] != rows[g - 1 :]] = 0
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate(([False], back > 0, [False])))).reshape(-1, 2)
        edges = edges[edges[:, 1] - edges[:, 0] > short - g]
        size, most = edges[:, 1] - edges[:, 0], np.zeros(n, np.int64)
        if len(edges):
            at = np.repeat(edges[:, 0], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            most[at] = np.repeat((size + g - 1) // (exponent - 1), size)
        stays = np.where(back <= most, back, 0)
        if (stays == back).all():
            break
        back = stays
    out = []
    for a, b in edges.tolist():
        row = int(rows[a])
        out.append((row, max(int(ends[row]), a - (b - a + g - 1) // (exponent - 1)) - int(ends[row]), min(int(ends[row + 1]), b + g - 1) - int(ends[row])))
    return out


def runs_of(text: list, where: list[tuple[int, int]], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in some stretches of a text's words, by start and period."""
    found: dict[tuple[int, int], int] = {}
    for lo, hi in where:
        found |= extended(text, squares(text[lo:hi]), lo, least, exponent)
    return sorted((lo, hi - lo, d) for (lo, hi), d in found.items())


def collapsed(text: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by single spaces, without those that follow a run's first period in it."""
    gone = bytearray(len(text))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return b" ".join([w for w, x in zip(text, gone) if not x] if runs else text)


def _found(least: int, exponent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = batch.column("text")
            hashes, ends = words(texts)
            where = defaultdict(list)
            for row, lo, hi in stretches(hashes, ends, least, exponent):
                where[row].append((lo, hi))
            runs, left = [], []
            for row, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
                text = (text or b"").split()  # at the white space of ASCII
                found = runs_of(text, where[row], least, exponent) if row in where else []
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                left.append(collapsed(text, found))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(ends), pa.int64()), pa.array(runs, RUNS), pa.array(left, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(id_col, n_words, runs, collapsed): each text's runs as (start, length, period) in words, and the text without what they repeat."""
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    small_batches(df.sparkSession)
    x = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = x.schema["id"].dataType.simpleString()
    out = x.mapInArrow(_found(least, exponent), f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.toDF(id_col, *free(df.select(id_col), "n_words", "runs", "collapsed"))


def op11(df: DataFrame) -> DataFrame:
    """The digest of the contract: the texts, of which some are rewritten to repeat a period, their runs, and what is left. An id that is
    null rewrites nothing."""
    x = df.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    x = x.withColumn("w", F.when(F.col("h") % 10 == 0, split_words(F.col("text"))))
    x = x.withColumn("g", F.expr("h div 10")).withColumn("n", F.size("w"))
    x = x.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(w, (x, i) -> if(i >= a, get(w, int(a + (i - a) % p)), x)), ' ')")
    found = periodic_runs(x.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text")))
    best = F.expr("array_sort(runs, (x, y) -> int(sign(y.length * x.period - x.length * y.period) * 4 + sign(x.start - y.start) * 2 + sign(x.period - y.period)))[0]")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
