"""Quality by importance resampling.

Two generative models of hashed word n-grams (one and two words) are counted: one over target texts, one over all raw texts.
Their table of buckets grows with the corpus as its vocabulary does, with the root of the texts' bytes, and not below a least
size; it is broadcast as one float a bucket, so its size is known beforehand: 3 MB at 30 GB, 160 MB at 100 TB. A
document's weight is the log of the ratio of its likelihoods; adding Gumbel noise, drawn by a hash of
seed and id, and taking the k largest is sampling k documents without replacement in proportion to the weights.

The k-th largest key is found without sorting: histograms of ever narrower ranges, of a bounded number of bins each, lead
to it. Raw counts cover every document; target texts are those labelled good, at most `fit_labels` of them. k is the share
of good ones among the labelled, of all documents, unless given.

Null and empty texts have no n-grams and weight 0; a text of any length is counted whole. Rows with the same id, or with none,
share their noise. If the border falls among equal keys (ties), those with the larger hash of their id are taken, and of
equal rows of one id as many as are still needed: exactly k rows are selected, whatever the type of the id. Without target
texts all weights are 0. Input columns other than id, text and target are not read, so none clashes; an id column that is
called like an output column makes that one take a free name. Of an empty table the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialize
from .common import free, small_batches

#: The least number of buckets, and how many there are for each unit of the root of the texts' bytes.
BUCKETS = 1 << 16
BUCKETS_BY_ROOT = 4
#: n-grams that a worker holds before it counts them.
HELD = 1 << 21
#: Words whose hash codes a worker remembers.
REMEMBERED = 200_000
_codes: dict[bytes, int] = {}


def _crc(word: bytes) -> int:
    from zlib import crc32

    return crc32(word)


def buckets(text: str | None, n_buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's n-grams, repeats included."""
    words = (text or "").lower().encode().split()
    if not words:
        return np.zeros(0, np.int64)
    known = _codes
    for w in set(words).difference(known):
        known[w] = _crc(w)
    one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(known) > REMEMBERED:
        known.clear()
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    mix = np.concatenate((one * np.uint64(0xD6E8FEB86659FD93), two * np.uint64(0xA0761D6478BD642F)))
    return (mix >> np.uint64(32)).astype(np.int64) % n_buckets


def table_size(df: DataFrame, text: str) -> int:
    """How many buckets the n-grams of these texts are hashed into."""
    n_bytes = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(BUCKETS, BUCKETS_BY_ROOT * isqrt(n_bytes))


def _counts(n_buckets: int, most: int = HELD):
    def summed(raw: list[np.ndarray], aim: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(raw), return_counts=True)
        hit, m = np.unique(np.concatenate(aim), return_counts=True) if aim else (at[:0], n[:0])
        aims = np.zeros(len(at), np.int64)
        aims[np.searchsorted(at, hit)] = m
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64)), pa.array(aims)], ["bucket", "raw", "aim"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(target, text) -> (bucket, raw, aim), counted whenever so many n-grams are held: memory doesn't grow with the table."""
        raw, aim, held = [], [], 0
        for batch in batches:
            for target, text in zip(batch.column(0), batch.column(1)):
                found = buckets(text.as_py(), n_buckets)
                raw.append(found)
                held += len(found)
                if target.as_py():
                    aim.append(found)
                if held >= most:
                    yield summed(raw, aim)
                    raw, aim, held = [], [], 0
        if held:
            yield summed(raw, aim)

    return counted


def fit(df: DataFrame, text: str, target: str, n_buckets: int = BUCKETS) -> np.ndarray:
    """log(target share / raw share) of each bucket; target: a boolean column."""
    small_batches(df.sparkSession)
    x = df.select(F.coalesce(F.col(target), F.lit(False)).alias("t"), F.col(text).alias("x"))
    counts = materialize(x.mapInArrow(_counts(n_buckets), "bucket long, raw long, aim long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("aim").alias("aim")))
    raw, aim = counts.agg(F.sum("raw"), F.sum("aim")).first()
    out = np.zeros(n_buckets, np.float32)
    if aim:
        # smoothed by the raw shares: a bucket the target sample never shows is rare there, not impossible
        weight = 0.002 * aim
        share = F.col("raw") / F.lit(float(raw))
        ratio = (F.col("aim") + F.lit(weight) * share) / F.lit(aim + weight) / share
        rows = counts.select(F.col("bucket").cast("int").alias("bucket"), F.log(ratio).cast("float").alias("ratio")).toArrow()
        out[rows["bucket"].to_numpy()] = rows["ratio"].to_numpy()
    discard(counts)
    return out


def weigher(df: DataFrame, log_ratio: np.ndarray):
    """A column function: text -> log weight."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(log_ratio)

    @F.arrow_udf(T.DoubleType())
    def weigh(texts: pa.Array) -> pa.Array:
        table = shared.value
        return pa.array([float(table[buckets(x.as_py(), len(table))].sum(dtype=np.float64)) for x in texts], pa.float64())

    return weigh


def kth(df: DataFrame, column: str, k: int, bins: int = 1024, most_rounds: int = 80) -> tuple[float, int, int]:
    """The k-th largest value of a numeric column, 1 <= k <= rows; how many of the rows that have it are among the k; how many
    have it. Each round counts the rows of a range in equal bins."""
    c = F.col(column)
    lo, hi, n = df.agg(F.min(c), F.max(c), F.count(c)).first()
    need = k
    for _ in range(most_rounds):
        if lo == hi:
            return lo, need, n
        bin_ = F.least(F.floor((c - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
        rows = df.where(c.between(lo, hi)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).orderBy(F.desc("bin")).collect()
        for r in rows:
            if r["n"] >= need:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            need -= r["n"]
    raise RuntimeError(f"{column}: no border after {most_rounds} rounds")


def chosen(keyed: DataFrame, k: int, bins: int = 1024) -> Column:
    """keyed: (key, tie, place), place different for each row. Whether a row is one of the k with the largest (key, tie, place)."""
    n = keyed.count()
    if k <= 0 or k >= n:
        return F.lit(k > 0)
    out, need, rest = F.lit(False), k, keyed
    equal = F.lit(True)
    for column in ("key", "tie", "place"):
        at, need, n = kth(rest, column, need, bins)
        out = out | (equal & (F.col(column) > at))
        equal = equal & (F.col(column) == at)
        if need == n:
            break
        rest = rest.where(F.col(column) == at)
    return out | equal


def resample(df: DataFrame, target: str, k: int | None = None, share: float | None = None, id_col: str = "doc_id", text: str = "text", seed: int = 29, n_buckets: int | None = None) -> DataFrame:
    """(id, log_weight, key, selected) for each row; k documents, or that share of all, are selected."""
    log_ratio = fit(df, text, target, n_buckets or table_size(df, text))
    x = df.select(F.col(id_col).alias("id"), weigher(df, log_ratio)(F.col(text)).alias("log_weight"))
    noise = lambda what: F.pmod(F.xxhash64(F.lit(what), "id"), F.lit(1 << 52)).cast("double")
    gumbel = -F.log(-F.log((noise(seed) + 0.5) / float(1 << 52)))
    x = materialize(x.select("id", "log_weight", (F.col("log_weight") + gumbel).alias("key"), noise(seed + 1).alias("tie"), F.monotonically_increasing_id().alias("place")))
    if k is None:
        k = round(x.count() * (1.0 if share is None else share))
    x = x.select("id", "log_weight", "key", chosen(x, k).alias("selected"))
    return x.toDF(id_col, *free(df.select(id_col), "log_weight", "key", "selected"))


def op1(documents: DataFrame, labels: DataFrame, fit_labels: int = 50_000) -> DataFrame:
    """doc_id, log_weight, key and selected for every document; the target are documents labelled quality 1."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = good.agg(F.avg("quality")).first()[0]
    some = good.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_labels)
    x = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id", "left")
    x = x.withColumn(free(x, "target")[0], F.col("quality").isNotNull())
    return resample(x, "target", share=share)
