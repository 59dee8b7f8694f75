"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two that differ in at most two bits differ in at most two bytes, so their
count of shared positional bytes is at least six. An index of single (position, byte) postings would hold a 256th of all
fingerprints in each list; here a posting is a conjunction of such: the fingerprints that have the same bytes at several
positions. The first postings fix four bytes, six sets of them, so chosen that whichever two bytes differ, one set holds
neither. A posting of more than `dense` fingerprints is split by the next matching byte, and again: with four bytes fixed,
one of any three others still matches, with five one of the other three. With six fixed, two of the other four half-bytes
match, and with those fixed a posting has room for 256 fingerprints and no more. So no posting is long, no pair is lost, and
rows grow with the fingerprints, whatever the size of a cluster. For each pair that meets in a posting the shared positional
bytes are tallied, those of the posting and the rest; pairs under six are let go, the others are verified bit by bit.

Equal fingerprints are folded first. Null and empty texts have fingerprint zero and are linked like any other; a text of any
length is hashed in portions. Repeated rows each get a row. Of a component's documents with the least id (ties) all carry that
id. Null ids are kept; a component of null ids alone has a null component id. Input columns other than id and text are not
read, so none clashes; an id column that is called like an output column makes that one take a free name. Empty tables give
empty results.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ..session import discard, materialize
from .common import free, small_batches

SEED = 42
BYTES = 8
#: Half-bytes of a fingerprint that the first postings fix: those of the blocks 01 23 45 67, two at a time.
FIRST = tuple(frozenset(4 * b + k for b in pair for k in range(4)) for pair in combinations(range(4), 2))


def finer(fixed: frozenset) -> list[frozenset]:
    """The sets of half-bytes by which a posting is split; fingerprints at most two bits apart that share it share one of these."""
    left = [k for k in range(BYTES) if 2 * k not in fixed]
    if len(left) > 2:
        return [fixed | {2 * k, 2 * k + 1} for k in left[:3]]
    halves = sorted(set(range(2 * BYTES)) - fixed)
    return [fixed | set(pair) for pair in combinations(halves, 2)] if len(halves) == 4 else []


def bits(fixed: frozenset) -> int:
    """The bits of some half-bytes, as a signed number; the first half-byte is the highest."""
    return int.from_bytes(sum(15 << 4 * (2 * BYTES - 1 - k) for k in fixed).to_bytes(BYTES, "big"), "big", signed=True)


def simhash(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text: XXH64 of each shingle, a bit is set if it is in over half of them."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    stops = (ends - 1)[width - 1 :].tolist()
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(stops)
    starts = starts[:n].tolist()
    for at in range(0, n, 1 << 14):  # bounded memory for long texts
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 14)], stops[at : at + (1 << 14)])], np.dtype(">u8"))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


@F.arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """simhash() of each text as a signed 64-bit number."""
    return pa.array(np.array([simhash(x.as_py()) for x in texts], np.uint64).view(np.int64), pa.int64())


def _byte(c: Column, k: int) -> Column:
    return F.shiftrightunsigned(c, 8 * (7 - k)).bitwiseAND(F.lit(255).cast("long"))


def _posted(fps: DataFrame, masks: Column) -> DataFrame:
    """(fp, mask, key): the postings of each fingerprint."""
    return fps.select("fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def _masks(sets) -> Column:
    return F.array(*(F.lit(bits(s)).cast("long") for s in sets))


def _pairs(posted: DataFrame, max_bits: int) -> DataFrame:
    """posted: (fp, mask, key). The pairs that share a posting, enough positional bytes, and all but max_bits of their bits."""
    left, right = posted.select("mask", "key", F.col("fp").alias("a")), posted.select("mask", "key", F.col("fp").alias("b"))
    tally = sum((F.when(_byte(F.col("a"), k) == _byte(F.col("b"), k), 1).otherwise(0) for k in range(BYTES)), F.lit(0))
    pairs = left.join(right, ["mask", "key"]).where((F.col("a") < F.col("b")) & (tally >= BYTES - max_bits))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")


def links(fps: DataFrame, max_bits: int = 2, dense: int = 32) -> DataFrame:
    """fps: distinct (fp). Returns a written table (a, b): every pair at max_bits or fewer differing bits."""
    if max_bits != 2:
        raise ValueError("the postings are laid out for two differing bits")
    posted, fixed, found, tables = _posted(fps, _masks(FIRST)), set(FIRST), [], []
    while True:
        held = posted.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        posted = materialize(posted.join(held, ["mask", "key"]))
        tables.append(posted)
        split = {bits(s): finer(s) for s in fixed if finer(s)}
        if not split or posted.where(F.col("n") > dense).isEmpty():
            found.append(_pairs(posted, max_bits))
            break
        found.append(_pairs(posted.where(F.col("n") <= dense), max_bits))
        # postings that come from several longer ones are the same posting
        to = F.create_map(*(x for m, sets in split.items() for x in (F.lit(m).cast("long"), _masks(sets))))
        posted = _posted(posted.where(F.col("n") > dense).select("fp", "mask"), to[F.col("mask")]).distinct()
        fixed = {s for sets in split.values() for s in sets}
    out = materialize(reduce(DataFrame.unionByName, found).distinct())
    for x in tables:
        discard(x)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", dense: int = 32) -> DataFrame:
    """(id_col, fp, component): each row's fingerprint and the least id of its component."""
    small_batches(df.sparkSession)
    prints = materialize(df.select(F.col(id_col).alias("id"), fingerprint(F.col(text)).alias("fp")))
    fps = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")))
    linked = links(fps.select("fp"), dense=dense)
    roots = components(linked)
    joined = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = materialize(joined)
    for x in (linked, roots, fps):
        discard(x)
    ids = joined.groupBy("root").agg(F.min("least").alias("component"))
    named = joined.join(ids, "root").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component").toDF(id_col, *free(df.select(id_col), "fp", "component"))


def op2(df: DataFrame) -> DataFrame:
    """The digest of the contract."""
    return near_duplicates(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def stage(df: DataFrame) -> DataFrame:
    """One document of each component: the one with the least id. Of repeated rows of it one stays; rows with a null id all stay."""
    named = df.where(F.col("doc_id").isNotNull())
    keep = near_duplicates(named).where(F.col("doc_id") == F.col("component")).select("doc_id").distinct()
    # both by the id: the text is dealt out once for the join and the repeated rows
    return named.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(df.where(F.col("doc_id").isNull()))
