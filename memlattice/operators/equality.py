"""Whether two frames hold the same rows, by fingerprints.

A fingerprint is the number of rows and the sums of two 64-bit hashes of each, so neither order nor partitioning counts, and repeated rows
do. It takes one pass over each frame and no exchange but of one row a task. Different frames of equal fingerprints are as likely as
two equal draws of 128 bits. Only where fingerprints differ rows are compared, to name a difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> tuple:
    """(rows, sum, other sum) of a frame; columns count by name, whatever their order."""
    names = sorted(df.columns)
    nulls = sum((F.when(F.col(c).isNull(), F.lit(1 << k).cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")) for k, c in enumerate(names[:60])), F.lit(0).cast("decimal(38,0)"))
    columns = [*(F.col(c) for c in names), nulls.cast("string")]  # null leaves a hash as it is
    first, second = (F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)") for seed in ("one", "two"))
    return tuple(df.agg(F.count("*"), F.coalesce(F.sum(first), F.lit(0)), F.coalesce(F.sum(second), F.lit(0))).first())


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal columns, by name and type, and equal rows, as often as they occur."""
    if sorted(a.dtypes) != sorted(b.dtypes):
        return False
    return fingerprint(a) == fingerprint(b)


def first_difference(a: DataFrame, b: DataFrame, by: list[str]) -> tuple | None:
    """(side, row): the first row by some columns that one side has more often than the other; None if they are the same."""
    if same_rows(a, b):
        return None
    b = b.select(*a.columns)
    sides = a.exceptAll(b).withColumn("_side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("_side", F.lit("right")))
    r = sides.orderBy(*by, "_side").first()
    return (r["_side"], tuple(r[c] for c in a.columns)) if r else None
