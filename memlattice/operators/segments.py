"""Products over compressed rows by segmented reduction.

The layout's positions are cut into blocks, and each block is summed by itself, in order of position, whichever rows lie in it. Each
block hands on one sum for each row in it, and these are added up by row: a row inside one block has one, a row that crosses into others
(or into another batch of its block) several. So no exchange deals entries by their rows, and a row of any length is spread over the
blocks it covers. The marker in front of each row, where its pointer points, is a term of zero: empty rows need no case of their own.
The sums are read once: where batches end may differ between two readings of the same blocks, so nothing may depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .formats import CompressedRows
from .layout import div
from .matrix import Gathered

#: Positions of a block, rows' markers among them.
BLOCK = 1 << 18

SUMS = "i long, s double"


def _segments(block: int) -> Callable:
    """(i, s): the sums of each block's rows, from terms (p, i, s) in order of position, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, i, s = (batch.column(c).to_numpy() for c in ("p", "i", "s"))
            begins = np.concatenate(([True], p[1:] // block != p[:-1] // block))
            starts = np.flatnonzero(begins | np.concatenate(([True], i[1:] != i[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(i[starts]), pa.array(np.add.reduceat(s, starts))], ["i", "s"])

    return run


def spmv_compressed(c: CompressedRows, x: DataFrame, y0: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(i, y) with y = y0 + A x, from the positions of a layout; padding is read as the entries that it is."""
    m = c.matrix
    ship(m.spark)
    read = Gathered(m, x)
    terms = read.join(c.entries.select("k", "i", "j", "a")).select((F.col("k") + F.col("i") + 1).alias("p"), F.col("i").cast("long").alias("i"), (F.col("a") * F.col("v")).alias("s"))
    marks = c.ptr.where(F.col("r") < m.rows).select((F.col("ptr") + F.col("r")).alias("p"), F.col("r").cast("long").alias("i"), F.lit(0.0).alias("s"))
    dealt = terms.unionByName(marks).withColumn("block", div(F.col("p"), block)).repartition("block").sortWithinPartitions("p").drop("block")
    y = dealt.mapInArrow(_segments(block), SUMS).groupBy("i").agg(F.sum("s").alias("y"))
    if y0 is not None:
        y = y.join(y0.select(F.col("idx").alias("i"), F.col("v").alias("y0")), "i", "left").select("i", (F.coalesce("y0", F.lit(0.0)) + F.col("y")).alias("y"))
    return read.whole(y)
