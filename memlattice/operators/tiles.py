"""A matrix dealt out once for many products.

Entries lie in tiles: blocks of rows times columns dealt by hash. A tile's entries are in one bucket of a table, sorted as a product joins
them, so each product reads them where they lie. What moves is the vector, one copy of each value for every block of rows, and the partial
sums of each bucket. A column that most entries share is spread over the blocks of rows; a hot row over the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MatrixError
from ..session import discard, in_order, materialize, materialize_sorted
from .layout import div
from .matrix import Gathered, SparseMatrix, _accumulated

#: Blocks of rows: a vector has so many copies in a product.
ROW_BLOCKS = 4


class Tiles:
    """The tiles of a matrix, a table until discard()."""

    def __init__(self, m: SparseMatrix, buckets: int | None = None, row_blocks: int = ROW_BLOCKS):
        self.m, self.row_blocks = m, row_blocks
        self.buckets = buckets or int(m.spark.conf.get("spark.sql.shuffle.partitions"))
        self.rows_each = max(1, -(-m.rows // row_blocks))
        tile = div(F.col("i"), self.rows_each).cast("int").alias("ib")
        dealt = m.entries.select(tile, F.col("j").cast("long").alias("j"), F.col("i").cast("long").alias("i"), "a").repartition(self.buckets, "ib", "j")
        self.table = materialize_sorted(dealt, self.buckets, "ib", "j")

    def spmv(self, x: DataFrame, y0: DataFrame | None = None) -> DataFrame:
        """(i, y) with y = y0 + A x. Made and run within session.in_order(), the plan neither exchanges nor sorts the entries."""
        read = Gathered(self.m, x)
        blocks = F.explode(F.sequence(F.lit(0), F.lit(self.row_blocks - 1))).alias("ib")
        dealt = read.x.select(blocks, "j", "v", "n_values").repartition(self.buckets, "ib", "j")
        terms = self.table.join(dealt.hint("merge"), ["ib", "j"], "left")
        refused = F.raise_error(F.concat(F.lit("the vector has "), F.coalesce("n_values", F.lit(0)).cast("string"), F.lit(" values for column "), F.col("j").cast("string"))).cast("double")
        terms = terms.select("i", "a", F.when(F.col("n_values") == 1, F.col("v")).otherwise(refused).alias("v"))
        return read.whole(_accumulated(self.m, terms, F.col("a") * F.col("v"), y0))

    def power(self, x: DataFrame, k: int) -> DataFrame:
        """(i, y) with y = A(A(...x)), k times; a written table. Only the vectors move from one product to the next."""
        if self.m.rows != self.m.columns:
            raise MatrixError("only a square matrix can be applied to its own product")
        if k < 1:
            raise MatrixError("a power has one factor at least")
        y = None
        for _ in range(k):
            with in_order(self.m.spark):
                made = materialize(self.spmv(x))
            if y is not None:
                discard(y)
            y, x = made, made.select(F.col("i").alias("idx"), F.col("y").alias("v"))
        return y

    def discard(self) -> None:
        discard(self.table)
