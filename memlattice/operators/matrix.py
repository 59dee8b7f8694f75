"""Sparse matrices as frames of entries, and products with vectors.

Entries are (k, i, j, a): position in file order, zero-based row and column, value. A product is an equi-join on the
column and a sum by row: partial sums on the map side do what per-thread workspaces do elsewhere, and AQE splits a column
that many entries share. Every product adds to y0, zero unless given, and has a row for each row of the matrix.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MatrixError
from .equality import fingerprint
from .position import positioned

INT_MAX = 2147483647


@dataclass(frozen=True)
class SparseMatrix:
    """entries: (k, i, j, a). The shape is part of the matrix: empty rows and columns have no entries. field and symmetry are
    those of the file it comes from."""

    entries: DataFrame
    rows: int
    columns: int
    field: str = "real"
    symmetry: str = "general"

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    def row_indices(self) -> DataFrame:
        return self.entries.select("k", "i")

    def column_indices(self) -> DataFrame:
        return self.entries.select("k", "j")

    def values_real(self) -> DataFrame:
        return self.entries.select("k", F.col("a").cast("double").alias("a"))

    def num_entries(self) -> int:
        return self.entries.count()

    def row_domain(self) -> DataFrame:
        return self.spark.range(self.rows).select(F.col("id").alias("i"))

    def row_lengths(self) -> DataFrame:
        """(i, len) for every row, empty ones too."""
        n = self.entries.groupBy("i").agg(F.count("*").alias("len"))
        return self.row_domain().join(n, "i", "left").select("i", F.coalesce("len", F.lit(0)).cast("long").alias("len"))

    def max_row_length(self) -> DataFrame:
        """One row; 0 for a matrix without entries."""
        return self.entries.groupBy("i").agg(F.count("*").alias("len")).agg(F.coalesce(F.max("len"), F.lit(0)).cast("long").alias("max_row_length"))

    def row_length_histogram(self) -> DataFrame:
        """(len, rows) for lengths that occur."""
        return self.row_lengths().groupBy("len").agg(F.count("*").alias("rows"))

    def bandwidth(self) -> DataFrame:
        """The largest distance from the diagonal; 0 without entries."""
        return self.entries.agg(F.coalesce(F.max(F.abs(F.col("i") - F.col("j"))), F.lit(0)).cast("long").alias("bandwidth"))

    def degrees(self) -> DataFrame:
        """(i, degree): off-diagonal entries of each row."""
        n = self.entries.where("i <> j").groupBy("i").agg(F.count("*").alias("degree"))
        return self.row_domain().join(n, "i", "left").select("i", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def expanded(self) -> SparseMatrix:
        """With the mirrored off-diagonal entries, for a file that stores one triangle; those of a skew-symmetric one have the other
        sign (of a hermitian one, the real parts are the same). Never done implicitly."""
        a = -F.col("a") if self.symmetry == "skew-symmetric" else F.col("a")
        both = self.entries.unionByName(self.entries.where("i <> j").select("k", F.col("j").alias("i"), F.col("i").alias("j"), a.alias("a")))
        n = max(self.rows, self.columns)
        return SparseMatrix(positioned(both.drop("k"), ["i", "j", "a"]), n, n, self.field)

    def sorted_row_major(self) -> DataFrame:
        """Entries with their position in (i, j) order; equal ones keep file order."""
        return positioned(self.entries.withColumnRenamed("k", "file_k"), ["i", "j", "file_k"], "k")

    def sorted_column_major(self) -> DataFrame:
        return positioned(self.entries.withColumnRenamed("k", "file_k"), ["j", "i", "file_k"], "k")

    def permuted(self, new_order: DataFrame) -> SparseMatrix:
        """Rows and columns renamed by new_order (old, new), two equi-joins. Only square real matrices are permuted, others stay as
        they are, with a warning. The order has to name each row once, and give each one a place of its own."""
        if self.rows != self.columns or self.field != "real":
            warnings.warn("only a square matrix of real values can be permuted: it stays as it is", stacklevel=2)
            return self
        inside = F.col("old").between(0, self.rows - 1) & F.col("new").between(0, self.rows - 1)
        n, old, new = new_order.agg(F.count(F.when(inside, 1)), F.count_distinct("old"), F.count_distinct("new")).first()
        if (n, old, new) != (self.rows,) * 3 or new_order.count() != n:
            raise MatrixError(f"the new order is not one of {self.rows} rows")
        rows = new_order.select(F.col("old").alias("i"), F.col("new").alias("new_i"))
        cols = new_order.select(F.col("old").alias("j"), F.col("new").alias("new_j"))
        e = self.entries.join(rows, "i").join(cols, "j").select("k", F.col("new_i").alias("i"), F.col("new_j").alias("j"), "a")
        return replace(self, entries=e)

    def same_as(self, other: SparseMatrix, tolerance: float = 2.220446049250313e-16) -> bool:
        """Equal shape, field and symmetry and, position by position, equal indices and values within the tolerance."""
        if (self.rows, self.columns, self.field, self.symmetry) != (other.rows, other.columns, other.field, other.symmetry):
            return False
        columns = ["k", "i", "j", "a"]
        if fingerprint(self.entries.select(*columns)) == fingerprint(other.entries.select(*columns)):
            return True
        o = other.entries.select("k", F.col("i").alias("oi"), F.col("j").alias("oj"), F.col("a").alias("oa"))
        differs = ~(F.col("i").eqNullSafe(F.col("oi")) & F.col("j").eqNullSafe(F.col("oj")) & (F.abs(F.col("a") - F.col("oa")) < tolerance))
        return self.entries.join(o, "k", "full").where(F.coalesce(differs, F.lit(True))).isEmpty()


def vector_faults(matrix: SparseMatrix, x: DataFrame) -> DataFrame:
    """(idx, values): where x is no vector for the matrix: columns without a value or with several, and places that are no column."""
    n = x.groupBy("idx").agg(F.count("*").alias("values"))
    places = matrix.spark.range(matrix.columns).select(F.col("id").alias("idx"))
    there = F.col("idx").between(0, matrix.columns - 1)
    lacking = places.join(n, "idx", "left_anti").select("idx", F.lit(0).cast("long").alias("values"))
    return n.where((F.col("values") > 1) | ~F.coalesce(there, F.lit(False))).select(F.col("idx").cast("long").alias("idx"), "values").unionByName(lacking)


def _refuse(*message: Column) -> Column:
    return F.raise_error(F.concat(*message)).cast("double")


class Gathered:
    """x as a product reads it: checked where it is read, in the product's own plan. Only what reads a wrong vector fails, when it runs."""

    def __init__(self, matrix: SparseMatrix, x: DataFrame):
        self.columns = matrix.columns
        self.x = x.groupBy(F.col("idx").alias("j")).agg(F.first("v").alias("v"), F.count("*").alias("n_values"))

    def join(self, entries: DataFrame) -> DataFrame:
        """entries (j, ...) with v. A column without a value, or with several, stops the product."""
        found = entries.join(self.x, "j", "left")
        n = F.coalesce("n_values", F.lit(0))
        v = F.when(n == 1, F.col("v")).otherwise(_refuse(F.lit("the vector has "), n.cast("string"), F.lit(" values for column "), F.col("j").cast("string")))
        return found.select(*entries.columns, v.alias("v"))

    def whole(self, y: DataFrame) -> DataFrame:
        """y (i, y), if x has one value for each column, those that no entry reads too, and no others."""
        inside = F.when(F.col("j").between(0, self.columns - 1), 1)
        one = self.x.agg(F.count(inside).alias("n_inside"), F.count("*").alias("n_places"), F.coalesce(F.sum("n_values"), F.lit(0)).alias("n_all"))
        fits = (F.col("n_inside") == self.columns) & (F.col("n_places") == self.columns) & (F.col("n_all") == self.columns)
        message = _refuse(F.lit(f"the matrix has {self.columns} columns, the vector "), F.col("n_all").cast("string"), F.lit(" values for "), F.col("n_inside").cast("string"), F.lit(" of them"))
        return y.crossJoin(F.broadcast(one)).select("i", F.when(fits, F.col("y")).otherwise(message).alias("y"))  # one row


def ones(spark: SparkSession, n: int, value: float = 1.0) -> DataFrame:
    """(idx, v) with one constant."""
    return spark.range(n).select(F.col("id").alias("idx"), F.lit(value).alias("v"))


def _accumulated(matrix: SparseMatrix, terms: DataFrame, term: Column, y0: DataFrame | None) -> DataFrame:
    sums = terms.groupBy("i").agg(F.sum(term).alias("s"))
    y = matrix.row_domain().join(sums, "i", "left")
    if y0 is None:
        return y.select("i", F.coalesce("s", F.lit(0.0)).alias("y"))
    y = y.join(y0.select(F.col("idx").alias("i"), F.col("v").alias("y0")), "i", "left")
    return y.select("i", (F.coalesce("y0", F.lit(0.0)) + F.coalesce("s", F.lit(0.0))).alias("y"))


def spmv(matrix: SparseMatrix, x: DataFrame, y0: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """(i, y) with y = y0 + A x. entries: another layout of A's entries, its padding included if it should count. x has a value for
    each column, or the product fails when it runs."""
    e = (matrix.entries if entries is None else entries).select("i", "j", "a")
    read = Gathered(matrix, x)
    return read.whole(_accumulated(matrix, read.join(e), F.col("a") * F.col("v"), y0))


def spmv_regular_traffic(matrix: SparseMatrix, y0: DataFrame | None = None) -> DataFrame:
    """y = y0 + the sum of each row's values: what a product reads without its gathers."""
    return _accumulated(matrix, matrix.entries, F.col("a"), y0)


def spmv_irregular_traffic(matrix: SparseMatrix, x: DataFrame, y0: DataFrame | None = None) -> DataFrame:
    """y = y0 + the sum of x at each row's columns: the gathers alone."""
    read = Gathered(matrix, x)
    return read.whole(_accumulated(matrix, read.join(matrix.entries.select("i", "j")), F.col("v"), y0))


def triad(spark: SparkSession, n: int, b: float = 0.0, c: float = 0.0, scale: float = 3.1) -> DataFrame:
    """(idx, a) with a = b + scale * c."""
    return spark.range(n).select(F.col("id").alias("idx"), (F.lit(b) + F.lit(scale) * F.lit(c)).alias("a"))


def inner(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.select("idx", F.col("v").alias("w")), "idx").agg(F.sum(F.col("v") * F.col("w")).alias("inner"))


def l2norm(x: DataFrame) -> DataFrame:
    return x.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l2norm"))


def combined(x: DataFrame, y: DataFrame, scale: float = 1.0) -> DataFrame:
    """(idx, v) with x + scale * y, of vectors of one length."""
    return x.join(y.select("idx", F.col("v").alias("w")), "idx").select("idx", (F.col("v") + F.lit(scale) * F.col("w")).alias("v"))


def scaled(x: DataFrame, scale: float) -> DataFrame:
    """(idx, v) with scale * x."""
    return x.select("idx", (F.lit(scale) * F.col("v")).alias("v"))
