"""Layouts of a matrix: compressed rows, ELLPACK and hybrid.

All follow from one range sort: the entries together with a marker in front of each row. A marker's position less its row
number is the row's start, an entry's position less the markers up to it is its place in row-major order, and empty rows
need no special case. Where padding repeats the column read last, that is the entry just before the row's end, found by
an equi-join on the position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MatrixError
from ..session import materialize
from .equality import same_rows
from .matrix import INT_MAX, SparseMatrix
from .position import positioned


@dataclass(frozen=True)
class CompressedRows:
    """entries: (k, i, j, a, is_pad) in row-major order; ptr: (r, ptr) for r = 0..rows."""

    matrix: SparseMatrix
    entries: DataFrame
    ptr: DataFrame
    row_alignment: int = 1


def same_layout(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames of a layout (row pointers, entries, slots) hold the same."""
    return same_rows(a, b)


def csr(matrix: SparseMatrix, row_alignment: int = 1) -> CompressedRows:
    """Rows are padded to a multiple of the alignment with column 0 and value 0."""
    e = matrix.entries.select("i", "j", F.col("k").alias("o"), "a", F.lit(1).alias("kind"))
    if row_alignment > 1:
        al = F.lit(row_alignment)
        pads = matrix.row_lengths().select("i", F.pmod(-F.col("len"), al).alias("n")).where("n > 0")
        pads = pads.select("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("o"))
        e = e.unionByName(pads.select("i", F.lit(0).alias("j"), "o", F.lit(0.0).alias("a"), F.lit(2).alias("kind")))
    marks = matrix.spark.range(matrix.rows + 1).select(F.col("id").alias("i"), F.lit(-1).alias("j"), F.lit(-1).cast("long").alias("o"), F.lit(None).cast("double").alias("a"), F.lit(0).alias("kind"))
    p = positioned(e.unionByName(marks), ["i", "kind", "j", "o"], "p")  # written already
    entries = p.where("kind > 0").select((F.col("p") - F.col("i") - 1).alias("k"), "i", F.col("j").cast("long").alias("j"), "a", (F.col("kind") == 2).alias("is_pad"))
    return CompressedRows(matrix, entries, p.where("kind = 0").select(F.col("i").alias("r"), (F.col("p") - F.col("i")).alias("ptr")), row_alignment)


def _ends(c: CompressedRows) -> DataFrame:
    """(i, start, len, last): last is the column of the last entry at or before the row's end, 0 if there is none."""
    nxt = c.ptr.select((F.col("r") - 1).alias("i"), F.col("ptr").alias("stop"))
    rows = c.ptr.select(F.col("r").alias("i"), F.col("ptr").alias("start")).join(nxt, "i")
    # the entry before a row's end is the last one of its own or an earlier row: one a row is exchanged, not all entries
    last = c.entries.groupBy("i").agg(F.max("k").alias("k"), F.max_by("j", "k").alias("last")).select((F.col("k") + 1).alias("stop"), "last")
    return rows.join(last, "stop", "left").select("i", "start", (F.col("stop") - F.col("start")).alias("len"), F.coalesce("last", F.lit(0)).alias("last"))


def _slots(c: CompressedRows, width: int, skip_padding: bool) -> DataFrame:
    """(i, l, j, a, is_pad): each row's first `width` entries, filled up."""
    ends = materialize(_ends(c))
    real = c.entries.join(ends.select("i", "start"), "i").select("i", (F.col("k") - F.col("start")).alias("l"), "j", "a", F.lit(False).alias("is_pad")).where(F.col("l") < width)
    pads = ends.where(F.col("len") < width).select("i", "last", F.explode(F.sequence(F.col("len"), F.lit(width - 1))).alias("l"))
    pad_column = F.lit(INT_MAX).cast("long") if skip_padding else F.col("last")
    return real.unionByName(pads.select("i", "l", pad_column.alias("j"), F.lit(0.0).alias("a"), F.lit(True).alias("is_pad")))


def _fits(n: int, what: str) -> None:
    if n > INT_MAX:
        raise MatrixError(f"Failed to convert to {what}: {n} slots are more than 32-bit positions can number")


def ell(matrix: SparseMatrix, skip_padding: bool = False) -> tuple[DataFrame, int]:
    """(i, l, j, a, is_pad) slots and the row length L, the longest row's. Slot (i, l) is at position i * L + l."""
    width = matrix.max_row_length().first()[0]
    _fits(matrix.rows * width, "ELLPACK")
    return _slots(csr(matrix), width, skip_padding), width


def hybrid_width(matrix: SparseMatrix) -> DataFrame:
    """One row: the least L that at least (2 * rows) div 3 rows don't exceed; 0 when that threshold is 0."""
    h = matrix.row_length_histogram()
    # lengths that occur are few beside the rows: the running sum is over those
    from pyspark.sql import Window

    upto = F.sum("rows").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0))
    need = (2 * matrix.rows) // 3
    return h.select("len", upto.alias("upto")).where(F.col("upto") >= need).agg(F.coalesce(F.when(F.lit(need > 0), F.min("len")), F.lit(0)).cast("long").alias("ell_row_length"))


def hybrid(matrix: SparseMatrix, skip_padding: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """ELL slots (i, l, j, a, is_pad), overflow entries (k, i, j, a) and the ELL row length."""
    width = hybrid_width(matrix).first()[0]
    _fits(matrix.rows * width, "HYBRID")
    c = csr(matrix)
    starts = c.ptr.select(F.col("r").alias("i"), F.col("ptr").alias("start"))
    over = c.entries.join(starts, "i").where(F.col("k") - F.col("start") >= width).select("i", "j", "a", F.col("k").alias("row_major"))
    over = positioned(over, ["row_major"], "k").select("k", "i", "j", "a")
    slots = _slots(c, width, skip_padding) if width else c.entries.select("i", F.col("k").alias("l"), "j", "a", "is_pad").limit(0)
    return slots, over, width


def _aligned(length: Column, row_alignment: int) -> Column:
    return F.ceil(length / row_alignment).cast("long") * row_alignment if row_alignment > 1 else length


def storage(matrix: SparseMatrix, row_alignment: int = 1) -> DataFrame:
    """(format, entries, padding, value_size, index_size, size, value_padding_size, index_padding_size) of each layout.

    Indices take 4 bytes, values 8. The hybrid layout's index size leaves out the overflow's row indices, as the layout
    it follows reports it. Compressed rows are aligned as given; what that adds counts as entries, not as padding.
    """
    n = matrix.entries.agg(F.count("*").alias("nnz"))
    if row_alignment > 1:
        n = n.crossJoin(matrix.row_lengths().agg(F.coalesce(F.sum(_aligned(F.col("len"), row_alignment)), F.lit(0)).alias("csr")))
    else:
        n = n.withColumn("csr", F.col("nnz"))
    longest = matrix.max_row_length()
    width = hybrid_width(matrix)
    over = matrix.row_lengths().crossJoin(F.broadcast(width)).agg(F.coalesce(F.sum(F.greatest(F.col("len") - F.col("ell_row_length"), F.lit(0))), F.lit(0)).alias("coo"))
    one = n.crossJoin(longest).crossJoin(width).crossJoin(over)  # one row each
    rows = F.lit(matrix.rows).cast("long")
    ell_slots, hyb_slots = rows * F.col("max_row_length"), rows * F.col("ell_row_length")
    zero = F.lit(0).cast("long")

    def of(name, slots, index, padding):
        return F.struct(F.lit(name).alias("format"), slots.alias("entries"), padding.alias("padding"), (slots * 8).alias("value_size"), index.alias("index_size"))

    kinds = F.array(
        of("coo", F.col("nnz"), F.col("nnz") * 8, zero),
        of("csr", F.col("csr"), (rows + 1) * 4 + F.col("csr") * 4, zero),
        of("ell", ell_slots, ell_slots * 4, ell_slots - F.col("nnz")),
        of("hybrid", hyb_slots + F.col("coo"), (hyb_slots + F.col("coo")) * 4, hyb_slots + F.col("coo") - F.col("nnz")),
    )
    x = one.select(F.explode(kinds).alias("s")).select("s.*")
    return x.withColumn("size", F.col("value_size") + F.col("index_size")).withColumn("value_padding_size", F.col("padding") * 8).withColumn("index_padding_size", F.col("padding") * 4)


def rows_per_thread(matrix: SparseMatrix, threads: int) -> DataFrame:
    """(thread, rows): blocks of ceil(rows / threads); idle threads have 0."""
    c = -(-matrix.rows // threads) if matrix.rows else 0
    t = F.col("id")
    lo, hi = F.least(F.lit(matrix.rows), t * c), F.least(F.lit(matrix.rows), (t + 1) * c)
    return matrix.spark.range(threads).select(t.cast("int").alias("thread"), (hi - lo).cast("long").alias("rows"))


def nonzeros_per_thread(matrix: SparseMatrix, threads: int, row_alignment: int = 1) -> DataFrame:
    """(thread, csr, ell, hybrid): entries each thread works on, by layout, those that align rows included; the hybrid count
    leaves out the overflow."""
    c = max(1, -(-matrix.rows // threads))
    lengths = matrix.entries.groupBy("i").agg(F.count("*").alias("len"))
    n = lengths.groupBy(F.floor(F.col("i") / c).cast("int").alias("thread")).agg(F.sum(_aligned(F.col("len"), row_alignment)).alias("csr"))
    widths = matrix.max_row_length().crossJoin(hybrid_width(matrix))  # one row each
    x = rows_per_thread(matrix, threads).join(n, "thread", "left").crossJoin(F.broadcast(widths))
    return x.select("thread", F.coalesce("csr", F.lit(0)).cast("long").alias("csr"), (F.col("rows") * F.col("max_row_length")).alias("ell"), (F.col("rows") * F.col("ell_row_length")).alias("hybrid"))
