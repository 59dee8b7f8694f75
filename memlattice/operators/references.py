"""Memory reference streams: what each thread of a kernel touches, in order.

A stream's row is (thread, t, array, idx, addr, domain). Every reference's place t has a closed form over the entry or
row it belongs to, so a stream is one explode over the layout's frames, without any sequential pass. Threads own blocks of
ceil(n / threads) entries or rows; a page of a shared vector belongs to the thread that owns its first element.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import KernelError
from . import formats, matrix, segments
from .layout import INDEX_SIZE, VALUE_SIZE, Addresses, block, div, owner
from .matrix import SparseMatrix


@dataclass(frozen=True)
class Threads:
    """How many threads there are and each one's NUMA domain."""

    domains: tuple[int, ...]

    @property
    def n(self) -> int:
        return len(self.domains)

    def domain(self, thread: Column) -> Column:
        return F.element_at(F.array(*(F.lit(d) for d in self.domains)), (thread + 1).cast("int"))


def _emit(df: DataFrame, addresses: Addresses, parts: list[tuple[Column, str, Column, Column]]) -> DataFrame:
    """df has a thread; each part gives t, array, index and domain of one reference per row."""
    one = [F.struct(t.cast("long").alias("t"), F.lit(name).alias("array"), idx.cast("long").alias("idx"), addresses.of(name, idx).alias("addr"), dom.cast("int").alias("domain")) for t, name, idx, dom in parts]
    return df.select(F.col("thread").cast("int").alias("thread"), F.explode(F.array(*one)).alias("r")).select("thread", "r.*")


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Kernel:
    """What can be run and traced. Subclasses give a layout's references, its product and its description."""

    name = ""
    arrays: tuple[str, ...] = ()

    def references(self, threads: Threads) -> DataFrame:
        raise NotImplementedError

    def run(self, x: DataFrame | None = None, y0: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError

    def info(self) -> dict:
        raise NotImplementedError


class Triad(Kernel):
    name = "triad"

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n = spark, n

    def references(self, threads: Threads) -> DataFrame:
        a = Addresses().add("a", self.n, VALUE_SIZE).add("b", self.n, VALUE_SIZE).add("c", self.n, VALUE_SIZE)
        c = block(self.n, threads.n)
        k = F.col("id")
        x = self.spark.range(self.n).withColumn("thread", div(k, c))
        own, t = threads.domain(F.col("thread")), 3 * (k - F.col("thread") * c)
        return _emit(x, a, [(t, "b", k, own), (t + 1, "c", k, own), (t + 2, "a", k, own)])

    def run(self, x=None, y0=None) -> DataFrame:
        return matrix.triad(self.spark, self.n)

    def info(self) -> dict:
        return {"name": self.name, "num_entries": str(self.n)}


class SpmvKernel(Kernel):
    def __init__(self, m: SparseMatrix, path: str = ""):
        self.m, self.path = m, path

    def _vectors(self, a: Addresses) -> Addresses:
        return a.add("x", self.m.columns, VALUE_SIZE).add("y", self.m.rows, VALUE_SIZE)

    def _x_domain(self, threads: Threads, j: Column) -> Column:
        return threads.domain(owner(j, self.m.columns, VALUE_SIZE, threads.n))

    def run(self, x=None, y0=None) -> DataFrame:
        return matrix.spmv(self.m, x if x is not None else matrix.ones(self.m.spark, self.m.columns), y0, self.entries())

    def entries(self) -> DataFrame:
        return self.m.entries

    def _sizes(self, kind: str) -> int:
        return formats.storage(self.m).where(F.col("format") == kind).first()["size"]

    def info(self) -> dict:
        kind = self.name.split("-")[0]
        return {
            "name": f"{self.name}-spmv", "matrix_path": self.path, "matrix_format": self.name, "rows": self.m.rows, "columns": self.m.columns,
            "nonzeros": self.m.num_entries(), "matrix_size": self._sizes(kind), "x_size": self.m.columns * VALUE_SIZE, "y_size": self.m.rows * VALUE_SIZE,
        }

    def _coo_part(self, entries: DataFrame, n: int, threads: Threads, a: Addresses, prefix: str, base: Column) -> DataFrame:
        """Entries and then the reduction of the workspace, row by row; base: where the part begins, by thread."""
        m, c, rc = self.m, block(n, threads.n), block(self.m.rows, threads.n)
        k, i, j, thread = F.col("k"), F.col("i"), F.col("j"), F.col("thread")
        own = threads.domain(thread)
        e = entries.withColumn("thread", div(k, c))
        t = base + 5 * (k - thread * c)
        first = _emit(e, a, [
            (t, f"{prefix}row_index", k, own), (t + 1, f"{prefix}column_index", k, own), (t + 2, f"{prefix}value", k, own),
            (t + 3, "x", j, self._x_domain(threads, j)), (t + 4, "workspace", thread * m.rows + i, own),
        ])
        rows = m.spark.range(m.rows).select(F.col("id").alias("i")).withColumn("thread", div(i, rc))
        rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(threads.n - 1))))
        upto = lambda z: F.least(F.lit(n).cast("long"), z * c)
        start = thread * rc
        t = base + 5 * (upto(thread + 1) - upto(thread)) + 2 * ((i - start) * threads.n + F.col("q"))
        # the owner is looked up in an array of threads * (rows of this thread) elements, shorter than the real one for the last block
        length = threads.n * (F.least(F.lit(m.rows).cast("long"), start + rc) - start)
        at = F.col("q") * m.rows + i
        return _union(first, _emit(rows, a, [(t, "workspace", at, threads.domain(owner(at, length, VALUE_SIZE, threads.n))), (t + 1, "y", i, own)]))

    def _ell_part(self, slots: DataFrame, width: int, threads: Threads, a: Addresses, prefix: str) -> DataFrame:
        rc = block(self.m.rows, threads.n)
        i, col_l, j, thread = F.col("i"), F.col("l"), F.col("j"), F.col("thread")
        own = threads.domain(thread)
        s = slots.withColumn("thread", div(i, rc))
        t = (i - thread * rc) * (3 * width + 1) + 3 * col_l
        at = i * width + col_l
        first = _emit(s, a, [(t, f"{prefix}column_index", at, own), (t + 1, f"{prefix}value", at, own)])
        gather = _emit(s.where(j < matrix.INT_MAX), a, [(t + 2, "x", j, self._x_domain(threads, j))])
        rows = self.m.spark.range(self.m.rows).select(F.col("id").alias("i")).withColumn("thread", div(i, rc))
        return _union(first, gather, _emit(rows, a, [((i - thread * rc) * (3 * width + 1) + 3 * width, "y", i, own)]))


class Coo(SpmvKernel):
    name = "coo"

    def references(self, threads: Threads) -> DataFrame:
        n = self.m.num_entries()
        a = self._vectors(Addresses().add("row_index", n, INDEX_SIZE).add("column_index", n, INDEX_SIZE).add("value", n, VALUE_SIZE))
        a.add("workspace", threads.n * self.m.rows, VALUE_SIZE)
        return self._coo_part(self.m.entries, n, threads, a, "", F.lit(0).cast("long"))


class CooAtomic(SpmvKernel):
    name = "coo-atomic"

    def references(self, threads: Threads) -> DataFrame:
        n = self.m.num_entries()
        a = self._vectors(Addresses().add("row_index", n, INDEX_SIZE).add("column_index", n, INDEX_SIZE).add("value", n, VALUE_SIZE))
        c = block(n, threads.n)
        k, i, j, thread = F.col("k"), F.col("i"), F.col("j"), F.col("thread")
        own, t = threads.domain(thread), 5 * (k - thread * c)
        return _emit(self.m.entries.withColumn("thread", div(k, c)), a, [
            (t, "row_index", k, own), (t + 1, "column_index", k, own), (t + 2, "value", k, own), (t + 3, "x", j, self._x_domain(threads, j)),
            (t + 4, "y", i, threads.domain(owner(i, self.m.rows, VALUE_SIZE, threads.n))),
        ])


class Csr(SpmvKernel):
    name = "csr"

    def __init__(self, m: SparseMatrix, path: str = "", layout: formats.CompressedRows | None = None):
        super().__init__(m, path)
        self._layout = layout

    def _sizes(self, kind: str) -> int:
        return formats.storage(self.m, self._layout.row_alignment if self._layout else 1).where(F.col("format") == "csr").first()["size"]

    @property
    def layout(self) -> formats.CompressedRows:
        if self._layout is None:
            self._layout = formats.csr(self.m)
        return self._layout

    def run(self, x=None, y0=None) -> DataFrame:
        """By segmented reduction over the layout."""
        return segments.spmv_compressed(self.layout, x if x is not None else matrix.ones(self.m.spark, self.m.columns), y0)

    def references(self, threads: Threads) -> DataFrame:
        c, rows = self.layout, self.m.rows
        rc = block(rows, threads.n)
        bounds = sorted({min(rows, t * rc) for t in range(threads.n)} | {rows})
        at = {r["r"]: r["ptr"] for r in c.ptr.where(F.col("r").isin(bounds)).collect()}  # one per thread
        n = at[rows]
        a = self._vectors(Addresses().add("row_ptr", rows + 1, INDEX_SIZE).add("column_index", n, INDEX_SIZE).add("value", n, VALUE_SIZE))
        first = F.array(*(F.lit(at[min(rows, t * rc)]).cast("long") for t in range(threads.n)))
        i, k, j, thread = F.col("i"), F.col("k"), F.col("j"), F.col("thread")
        start, p0, own = thread * rc, F.element_at(first, (thread + 1).cast("int")), threads.domain(thread)
        e = c.entries.withColumn("thread", div(i, rc))
        t = 2 + 2 * (i - start) + 3 * (k - p0)
        walked = _emit(e, a, [(t, "column_index", k, own), (t + 1, "value", k, own), (t + 2, "x", j, self._x_domain(threads, j))])
        r, ptr = F.col("r"), F.col("ptr")
        enter = c.ptr.where(r < rows).withColumn("thread", div(r, rc))
        entered = _emit(enter, a, [(1 + 2 * (r - start) + 3 * (ptr - p0), "row_ptr", r + 1, own)])
        leave = c.ptr.where(r > 0).select((r - 1).alias("r"), "ptr").withColumn("thread", div(r, rc))
        left = _emit(leave, a, [(2 + 2 * (r - start) + 3 * (ptr - p0), "y", r, own)])
        begun = self.m.spark.range(threads.n).select(F.col("id").alias("thread"), F.least(F.lit(rows).cast("long"), F.col("id") * rc).alias("r"))
        return _union(_emit(begun, a, [(F.lit(0), "row_ptr", r, own)]), entered, walked, left)


class Ell(SpmvKernel):
    name = "ell"

    def __init__(self, m: SparseMatrix, path: str = "", skip_padding: bool = False):
        super().__init__(m, path)
        self.slots, self.width = formats.ell(m, skip_padding)

    def entries(self) -> DataFrame:
        return self.slots.where(F.col("j") < matrix.INT_MAX)

    def references(self, threads: Threads) -> DataFrame:
        n = self.m.rows * self.width
        a = self._vectors(Addresses().add("column_index", n, INDEX_SIZE).add("value", n, VALUE_SIZE))
        return self._ell_part(self.slots, self.width, threads, a, "")


class Hybrid(SpmvKernel):
    name = "hybrid"

    def __init__(self, m: SparseMatrix, path: str = ""):
        super().__init__(m, path)
        self.slots, self.over, self.width = formats.hybrid(m)

    def entries(self) -> DataFrame:
        return self.slots.select("i", "j", "a").unionByName(self.over.select("i", "j", "a"))

    def references(self, threads: Threads) -> DataFrame:
        n, e, rows = self.m.rows * self.width, self.over.count(), self.m.rows
        a = Addresses().add("ell_column_index", n, INDEX_SIZE).add("ell_value", n, VALUE_SIZE)
        a.add("coo_row_index", e, INDEX_SIZE).add("coo_column_index", e, INDEX_SIZE).add("coo_value", e, VALUE_SIZE)
        a = self._vectors(a).add("workspace", threads.n * rows, VALUE_SIZE)
        rc, thread = block(rows, threads.n), F.col("thread")
        upto = lambda z: F.least(F.lit(rows).cast("long"), z * rc)
        base = (upto(thread + 1) - upto(thread)) * (3 * self.width + 1)
        return _union(self._ell_part(self.slots, self.width, threads, a, "ell_"), self._coo_part(self.over, e, threads, a, "coo_", base))

    def info(self) -> dict:
        n = self.over.count()
        return super().info() | {"ell_row_length": self.width, "num_ell_entries": self.m.rows * self.width, "num_coo_entries": n}


class VendorCsr(Csr):
    """Runs like compressed rows, on square matrices only and without adding to y; has no reference stream."""

    name = "mkl-csr"

    def run(self, x=None, y0=None) -> DataFrame:
        if self.m.rows != self.m.columns:
            raise KernelError(f"{self.path}: a square matrix is needed")
        return super().run(x)

    def references(self, threads: Threads) -> DataFrame:
        raise KernelError("Not implemented")


#: By the names of the command line.
KERNELS = {"coo": Coo, "coo-atomic": CooAtomic, "csr": Csr, "ell": Ell, "hybrid": Hybrid, "mkl-csr": VendorCsr}
