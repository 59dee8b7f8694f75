import random
from dataclasses import replace

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from memlattice import session
from memlattice.errors import KernelError, MatrixError
from memlattice.operators import formats, matrix, references, segments, tiles
from memlattice.operators.matrix import INT_MAX, SparseMatrix

from .matrices import M6, M7, M8, M9, make, some, vector


def values(df):
    return [r["y"] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("m", [M6, M7, M8, M9])
@pytest.mark.parametrize("kernel", [references.Coo, references.CooAtomic, references.Csr, references.Ell, references.Hybrid])
def test_products(spark, m, kernel):
    a = make(spark, m)
    assert values(kernel(a).run(vector(spark, m[3]))) == m[4]


def test_product_adds_to_y(spark):
    y = matrix.spmv(make(spark, M6), vector(spark, M6[3]), vector(spark, [1, 1, 1, 1]))
    assert values(y) == [10, 3, 10, 8]


def test_traffic(spark):
    a = make(spark, M8)
    assert values(matrix.spmv_regular_traffic(a)) == [6, 5, 3, 3]
    assert values(matrix.spmv_irregular_traffic(a, vector(spark, M8[3]))) == [10, 7, 3, 4]


def test_vendor_kernel_needs_a_square_matrix_and_has_no_references(spark):
    k = references.VendorCsr(make(spark, M6))
    with pytest.raises(KernelError):
        k.run(vector(spark, M6[3]))
    with pytest.raises(KernelError):
        k.references(references.Threads((0,)))


def test_vectors_that_do_not_fit(spark):
    """A gap or a place named twice would be a wrong product, not an error, were it not refused when the product runs."""
    m = make(spark, (1, 3, [(0, 0, 1), (0, 2, 1)]))
    shifted = vector(spark, [1, 2, 3]).withColumn("idx", F.col("idx") + 1)
    twice = spark.createDataFrame([(0, 1.0), (0, 1.0), (2, 1.0)], "idx long, v double")
    unread = spark.createDataFrame([(0, 1.0), (2, 1.0)], "idx long, v double")
    for x, faults in ((vector(spark, [1, 2]), [(2, 0)]), (vector(spark, [1, 2, 3, 4]), [(3, 1)]), (shifted, [(0, 0), (3, 1)]), (twice, [(0, 2), (1, 0)]), (unread, [(1, 0)])):
        assert sorted(tuple(r) for r in matrix.vector_faults(m, x).collect()) == faults
        products = [matrix.spmv(m, x), matrix.spmv_irregular_traffic(m, x), references.Ell(m).run(x), references.Hybrid(m).run(x), references.Coo(m).run(x)]
        for product in (*products, references.Csr(m).run(x), tiles.Tiles(m, 2).spmv(x)):
            with pytest.raises((PySparkException, Py4JJavaError), match="the (vector|matrix) has"):
                product.collect()
    assert matrix.vector_faults(m, vector(spark, [1, 2, 3])).count() == 0


def test_compressed_rows_by_segments(spark):
    """Blocks of any size, rows longer than many blocks, empty rows, padding, and nothing dealt by its row but carries."""
    r = random.Random(2)
    for rows, long in ((5, 3), (40, 0), (1, 0)):
        entries = [(long if r.random() < 0.8 else r.randrange(rows), r.randrange(7), r.randint(-3, 3)) for _ in range(200)]
        m, x = make(spark, (rows, 7, entries)), [1, 2, 3, 4, 5, 6, 7]
        want = [sum(a * x[j] for i, j, a in entries if i == row) for row in range(rows)]
        for block in (1, 3, 64, 1 << 18):
            for align in (1, 4):
                assert values(segments.spmv_compressed(formats.csr(m, align), vector(spark, x), block=block)) == want
    assert values(segments.spmv_compressed(formats.csr(m), vector(spark, x), vector(spark, [10]))) == [10 + want[0]]


def test_row_ends_are_found_from_one_entry_a_row(spark):
    m = make(spark, (6, 9, [(1, j, 1) for j in (3, 1, 1)] + [(2, 5, 2), (4, 0, 3), (4, 8, 4)]))
    ends = formats._ends(formats.csr(m))
    assert sorted(tuple(x) for x in ends.collect()) == [(0, 0, 0, 0), (1, 0, 3, 3), (2, 3, 1, 5), (3, 4, 0, 5), (4, 4, 2, 8), (5, 6, 0, 8)]
    assert "max_by" in ends._jdf.queryExecution().optimizedPlan().toString()


def test_sums_do_not_depend_on_where_batches_end(spark):
    """Blocks put together into tasks of any size, in batches of a few rows: each row comes out once, with all its entries."""
    r = random.Random(3)
    entries = [(i, r.randrange(50), 1.0) for i in range(3000) for _ in range(r.randrange(8))]
    m = make(spark, (3000, 50, entries))
    want = [0.0] * 3000
    for i, _, a in entries:
        want[i] += a
    c = formats.csr(m)
    y = segments.spmv_compressed(c, matrix.ones(spark, 50), block=256)
    plan = y._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # read once
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert values(segments.spmv_compressed(c, matrix.ones(spark, 50), block=256)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_one_row_of_a_million_entries(spark):
    n = 1_000_000
    entries = spark.range(n).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("i"), (F.col("id") % 100).alias("j"), F.lit(1.0).alias("a"))
    c = formats.csr(SparseMatrix(entries, 3, 100))
    y = segments.spmv_compressed(c, matrix.ones(spark, 100), block=1 << 16)
    assert values(y) == [0, n, 0]
    plan = y._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(i" in plan and plan.count("hashpartitioning(i") == 1  # the carries alone
    assert c.entries.select(F.floor((F.col("k") + 2) / (1 << 16)).alias("b")).distinct().count() >= 15


@pytest.mark.parametrize("m", [M6, M7, M8, M9])
def test_tiled_products(spark, m):
    for blocks in (1, 3):
        t = tiles.Tiles(make(spark, m), 3, blocks)
        assert values(t.spmv(vector(spark, m[3]))) == m[4]
        assert values(t.spmv(vector(spark, m[3]), vector(spark, [1, 1, 1, 1]))) == [1 + v for v in m[4]]
        t.discard()
    with pytest.raises(MatrixError):
        t.power(vector(spark, m[3]), 2)


def test_powers_read_tiles_where_they_lie(spark):
    r = random.Random(4)
    entries = [(r.choice([0, r.randrange(9)]), r.choice([5, r.randrange(9)]), r.randint(-2, 2)) for _ in range(120)]
    m, x = make(spark, (9, 9, entries)), list(range(9))
    t = tiles.Tiles(m, 4)
    want = x
    for k in range(1, 4):
        want = [sum(a * want[j] for i, j, a in entries if i == row) for row in range(9)]
        assert values(t.power(vector(spark, x), k)) == want
    with session.in_order(spark):
        plan = t.spmv(vector(spark, x))._jdf.queryExecution().executedPlan().toString()
    side = plan.split("SortMergeJoin [ib")[1].split("FileScan")[0]
    assert "Exchange" not in side and "Sort" not in side
    t.discard()


def test_csr_layout(spark):
    c = formats.csr(make(spark, M7))
    assert [r["ptr"] for r in c.ptr.orderBy("r").collect()] == [0, 2, 3, 4, 7]
    e = c.entries.orderBy("k").collect()
    assert [r["j"] for r in e] == [0, 1, 1, 2, 0, 3, 4]
    assert [r["a"] for r in e] == [1, 2, 1, 3, -1, 2, 1]


def test_csr_aligned(spark):
    c = formats.csr(make(spark, M7), 2)
    assert [r["ptr"] for r in c.ptr.orderBy("r").collect()] == [0, 2, 4, 6, 10]
    e = c.entries.orderBy("k").collect()
    assert [r["j"] for r in e] == [0, 1, 1, 0, 2, 0, 0, 3, 4, 0]
    assert [r["a"] for r in e] == [1, 2, 1, 0, 3, 0, -1, 2, 1, 0]


def test_ell_layout(spark):
    slots, width = formats.ell(make(spark, M8))
    s = slots.orderBy("i", "l").collect()
    assert width == 3
    assert [r["j"] for r in s] == [0, 1, 3, 0, 1, 1, 2, 2, 2, 3, 4, 4]
    assert [r["a"] for r in s] == [1, 2, 3, 4, 1, 0, 3, 0, 0, 2, 1, 0]
    skipped = formats.ell(make(spark, M8), True)[0].where("is_pad")
    assert {r["j"] for r in skipped.collect()} == {INT_MAX}


def test_hybrid_layout(spark):
    slots, over, width = formats.hybrid(make(spark, M9))
    s = slots.orderBy("i", "l").collect()
    assert width == 2
    assert [r["j"] for r in s] == [0, 1, 0, 1, 2, 2, 3, 4]
    assert [r["a"] for r in s] == [1, 2, 4, 1, 3, 0, 2, 1]
    assert [tuple(r)[1:] for r in over.orderBy("k").collect()] == [(0, 3, 3.0), (0, 4, 5.0)]


@pytest.mark.parametrize("seed", range(4))
def test_random_layouts(spark, seed):
    rows, cols, entries = some(seed)
    m = make(spark, (rows, cols, entries))
    order = sorted(range(len(entries)), key=lambda k: (*entries[k][:2], k))
    lens = [sum(i == r for i, _, _ in entries) for r in range(rows)]
    # ELLPACK by a loop
    want, last, k, width = [], 0, 0, max(lens)
    for r in range(rows):
        for col in range(width):
            if col < lens[r]:
                last = entries[order[k]][1]
                want.append((r, col, last, float(entries[order[k]][2]), False))
                k += 1
            else:
                want.append((r, col, last, 0.0, True))
    got = [tuple(x) for x in formats.ell(m)[0].orderBy("i", "l").collect()]
    assert got == want
    # hybrid by a loop
    hist = [lens.count(n) for n in range(width + 1)]
    need, upto, w = 2 * rows // 3, 0, 0
    while upto < need:
        upto += hist[w]
        w += 1
    w = max(0, w - 1)
    slots, over, got_w = formats.hybrid(m)
    assert got_w == w
    want, rest, last, k = [], [], 0, 0
    for r in range(rows):
        mine = [entries[order[k + n]] for n in range(lens[r])]
        k += lens[r]
        want += [(r, n, mine[n][1], float(mine[n][2]), False) for n in range(min(w, lens[r]))]
        rest += [(r, j, float(a)) for _, j, a in mine[w:]]
        if mine:
            last = mine[-1][1]
        want += [(r, n, last, 0.0, True) for n in range(lens[r], w)]
    assert [tuple(x) for x in slots.orderBy("i", "l").collect()] == want
    assert [tuple(x)[1:] for x in over.orderBy("k").collect()] == rest
    s = {r["format"]: r for r in formats.storage(m).collect()}
    assert (s["csr"]["size"], s["ell"]["entries"], s["hybrid"]["padding"]) == (len(entries) * 12 + 4 * (rows + 1), rows * width, rows * w + len(rest) - len(entries))


def test_without_entries(spark):
    m = SparseMatrix(spark.createDataFrame([], "k long, i long, j long, a double"), 3, 2)
    assert values(references.Csr(m).run()) == [0, 0, 0]
    assert m.max_row_length().first()[0] == 0 and m.bandwidth().first()[0] == 0
    assert formats.ell(m)[0].count() == 0 and formats.hybrid(m)[1].count() == 0


def test_sorts_permutation_and_equality(spark):
    shuffled = (4, 5, [M8[2][0], M8[2][2], M8[2][3], M8[2][4], M8[2][1], *M8[2][5:]])
    m = make(spark, shuffled)
    assert [(r["i"], r["j"]) for r in m.sorted_row_major().orderBy("k").collect()] == sorted(e[:2] for e in M8[2])
    assert [(r["j"], r["i"]) for r in m.sorted_column_major().orderBy("k").collect()] == sorted((j, i) for i, j, _ in M8[2])
    assert make(spark, M8).same_as(make(spark, M8)) and not make(spark, M8).same_as(m)
    square = make(spark, (3, 3, [(0, 1, 1), (2, 0, 2)]))
    new = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "old long, new long")
    assert [(r["i"], r["j"]) for r in square.permuted(new).entries.orderBy("k").collect()] == [(2, 0), (1, 2)]
    assert {(r["i"], r["j"]) for r in square.expanded().entries.collect()} == {(0, 1), (1, 0), (2, 0), (0, 2)}


def test_only_whole_orders_of_real_square_matrices(spark):
    square = make(spark, (3, 3, [(0, 1, 1), (2, 0, 2)]))
    order = lambda *rows: spark.createDataFrame(list(rows), "old long, new long")
    for bad in (order((0, 1), (1, 0)), order((0, 0), (1, 0), (2, 1)), order((0, 2), (1, 3), (2, 0)), order((0, 0), (0, 1), (2, 2)), order((0, 0), (1, 1), (2, 2), (2, 2))):
        with pytest.raises(MatrixError):
            square.permuted(bad)
    whole = order((0, 2), (1, 0), (2, 1))
    for other in (make(spark, (2, 3, [(0, 2, 1)])), replace(square, field="integer")):
        with pytest.warns(UserWarning):
            assert other.permuted(whole) is other


def test_symmetry_is_kept(spark):
    m = make(spark, (3, 3, [(0, 0, 5), (1, 0, 2)]))
    get = lambda x: {(r["i"], r["j"]): r["a"] for r in x.expanded().entries.collect()}
    assert get(replace(m, symmetry="symmetric")) == {(0, 0): 5, (1, 0): 2, (0, 1): 2}
    assert get(replace(m, symmetry="skew-symmetric")) == {(0, 0): 5, (1, 0): 2, (0, 1): -2}
    assert not m.same_as(replace(m, symmetry="symmetric"))


def test_layouts_are_equal(spark):
    a, b, c = (formats.csr(make(spark, m), n) for m, n in ((M8, 1), (M8, 1), (M8, 2)))
    assert formats.same_layout(a.ptr, b.ptr) and formats.same_layout(a.entries, b.entries) and not formats.same_layout(a.entries, c.entries)
    assert formats.same_layout(formats.ell(make(spark, M8))[0], formats.ell(make(spark, M8))[0]) and not formats.same_layout(formats.ell(make(spark, M8))[0], formats.ell(make(spark, M9))[0])


def test_aligned_sizes(spark):
    m = make(spark, M8)  # rows of 3, 2, 1 and 2
    row = formats.storage(m, 4).where("format = 'csr'").first()
    assert (row["entries"], row["value_size"], row["index_size"], row["padding"]) == (16, 128, 20 + 64, 0)
    assert [r["csr"] for r in formats.nonzeros_per_thread(m, 2, 4).orderBy("thread").collect()] == [8, 8]
    assert references.Csr(m, layout=formats.csr(m, 4)).info()["matrix_size"] == 128 + 84 and references.Csr(m).info()["matrix_size"] == 64 + 20 + 32
