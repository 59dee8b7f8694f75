"""Streams against sequential loops."""

import pytest

from memlattice.operators import formats, references
from memlattice.operators.references import Threads

from .matrices import make, some

PAGE = 4096


def owner(idx, n, t):
    """By walking pages and blocks, for 8-byte elements of a page-aligned array."""
    c = -(-n // t)
    at = min(idx * 8 // PAGE, -(-n * 8 // PAGE) - 1) * PAGE
    for k in range(t):
        if min(n, k * c) * 8 <= at < min(n, (k + 1) * c) * 8:
            return k
    return t - 1


def blocks(n, t):
    c = -(-n // t)
    return [(min(n, k * c), min(n, (k + 1) * c)) for k in range(t)]


def coo_stream(entries, rows, cols, t, doms, prefix=""):
    out = []
    for th, ((a, b), (s, e)) in enumerate(zip(blocks(len(entries), t), blocks(rows, t))):
        w = []
        for k in range(a, b):
            i, j = entries[k][:2]
            w += [(f"{prefix}row_index", k, doms[th]), (f"{prefix}column_index", k, doms[th]), (f"{prefix}value", k, doms[th]), ("x", j, doms[owner(j, cols, t)]), ("workspace", th * rows + i, doms[th])]
        for i in range(s, e):
            for q in range(t):
                w += [("workspace", q * rows + i, doms[owner(q * rows + i, t * (e - s), t)]), ("y", i, doms[th])]
        out.append(w)
    return out


def ell_stream(slots, width, rows, cols, t, doms, prefix=""):
    out = []
    for th, (s, e) in enumerate(blocks(rows, t)):
        w = []
        for i in range(s, e):
            for col in range(width):
                j = slots[i * width + col]
                w += [(f"{prefix}column_index", i * width + col, doms[th]), (f"{prefix}value", i * width + col, doms[th]), ("x", j, doms[owner(j, cols, t)])]
            w.append(("y", i, doms[th]))
        out.append(w)
    return out


def got(kernel, threads):
    rows = kernel.references(threads).collect()
    out = []
    for th in range(threads.n):
        mine = sorted((r["t"], r["array"], r["idx"], r["domain"]) for r in rows if r["thread"] == th)
        assert [r[0] for r in mine] == list(range(len(mine)))
        out.append([r[1:] for r in mine])
    base = {(r["array"], r["addr"] - r["idx"] * (4 if "index" in r["array"] or r["array"] == "row_ptr" else 8)) for r in rows}
    assert len({a for a, _ in base}) == len(base) and all(b % PAGE == 0 for _, b in base)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("doms", [(0,), (0, 1), (1, 0, 1)])
def test_streams(spark, seed, doms):
    rows, cols, entries = some(seed + 10)
    m, t, threads = make(spark, (rows, cols, entries)), len(doms), Threads(doms)
    srt = sorted(entries, key=lambda e: e[:2])
    assert got(references.Coo(m), threads) == coo_stream(entries, rows, cols, t, doms)
    want = []
    for th, (a, b) in enumerate(blocks(len(entries), t)):
        want.append([x for k in range(a, b) for x in [("row_index", k, doms[th]), ("column_index", k, doms[th]), ("value", k, doms[th]), ("x", entries[k][1], doms[owner(entries[k][1], cols, t)]), ("y", entries[k][0], doms[owner(entries[k][0], rows, t)])]])
    assert got(references.CooAtomic(m), threads) == want
    ptr = [sum(e[0] < r for e in entries) for r in range(rows + 1)]
    want = []
    for th, (s, e) in enumerate(blocks(rows, t)):
        w = [("row_ptr", s, doms[th])]
        for i in range(s, e):
            w.append(("row_ptr", i + 1, doms[th]))
            for k in range(ptr[i], ptr[i + 1]):
                w += [("column_index", k, doms[th]), ("value", k, doms[th]), ("x", srt[k][1], doms[owner(srt[k][1], cols, t)])]
            w.append(("y", i, doms[th]))
        want.append(w)
    assert got(references.Csr(m), threads) == want
    slots, width = formats.ell(m)
    js = [r["j"] for r in slots.orderBy("i", "l").collect()]
    assert got(references.Ell(m), threads) == ell_stream(js, width, rows, cols, t, doms)
    h = references.Hybrid(m)
    js = [r["j"] for r in h.slots.orderBy("i", "l").collect()]
    over = [(r["i"], r["j"]) for r in h.over.orderBy("k").collect()]
    first, second = ell_stream(js, h.width, rows, cols, t, doms, "ell_"), coo_stream(over, rows, cols, t, doms, "coo_")
    assert got(h, threads) == [a + b for a, b in zip(first, second)]


def test_triad(spark):
    assert got(references.Triad(spark, 5), Threads((0, 1)))[1] == [x for k in (3, 4) for x in (("b", k, 1), ("c", k, 1), ("a", k, 1))]


def test_owner_of_large_arrays(spark):
    from pyspark.sql import functions as F

    from memlattice.operators import layout

    for n, t in ((1, 1), (511, 2), (512, 2), (513, 3), (5000, 3), (20000, 7)):
        df = spark.range(0, n, max(1, n // 60)).select("id", layout.owner(F.col("id"), n, 8, t).alias("o"))
        assert all(r["o"] == owner(r["id"], n, t) for r in df.collect())
