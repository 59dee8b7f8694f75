"""Small matrices with known layouts and products."""

import random

from memlattice.operators.matrix import SparseMatrix

#: (rows, columns, entries, x, y): fixed values, whose layouts and products are known.
X = [5, 2, 3, 3, 1]
M6 = (4, 5, [(0, 0, 1), (0, 1, 2), (1, 1, 1), (2, 2, 3), (3, 3, 2), (3, 4, 1)], X, [9, 2, 9, 7])
M7 = (4, 5, [(0, 0, 1), (0, 1, 2), (1, 1, 1), (2, 2, 3), (3, 0, -1), (3, 3, 2), (3, 4, 1)], X, [9, 2, 9, 2])
M8 = (4, 5, [(0, 0, 1), (0, 1, 2), (0, 3, 3), (1, 0, 4), (1, 1, 1), (2, 2, 3), (3, 3, 2), (3, 4, 1)], X, [18, 22, 9, 7])
M9 = (4, 5, [*M8[2], (0, 4, 5)], X, [23, 22, 9, 7])


def make(spark, m) -> SparseMatrix:
    rows, cols, entries = m[:3]
    data = [(k, i, j, float(a)) for k, (i, j, a) in enumerate(entries)]
    return SparseMatrix(spark.createDataFrame(data, "k long, i long, j long, a double"), rows, cols)


def vector(spark, v):
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "idx long, v double")


def some(seed: int):
    """A random matrix with empty rows and repeated entries."""
    r = random.Random(seed)
    rows, cols = r.randint(1, 9), r.randint(1, 9)
    live = [i for i in range(rows) if r.random() < 0.7] or [0]
    entries = [(r.choice(live), r.randrange(cols), r.randint(-3, 3)) for _ in range(r.randint(1, 30))]
    return rows, cols, entries
