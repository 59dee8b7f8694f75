"""Where array elements lie: synthetic addresses, page owners, thread blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = 4096
INDEX_SIZE, VALUE_SIZE = 4, 8


def div(a: Column, b: Column | int) -> Column:
    """Whole division of non-negative longs."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a.cast("long"), b.cast("long"))


def block(n: int, threads: int) -> int:
    """Elements per thread, at least 1 so that it can divide."""
    return max(1, -(-n // threads))


def owner(index: Column, n: Column | int, size: int, threads: int, page: int = PAGE) -> Column:
    """The thread on whose pages element `index` of a page-aligned array of n elements lies.

    Pages belong to the thread whose block holds the page's first element.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    n = F.greatest(n.cast("long"), F.lit(1).cast("long"))
    pages = div(n * size + (page - 1), page)
    at = F.least(div(index.cast("long") * size, page), pages - 1)
    first = div(at * page, size)
    return F.least(div(first, div(n + (threads - 1), threads)), F.lit(threads - 1)).cast("int")


class Addresses:
    """Page-aligned arrays one after the other: addr = base + index * size. Arrays never share a page."""

    def __init__(self, page: int = PAGE):
        self.page, self.next, self.arrays = page, 0, {}

    def add(self, name: str, n: int, size: int) -> Addresses:
        self.arrays[name] = (self.next, size)
        self.next += -(-max(n, 1) * size // self.page) * self.page
        return self

    def of(self, name: str, index: Column) -> Column:
        base, size = self.arrays[name]
        return F.lit(base).cast("long") + index.cast("long") * size


def align_up(x: Column, to: int) -> Column:
    return div(x + (to - 1), to) * to


def align_down(x: Column, to: int) -> Column:
    return x - F.pmod(x, F.lit(to))
