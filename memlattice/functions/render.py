"""Matrices and reference streams as short texts, for looking at small ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _list(df: DataFrame, order: list[str], column: str) -> str:
    return "[" + " ".join(f"{r[0]:g}" for r in df.orderBy(*order).select(column).collect()) + "]"


def coo(entries: DataFrame) -> str:
    """Row indices, column indices and values in file order."""
    return " ".join(_list(entries, ["k"], c) for c in ("i", "j", "a"))


def csr(ptr: DataFrame, entries: DataFrame) -> str:
    """Row pointers, column indices and values."""
    return " ".join([_list(ptr, ["r"], "ptr"), *(_list(entries, ["k"], c) for c in ("j", "a"))])


def ell(slots: DataFrame) -> str:
    """Column indices and values, row by row, padding included."""
    return " ".join(_list(slots, ["i", "l"], c) for c in ("j", "a"))


def hybrid(slots: DataFrame, over: DataFrame) -> str:
    return f"{ell(slots)} {coo(over)}"


def references(refs: DataFrame, thread: int = 0) -> str:
    """((address, domain), ...) of one thread."""
    rows = refs.where(F.col("thread") == thread).orderBy("t").select("addr", "domain").collect()
    return "(" + ", ".join(f"({r['addr']}, {r['domain']})" for r in rows) + ")"


def indented(text: str, depth: int = 1, width: int = 2) -> str:
    return "\n".join(" " * depth * width + line if line else line for line in text.split("\n"))
