import itertools
import re

import pytest
from pyspark.sql import functions as F

from memlattice.llm import filter_audit as A

from ..oracle import connect, same
from .docs import awkward, clashing, frame

LABELS = "doc_id long, quality int, toxic int"
#: Of good and of toxic ones, one labelled twice, ids of nobody and of no document.
SOME = [(4, 1, 0), (5, 0, 1), (6, 1, 1), (7, 1, None), (7, 0, 0), (10, None, 1), (None, 1, 1), (99, 1, 1)]


def by_hand(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    parts = {}
    for d, text, lang, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {x for x, yes in {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": re.search(r"[#$%&*|]", t),
            "E": d is not None and any(o[0] is not None and o[0] < d and (o[1] or "") == t for o in rows),
        }.items() if yes}
        parts.setdefault(lang or "", []).append((fails, d in good, d in toxic))
    out = set()
    for part, docs in parts.items():
        removed, told = {}, []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [y for y in left if x in y[0]]
                left = [y for y in left if x not in y[0]]
                removed[x] = removed.get(x, 0) + len(gone)
                told.append((part, "".join(order), step, len(left), len(gone), sum(x in y[0] for y in docs) - len(gone), sum(y[0] == {x} for y in docs), sum(y[1] for y in gone), sum(y[2] for y in gone), x))
        out |= {(*y[:-1], removed[y[-1]]) for y in told}
    return out


def rows_of(df):
    got = df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    assert len(got) == len(set(map(tuple, got)))
    return set(map(tuple, got))


def test_awkward_documents(spark):
    rows = [*awkward(), (20, "", "", "a", 0), (3, "", "en", "a", 0), (None, None, None, None, None), (21, "AAA " * 300, "en", "a", 1)]
    df, labels = frame(spark, rows), spark.createDataFrame(SOME, LABELS)
    want = by_hand(rows, SOME)
    assert rows_of(A.op12(df, labels)) == want
    assert rows_of(A.op12(clashing(df), labels.withColumn("fails", F.lit(1)))) == want
    assert {len([x for x in want if x[0] == p]) for p in {x[0] for x in want}} == {600}


def test_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert A.op12(frame(spark, []), labels).collect() == []
    assert rows_of(A.op12(frame(spark), labels)) == by_hand(awkward(), [])


def test_other_filters(spark):
    two = (A.Filter("x", "size({w}) < 2"), A.Filter("y", "{copy}"))
    got = A.audit(frame(spark), spark.createDataFrame(SOME, LABELS), two).where("part = 'en'").collect()
    assert sorted((r["filter_order"], r["step"]) for r in got) == [("xy", 1), ("xy", 2), ("yx", 1), ("yx", 2)]
    with pytest.raises(ValueError, match="at most"):
        A.orders(frame(spark), A.FILTERS + two)


def test_oracle(spark, sf):
    df = A.op12(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    same(df, connect(sf), A.ORACLE)
    assert dict(df.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")
