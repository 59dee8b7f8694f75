import pytest
from pyspark.sql import functions as F

from memlattice.llm import source_mix as M

from .docs import clashing, frame, sentence


def fill(sizes, weights=(1, 2, 3), most=3):
    """Sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, list(names)
    while open_:
        whole = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / whole >= most * sizes[s]]
        if not over:
            return target | {s: left * w[s] / whole for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            open_.remove(s)
        left -= sum(target[s] for s in over)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 2, None: 3}, {"a": 5}, {"a": 0, "b": 7}, {"é": 3, "z": 40, "b": 900, "c": 2, None: 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in M.targets(df).collect()}
    assert got == {s: pytest.approx(t) for s, t in fill(sizes).items()}


def test_mix(spark):
    rows = [(k, sentence(k, 5 + k % 40), "en", None if k % 11 == 0 else f"s{k % 3}" if k % 2 else "hot", 1) for k in range(3000)]
    rows += [(5000, None, "en", "hot", 0), (5001, "", "en", "hot", 0)]
    x = M.op6(frame(spark, rows))
    assert sorted(map(str, x.collect())) == sorted(map(str, M.op6(frame(spark, rows).repartition(7)).collect()))
    assert x.where("taken > 3 * size").count() == 0 and x.count() == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want = fill(sizes)
    for r in x.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect():
        assert r["t"] == pytest.approx(r["target"], rel=0.1)
    assert {round(r["target"], 6) for r in x.collect()} == {round(t, 6) for t in want.values()}


def test_stage_emits_copies(spark):
    df = clashing(frame(spark))
    out = M.stage(df)
    assert out.columns == df.columns
    n = {(r["doc_id"], r["text"]): r["copies"] for r in M.mix(frame(spark)).collect()}
    got = {}
    for r in out.collect():
        got[r["doc_id"], r["text"]] = got.get((r["doc_id"], r["text"]), 0) + 1
    assert got == {k: c * (2 if k[0] == 6 else 1) for k, c in n.items() if c}
    assert M.op6(frame(spark, [])).count() == 0
