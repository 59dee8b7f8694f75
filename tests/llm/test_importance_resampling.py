import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlattice.llm import importance_resampling as I

from .docs import awkward, clashing, frame


def corpus(n=300):
    r = random.Random(4)
    good, junk = [f"word{k}" for k in range(60)], [f"zz{k}" for k in range(60)]
    docs = [(k, " ".join(r.choice(junk if k % 5 == 0 else good) for _ in range(50)), "en", "a", 1) for k in range(n)]
    return docs, [(k, int(k % 5 != 0), 0) for k in range(0, n, 2)]


def test_weights_by_hand(spark):
    docs, labels = corpus(60)
    target = {d for d, q, _ in labels if q}
    df = frame(spark, docs).withColumn("t", F.col("doc_id").isin(list(target)))
    ratio = I.fit(df, "text", "t")
    raw, aim = np.zeros(I.BUCKETS), np.zeros(I.BUCKETS)
    for d, t, *_ in docs:
        c = np.bincount(I.buckets(t), minlength=I.BUCKETS)
        raw += c
        aim += c * (d in target)
    p, w = raw / raw.sum(), 0.002 * aim.sum()
    for b in np.nonzero(raw)[0]:
        assert ratio[b] == pytest.approx(math.log((aim[b] + w * p[b]) / (aim.sum() + w) / p[b]))
    got = {r["doc_id"]: r["log_weight"] for r in I.resample(df, "t", k=10).collect()}
    assert got == {d: pytest.approx(ratio[I.buckets(t)].sum()) for d, t, *_ in docs}


def test_the_table_grows_with_the_texts(spark):
    size = lambda n: I.table_size(spark.range(64).select(F.expr(f"repeat('x', {n})").alias("text")), "text")
    assert size(0) == size(10) == I.BUCKETS
    assert size(1 << 24) == I.BUCKETS_BY_ROOT << 15 > I.BUCKETS
    assert I.table_size(frame(spark, []), "text") == I.BUCKETS


@pytest.mark.parametrize("most", [1, 40, 10**6])
def test_counts_in_portions(most):
    """However few n-grams are held at once, the sums are those of all texts, in tables beyond the least size too."""
    docs, labels = corpus(40)
    texts, targets = [t for _, t, *_ in docs] + [None, ""], [d % 3 == 0 for d, *_ in docs] + [True, False]
    n = 1_000_003
    batch = I.pa.RecordBatch.from_arrays([I.pa.array(targets), I.pa.array(texts)], ["t", "x"])
    raw, aim = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for out in I._counts(n, most)([batch.slice(0, 9), batch.slice(9)]):
        np.add.at(raw, out["bucket"].to_numpy(), out["raw"].to_numpy())
        np.add.at(aim, out["bucket"].to_numpy(), out["aim"].to_numpy())
    every = [I.buckets(t, n) for t in texts]
    assert (raw == np.bincount(np.concatenate(every), minlength=n)).all()
    assert (aim == np.bincount(np.concatenate([x for x, t in zip(every, targets) if t]), minlength=n)).all()
    assert raw.nonzero()[0].max() > I.BUCKETS


def test_ngrams():
    assert len(I.buckets("a b c")) == 5 and len(I.buckets("a")) == 1 and len(I.buckets(None)) == 0
    assert (I.buckets("A  b") == I.buckets("a b")).all()
    assert set(I.buckets("b a")) != set(I.buckets("a b"))


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_exactly_k_are_chosen(spark, bins):
    r = random.Random(bins)
    rows = [(float(r.choice((1, 2, 3, r.random(), 5))), float(r.randrange(4)), (k % 3 << 33) + k) for k in range(200)]
    df = spark.createDataFrame(rows, "key double, tie double, place long")
    order = sorted(rows, reverse=True)
    for k in (0, 1, 50, 117, 199, 200, 300):
        got = {tuple(x) for x in df.where(I.chosen(df, k, bins)).collect()}
        assert got == set(order[:k])
    empty = spark.createDataFrame([], "key double, tie double, place long")
    assert empty.where(I.chosen(empty, 3)).count() == 0


def test_ties_of_null_and_text_ids(spark):
    """Rows of one id or of none share their key: as many as are needed are taken."""
    for kind, ids in (("long", [None] * 4 + [7]), ("string", ["a"] * 6 + [None] * 3 + ["b"] * 2), ("date", [None, None])):
        df = spark.createDataFrame([(k, "same text", False) for k in ids], f"doc_id {kind}, text string, t boolean")
        for k in range(len(ids) + 1):
            assert I.resample(df, "t", k=k).where("selected").count() == k


def test_clashing_columns(spark):
    df = clashing(frame(spark)).withColumn("key", F.lit("mine")).withColumn("t", F.lit(True))
    got = I.resample(df, "t", k=3)
    assert got.columns == ["doc_id", "log_weight", "key", "selected"] and got.where("selected").count() == 3
    assert I.resample(df.drop("key").withColumnRenamed("doc_id", "key"), "t", k=3, id_col="key").columns == ["key", "log_weight", "_key", "selected"]


def test_good_documents_are_chosen(spark):
    docs, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = I.op1(frame(spark, docs), lab).collect()
    assert sum(r["selected"] for r in rows) == round(300 * sum(q for _, q, _ in labels) / len(labels))
    assert all(r["selected"] == (r["doc_id"] % 5 != 0) for r in rows)
    assert sorted(rows) == sorted(I.op1(frame(spark, docs).repartition(5), lab).collect())


def test_gumbel_keys_sample_by_weight(spark):
    """With equal texts of two weights, the chosen are in about the ratio of the weights."""
    docs = [(k, "a" if k % 2 else "b", "en", "s", 1) for k in range(4000)]
    df = frame(spark, docs).withColumn("t", (F.col("doc_id") % 2 == 1) | (F.col("doc_id") % 8 == 0))
    rows = I.resample(df, "t", k=200).collect()
    w = {r["doc_id"] % 2: math.exp(r["log_weight"]) for r in rows}
    odd = sum(r["selected"] for r in rows if r["doc_id"] % 2)
    assert odd == pytest.approx(200 * w[1] / (w[0] + w[1]), abs=25)


def test_awkward_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = I.op1(frame(spark), none).collect()
    assert len(rows) == len(awkward()) and {r["log_weight"] for r in rows} == {0.0} and all(r["selected"] is not None for r in rows)
    assert I.op1(frame(spark, []), none).count() == 0
