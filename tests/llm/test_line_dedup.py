import hashlib
import time

from pyspark.sql import functions as F

from memlattice.llm import line_dedup as L
from memlattice.session import in_order

from .docs import clashing, frame, sentence

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least_chars=40, least_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOW)
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars and d is not None:
                held.setdefault(key(x), set()).add(d)
    top = {k: max(v) for k, v in held.items() if len(v) >= least_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (d is not None and key(x) in top and d != top[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


COMMON, UMLAUT, SHORT = "Common Line " + sentence(1, 8), "ÄÖ KELVIN K " + sentence(2, 8), "short common line"


def cases():
    rows = [(k, f"{sentence(k + 9, 10)}\n  {COMMON}\t\n{SHORT}\n{UMLAUT if k % 2 else UMLAUT.lower()}") for k in range(12)]
    rows += [(20, None), (21, ""), (22, COMMON.upper() + "\n" + COMMON), (22, COMMON.upper() + "\n" + COMMON), (None, COMMON), (23, COMMON + "\n" + COMMON + "\nrest"), (24, "\n\n" + COMMON)]
    rows += [(30 + k, sentence(77, 9)) for k in range(4)]
    return rows


def test_by_hand(spark):
    df = spark.createDataFrame(cases(), "doc_id long, text string")
    got = sorted(map(tuple, L.op8(df).collect()), key=str)
    assert got == sorted(by_hand(cases()), key=str)


def test_any_batches_and_fanout(spark):
    """More batches than fanout squared: runs of three levels, the same rows."""
    df = spark.createDataFrame(cases(), "doc_id long, text string")
    want = sorted(map(str, L.dedup_lines(df).collect()))
    for batches, fanout in ((1, 2), (7, 2)):
        assert sorted(map(str, L.dedup_lines(df, batches=batches, fanout=fanout).collect())) == want


def test_batches_are_parted_by_id(spark):
    df = spark.createDataFrame([(k,) for k in [*range(1000), *[500] * 300, None]], "doc_id long")
    bounds = L.id_bounds(df, "doc_id", 4)
    assert len(bounds) == 3 and bounds == sorted(bounds, reverse=True) and df.where(F.col("doc_id") > bounds[0]).count() > 200
    assert L.id_bounds(df.limit(0), "doc_id", 4) == []
    text = spark.createDataFrame([(f"d{k:04}", "Line number one is rather long, as is this second half of it") for k in range(40)], "doc_id string, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in L.dedup_lines(text).collect()}
    assert sum(got.values()) == 39 and got["d0039"] == 0


def test_runs_over_batches(spark):
    """Lines that a run holds only bring their count; the run of the batch that saw a line first names its largest holder."""
    runs = L.LineRuns(4, 2)
    unseen = []
    for k in range(5):
        batch = spark.createDataFrame([(100 - 10 * k - n, n if n < 2 else 10 * k + n, 0) for n in range(4)], "id long, a long, b long")
        hashes = batch.groupBy("a", "b").agg(F.max("id").alias("top"))
        unseen.append({r["a"] for r in runs.probed(hashes).where("not known").collect()})
        runs.add(batch)
    assert unseen[0] == {0, 1, 2, 3} and unseen[4] == {42, 43}
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    last = {r["a"]: (r["n"], r["top"]) for r in runs.runs[0].collect()}
    assert last[0] == (1, None) and last[42] == (1, 58)
    with in_order(spark):
        merged = {r["a"]: (r["n"], r["top"]) for r in runs.merged(runs.runs).orderBy("n").collect()}
    assert merged[0] == (5, 100) and merged[1] == (5, 99) and merged[42] == (1, 58)
    runs.clear()


def test_runs_are_read_as_they_lie(spark):
    """A new batch is dealt out once; no run is: neither when it is probed nor when runs are compacted."""
    runs = L.LineRuns(4, 9)
    batch = spark.createDataFrame([(k, k % 7, 0) for k in range(50)], "id long, a long, b long")
    runs.add(batch)
    runs.add(batch)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    with in_order(spark):
        probe, compact = plan(runs.added(batch)), plan(runs.merged(runs.runs))
    assert probe.count("Exchange hashpartitioning") == 1 and probe.count("SortMergeJoin") == 2 and probe.count("Sort [") == 1
    assert "Exchange" not in compact and compact.count("Bucketed: true") == 2
    runs.clear()


def test_long_documents_in_linear_time(spark):
    """Five documents of 30,000 shared lines: a search for each line among all that go would take 10^9 steps a document."""
    lines = [f"shared line number {k} with enough letters in it to count" for k in range(30_000)]
    df = spark.createDataFrame([(k, "\n".join(lines) + f"\nown {k}") for k in range(5)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in L.dedup_lines(df).collect()}
    assert time.perf_counter() - began < 60
    assert {k: v[:2] for k, v in got.items()} == {k: (30_001, 30_000 if k < 4 else 0) for k in range(5)} and got[2][2] == "own 2"


def test_one_id_with_several_texts(spark):
    rows = [(1, COMMON + "\nfirst"), (1, "second\n" + COMMON), (1, COMMON + "\nfirst")] + [(k, COMMON) for k in range(2, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, L.op8(df).collect()), key=str) == sorted(by_hand(rows), key=str)


def test_stage(spark):
    df = clashing(frame(spark, [(k, f"{sentence(k, 12)}\n{COMMON}", "en", "a", 1) for k in range(6)]))
    out = L.stage(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert r["n_chars"] == len(r["text"]) and (COMMON in r["text"]) == (r["doc_id"] == 5) and r["n_lines"] == "mine"
    assert L.op8(frame(spark, [])).count() == 0
    assert L.op8(frame(spark)).count() == frame(spark).count()
    assert L.op8(frame(spark)).where(F.col("kept_sha256").isNull()).count() == 0
