import re

import pytest
from pyspark.sql import functions as F

from memlattice.llm import quality_rules as Q
from memlattice.llm.registry import ORACLES, QUERIES
from tests.oracle import connect, same

from .docs import awkward, clashing, frame

W = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    t = text or ""
    ws = W.findall(t)
    wins = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    twice = {w for w in wins if wins.count(w) > 1}
    covered = {i + k for i, w in enumerate(wins) if w in twice for k in range(3)}
    lines = [x for x in t.split("\n") if W.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", "a b", "a b c", "a b c a b c", "a b c x a b c", "x " * 9, "one\none\n \n\none\ntwo # $", "a b c d a b c d b c d", "é ß x\x0by"]


def test_by_hand(spark):
    rows = [(k, t, None, None, None) for k, t in enumerate(TEXTS)] + [r for r in awkward() if len(r[1] or "") < 5000]
    got = {(r["doc_id"], r["n_words"]): r for r in Q.op4(frame(spark, rows)).collect()}
    for r in rows:
        want = by_hand(r[1])
        x = got[r[0], want[0]]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want, r
        assert x["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (x["base_failed"] and x["kept"])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), connect(sf), ORACLES[name])


def test_policies_and_ablations(spark):
    df = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,), (6,)], "b long").select(F.struct(F.col("b").alias("fail_bits")).alias("ledger"))
    rules = ("few_words", "repeated_windows", "symbols")
    got = {r["rule"]: tuple(r)[1:] for r in Q.ablations(df, rules).collect()}
    assert got == {"few_words": (3, 2, 3), "repeated_windows": (2, 0, 1), "symbols": (2, 1, 2)}
    assert df.where(Q.passes(F.col("ledger.fail_bits"), rules)).count() == 1
    assert Q.mask("base@1") == 3


def test_bits_stay_what_they_are():
    assert [(r.name, r.bit) for r in Q.RULES][:3] == [("few_words", 0), ("repeated_windows", 1), ("symbols", 2)]
    assert len({r.bit for r in Q.RULES}) == len(Q.RULES)


def test_stage_keeps_columns(spark):
    df = clashing(frame(spark))
    assert Q.stage(df).columns == df.columns
    assert {r["doc_id"] for r in Q.stage(df).collect()} >= {6, 7, 8, 9, 10}
    assert Q.op4(frame(spark, [])).count() == 0


def test_the_ledger_is_stored(spark):
    """Policies and ablations read the table, whatever becomes of the texts; it holds no text."""
    df = frame(spark)
    led = Q.stored_ledger(df)
    assert led.columns == ["doc_id", *Q.MEASURES, "fail_bits"] and led.inputFiles()
    want = {r["rule"]: tuple(r)[1:] for r in Q.ablations(Q.ledger(df), "standard@1").collect()}
    assert {r["rule"]: tuple(r)[1:] for r in Q.ablations(led, "standard@1", "fail_bits").collect()} == want
    clash = Q.stored_ledger(df.withColumnRenamed("doc_id", "fail_bits"), "fail_bits")
    assert clash.columns == ["fail_bits", *Q.MEASURES, "_fail_bits"]
