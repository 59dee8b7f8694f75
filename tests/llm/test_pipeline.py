"""The pipeline by a version without Spark, from the operators' hand-written doubles."""

import inspect
from collections import Counter

import pytest

import corpus_pipeline
from memlattice.llm import sentencepiece_codec, simhash
from memlattice.session import materialize

from .docs import awkward, clashing, frame
from .test_line_dedup import LOW
from .test_quality_rules import by_hand as measured
from .test_simhash import linked
from .test_source_mix import fill


def passes(text):
    n, chars, symbols, dup, repeat = measured(text)
    t = text or ""
    lines = len([x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")])
    return not (n < 50 or 100 * repeat > 50 * n or 10 * symbols > 3 * n or (dup >= 3 and 10 * dup > 6 * lines) or chars < 2 * n or chars > 25 * n or 10 * sum(c.isupper() for c in t) > 6 * chars or 2 * t.count("!") > n)


def by_hand(rows):
    """rows: (doc_id, text, source), unique ids. Counter of (doc_id, text)."""
    rows = [r for r in rows if passes(r[1])]
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOW)
    held = {}
    for d, t, _ in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(d)
    top = {k: max(v) for k, v in held.items() if len(v) >= 5}
    rows = [(d, "\n".join(x for x in t.split("\n") if not (key(x) in top and top[key(x)] != d)), s) for d, t, s in rows]
    prints = {d: simhash.simhash(t) for d, t, _ in rows}
    root, least = linked(set(prints.values())), {}
    for d, p in prints.items():
        least[root[p]] = min(d, least.get(root[p], d))
    rows = [r for r in rows if least[root[prints[r[0]]]] == r[0]]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target = fill(dict(sizes))
    import hashlib

    out = Counter()
    for d, t, s in rows:
        rate = target[s] / sizes[s]
        u = int(hashlib.md5(f"17:{d}".encode()).hexdigest()[:13], 16) / (1 << 52)
        if n := int(rate) + (u < rate - int(rate)):
            out[d, t] = n
    return out


def test_by_hand(spark, sf):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == by_hand(rows)
    codec = sentencepiece_codec.Codec.load()
    for r in got:
        assert codec.decode(r["ids"]) == r["text"] and r["round_trip"] and r["n_chars"] == len(r["text"])


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mix", "sentencepiece"]
    for _, f in corpus_pipeline.STAGES:
        assert list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("rows", [awkward(), []])
def test_awkward_documents_go_through(spark, rows):
    docs = clashing(frame(spark, rows))
    columns = docs.columns
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(f(spark, docs, ""))
        if k < 4:
            assert docs.columns == columns
    assert docs.count() == 0 if not rows else docs.count() > 0
