import itertools
import random
import re

import pytest
import xxhash

from memlattice.llm import simhash as S

from .docs import awkward, clashing, frame, sentence

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return 0
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(values):
    """Components of all pairs at two or fewer bits, by brute force: value -> least value."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in vs}


def test_fingerprints():
    texts = [None, "", " ", "One", "one TWO", "a b c", "É é A", "a\x0bb\x1cc d e", *(r[1] for r in awkward())]
    assert [S.simhash(t) for t in texts] == [by_hand(t) for t in texts]


def test_postings_miss_no_pair():
    """Whichever two bits differ, one of the first postings fixes neither, and so does one of those that it is split into."""
    seen, todo = set(), list(S.FIRST)
    for a, b in itertools.product(range(64), repeat=2):
        assert any(not {a // 4, b // 4} & s for s in S.FIRST)
    while todo:
        s = todo.pop()
        if s in seen:
            continue
        seen.add(s)
        kids = S.finer(s)
        if not kids:
            assert len(s) == 14  # 56 bits: at most 256 fingerprints share them
        free = [k for k in range(64) if k // 4 not in s]
        for a, b in itertools.product(free, repeat=2) if kids else ():
            assert any(not {a // 4, b // 4} & t for t in kids)
        todo += kids
    assert S.bits(frozenset(range(16))) == -1 and S.bits(frozenset({15, 14})) == 255


def test_a_dense_cluster_is_split_to_the_end(spark):
    """All values of two bytes: every posting is dense until 56 bits are fixed."""
    base = 0x0123456789AB0000
    values = sorted({base ^ x for x in range(700)} | {base ^ (x << 3) for x in range(300)})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {(r["a"], r["b"]) for r in S.links(fps, dense=4).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2}


@pytest.mark.parametrize("dense", [1, 3, 32])
def test_links(spark, dense):
    r = random.Random(dense)
    values = set()
    for _ in range(12):  # clusters, chains and strangers
        v = r.getrandbits(64)
        for _ in range(r.choice((1, 4, 20))):
            values.add(v)
            v ^= 1 << r.randrange(64) ^ (1 << r.randrange(64) if r.random() < 0.5 else 0)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    edges = [(x["a"] % (1 << 64), x["b"] % (1 << 64)) for x in S.links(fps, dense=dense).collect()]
    assert {frozenset(e) for e in edges} == {frozenset(e) for e in itertools.combinations(values, 2) if (e[0] ^ e[1]).bit_count() <= 2}
    root = {v: v for v in values}
    for _ in range(len(values)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert root == linked(values)


@pytest.mark.parametrize("dense", [2, 32])
def test_query_by_brute_force(spark, dense):
    base = sentence(5, 300).split()
    rows = [r for r in awkward() if r[0] is not None]
    for k in range(60):
        w = list(base)
        w[k * 5] = "edit"
        rows.append((100 + k, " ".join(w), "en", "a", 1))
    got = S.near_duplicates(frame(spark, rows), dense=dense).collect()
    prints = {(r[0], by_hand(r[1])) for r in rows}
    root = linked({p for _, p in prints})
    least = {}
    for d, p in prints:
        least[root[p]] = min(d, least.get(root[p], d))
    assert len(got) == len(rows)
    for r in got:
        assert r["component"] == least[root[r["fp"] % (1 << 64)]]
    assert {(r["doc_id"], r["fp"] % (1 << 64)) for r in got} == prints


def test_whole_table_by_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in S.op2(df).collect()}
    prints = {r["doc_id"]: S.simhash(r["text"]) for r in df.collect()}
    root, least = linked(set(prints.values())), {}
    for d, p in prints.items():
        least[root[p]] = min(d, least.get(root[p], d))
    assert got == {d: (p, least[root[p]]) for d, p in prints.items()}


def test_stage(spark):
    df = frame(spark)
    out = S.stage(df)
    assert out.columns == df.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert None in ids and 6 in ids and 7 not in ids and ids.count(6) == 1 and 1 in ids and 2 not in ids and 3 not in ids
    assert S.op2(frame(spark, [])).count() == 0


def test_clashing_columns(spark):
    df = clashing(frame(spark))
    got = S.near_duplicates(df)
    assert got.columns == ["doc_id", "fp", "component"] and got.count() == df.count()
    named = S.near_duplicates(frame(spark).withColumnRenamed("doc_id", "fp"), "fp")
    assert named.columns == ["fp", "_fp", "component"] and sorted(map(str, map(tuple, named.collect()))) == sorted(map(str, map(tuple, got.collect())))
