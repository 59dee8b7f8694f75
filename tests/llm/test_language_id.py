import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from memlattice.llm import language_id as L
from memlattice.llm.language_id import SlicedFilter, grams

from .docs import awkward, clashing, frame


def test_grams():
    got = {(int(c) >> 40 & 0xFFFFF, int(c) >> 20 & 0xFFFFF, int(c) & 0xFFFFF) for c in grams("Ab, c1")}
    a, b, c = map(ord, "abc")
    assert {(0, a, b), (a, b, 0), (b, 0, c), (0, c, 0)} <= got
    assert len(grams("12 !?")) == 0 and len(grams("")) == 0


def test_filter_has_all_it_was_given_and_corrects_for_the_rest():
    r = np.random.default_rng(0)
    held = {f"l{k:02d}": r.integers(0, 2**60, 300).astype(np.uint64) for k in range(70)}
    f = SlicedFilter.of(held, "l00", 4)
    assert f.slots.shape[1] == 2
    for k, name in enumerate(f.languages):
        bit = np.uint64(1) << np.uint64(k % 64)
        assert (f.masks(held[name])[:, k // 64] & bit).all()
        strange = r.integers(0, 2**60, 20000).astype(np.uint64)
        seen = ((f.masks(strange)[:, k // 64] & bit) > 0).mean()
        assert abs(seen - f.false_rate[k]) < 0.02


def test_query(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = L.op7(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_languages_change_nothing(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = L.held_out(F.col("doc_id"), 4, 2)
    other = df.withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(L.op7(df).collect()) == sorted(L.op7(other).collect())


def test_sample_is_bounded(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    m = L.fit(df, fit_docs=50, share=0.05, least=1)
    assert m.languages and m.predict(df.where("lang = 'en'").first()["text"])[0] == "en"


def test_awkward_documents(spark):
    rows = L.op7(frame(spark)).collect()
    assert len(rows) == len(awkward())
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und == {1, 2, 3}
    nothing = frame(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in L.op7(nothing).collect()} == {"und"}
    assert L.op7(frame(spark, [])).count() == 0


def test_long_text_in_pieces(monkeypatch, spark, sf):
    """Cut inside words, between them, in white space or before the end: the same n-grams, so the same score."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    m = L.fit(df)
    texts = ["".join(r["text"] for r in df.where("lang = 'fr'").limit(5).collect()), "ab, c1", "", "  ", "a", "...a b", "ΟΔΟΣ ΟΔΟΣ", "abc" * 7 + " "]
    whole = [(m.predict(t), sorted(grams(t).tolist())) for t in texts]
    assert whole[0][0][0] == "fr" and whole[0][0][1] > 0
    for piece in (1, 2, 3, 7, 500):
        monkeypatch.setattr(L, "PIECE", piece)
        assert [(m.predict(t), sorted(grams(t).tolist())) for t in texts] == whole


def test_a_rare_language_keeps_its_ngrams(spark):
    """However many texts and n-grams the others have, and however many languages there are."""
    def word(k, n):
        return "".join(chr(0x4E00 + (k * 7919 + i * 104729) % 9000) for i in range(n))

    rows = [(k, " ".join(word(k * 50 + i, 3) for i in range(30)), "many") for k in range(600)] * 2
    rows += [(9000 + k, "wenige worte stehen hier im text", "few") for k in range(5)]
    rows += [(10_000 + 4 * k + i, chr(0x10A0 + k % 60) * (2 + k // 60) + "abc", f"l{k:04d}") for k in range(1100) for i in range(4)]
    m = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_docs=300)
    assert len(m.languages) > 1100 and m.predict("worte im text")[0] == "few"


def by_hand(train, texts):
    """Counts in plain sets, without filters: a text's n-grams that a language has, by language."""
    def ngrams(t):
        x = re.sub(r"[^a-zäöüßàâçéèêëîïôùûñíóúáœæ]+", "_", "_" + (t or "").lower() + "_")
        x = re.sub("_+", "_", x)
        return [x[i : i + n] for n in (2, 3) for i in range(len(x) - n + 1)] if x.strip("_") else []

    docs, n = Counter(lang for _, lang in train), Counter()
    for t, lang in train:
        n.update((lang, g) for g in set(ngrams(t)))
    share = {k: v / docs[k[0]] for k, v in n.items() if v >= 3}
    most = {}
    for (_, g), v in share.items():
        most[g] = max(v, most.get(g, 0))
    held = {k for k, v in share.items() if v >= 0.2 * most[k[1]]}
    out = []
    for t in texts:
        gs = ngrams(t)
        got = {lang: sum((lang, g) in held for g in gs) for lang in docs}
        best = max(sorted(got), key=got.get)
        out.append((best, got[best] / len(gs)) if gs else ("und", 0.0))
    return out


def test_query_by_hand(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("not text rlike '[^\\\\x00-\\\\x7fäöüßàâçéèêëîïôùûñíóúáœæÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÑÍÓÚÁŒÆ¿¡«»–—’“”…]'").collect()
    df = spark.createDataFrame(rows)
    train = [(r["text"], r["lang"]) for r in rows if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    want = dict(zip([r["doc_id"] for r in rows], by_hand(train, [r["text"] for r in rows])))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.op7(df).collect()}
    assert len(got) == len(rows) > 100
    for d, (lang, score) in want.items():
        assert got[d][0] == lang and abs(got[d][1] - score) < 0.02, (d, got[d], lang, score)


def test_clashing_columns(spark):
    df = clashing(frame(spark)).withColumn("lang_pred", F.lit("mine"))
    out = L.identify(df, L.fit(df))
    assert out.columns == [*df.columns, "_lang_pred", "_score"] and out.where("lang_pred <> 'mine'").count() == 0
