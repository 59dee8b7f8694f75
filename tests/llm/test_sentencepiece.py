import random

import numpy as np
import pytest
import sentencepiece

from memlattice.llm import sentencepiece_codec as C
from memlattice.llm.sentencepiece_codec import MARKER, MODEL, Codec

from .docs import awkward, clashing, frame


@pytest.fixture(scope="module")
def codec():
    return Codec.load()


def unigram_model() -> bytes:
    """The vocabulary file with its model type set to unigram: field 3 of field 2."""

    def number(b, i):
        n = shift = 0
        while True:
            n |= (b[i] & 127) << shift
            shift += 7
            i += 1
            if b[i - 1] < 128:
                return n, i

    def fields(b):
        i = 0
        while i < len(b):
            at = i
            key, i = number(b, i)
            if key & 7 == 2:
                n, i = number(b, i)
                value, i = b[i : i + n], i + n
            elif key & 7 == 0:
                value, i = number(b, i)
            else:
                n = {1: 8, 5: 4}[key & 7]
                value, i = b[i : i + n], i + n
            yield key >> 3, value, b[at:i]

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    new = b""
    for f, value, raw in fields(open(MODEL, "rb").read()):
        if f == 2:
            inner = b"".join(r for g, _, r in fields(value) if g != 3) + b"\x18\x01"
            raw = b"\x12" + varint(len(inner)) + inner
        new += raw
    return new


def test_double_array():
    r = random.Random(3)
    keys = sorted({bytes(r.choice(b"abc\xc3\xa9") for _ in range(r.randint(1, 6))) for _ in range(300)})
    base, check, value = C.double_array(keys, list(range(len(keys))))

    def find(key):
        s = 0
        for c in key:
            t = base[s] + c
            if check[t] != s:
                return -1
            s = t
        return value[s]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert find(b"abz") == -1


def words():
    r = random.Random(1)
    ws = {w for row in awkward() for w in (row[1] or "").split()}
    ws |= {"".join(r.choice("abcdeéßñthing") for _ in range(r.randint(1, 14))) for _ in range(1500)}
    return sorted(ws - {""}) + ["日本語テキスト", "ﷺx", "zzzzqqqq", "a1b2"]


def test_scores_are_the_librarys_best(codec):
    m = sentencepiece.SentencePieceProcessor(model_proto=unigram_model())
    score = lambda ids: sum(codec.scores[i] for i in ids if i not in set(codec.byte_ids))
    ws = [w for w in words() if MARKER not in w and "\x00" not in w]
    for w, ids in zip(ws, codec.encode_batch(ws)):
        ids = ids.tolist()
        assert score(ids) == score(m.nbest_encode(w, nbest_size=2)[0]), w
        assert codec.decode(ids) == m.decode(ids) == w


def test_together_is_as_alone(codec):
    raws = [(MARKER + w).encode() for w in words() if MARKER not in w]
    raws = [r for r in raws if len(r) < 60]
    assert [np.frombuffer(x, np.int32).tolist() for x in codec._many(raws)] == [codec._single(x) for x in raws]


def brute(pieces, text, unknown):
    """Best total score over all segmentations."""
    best = [float("-inf")] * (len(text) + 1)
    best[0] = 0.0
    for s in range(len(text)):
        for p, x in pieces.items():
            if text.startswith(p, s):
                best[s + len(p)] = max(best[s + len(p)], best[s] + x)
        if text[s] not in pieces:
            best[s + 1] = max(best[s + 1], best[s] + unknown)
    return best[-1]


def test_small_vocabularies():
    r = random.Random(7)
    for seed in range(20):
        pieces = {MARKER: -1.0} | {"".join(r.choice(MARKER + "abé") for _ in range(r.randint(1, 4))): -r.random() * 9 for _ in range(14)}
        pieces = {p: s for p, s in pieces.items() if MARKER not in p.lstrip(MARKER)}
        names = ["<unk>", *pieces]
        c = Codec.of(names, [0.0, *pieces.values()], 0, {0}, set())
        for _ in range(20):
            text = "".join(r.choice(" abéz") for _ in range(r.randint(1, 15)))
            (ids,) = c.encode_batch([text])
            got = sum(c.unknown_score if i == 0 else c.scores[i] for i in ids)
            assert got == pytest.approx(brute(pieces, MARKER + text.replace(" ", MARKER), c.unknown_score)), (seed, text)


def test_long_stretch_and_cache(codec):
    text = "ab" * 5000 + " " + "x" * 70
    (a,) = codec.encode_batch([text])
    assert codec.decode(a.tolist()) == text
    small = [codec.encode_batch([w], cache=5)[0].tolist() for w in words()[:200]]
    assert small == [x.tolist() for x in codec.encode_batch(words()[:200])]


def test_pieces_across_words_are_refused():
    with pytest.raises(ValueError):
        Codec.of(["<unk>", "a" + MARKER], [0, -1], 0, {0}, set())


def test_query(spark):
    rows = C.op5(frame(spark)).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        assert r["n_tokens"] == len(r["ids"] or []) and r["round_trip"] == (r["doc_id"] != 13)
    assert {r["doc_id"]: r["ids"] for r in rows}[1] is None and {r["doc_id"]: r["ids"] for r in rows}[2] == []
    df = clashing(frame(spark))
    assert C.stage(df).columns == [*df.columns, "_ids", "_n_tokens", "_round_trip"]
    back = C.encode(frame(spark)).select("text", C.decoder(spark)("ids").alias("back"), "round_trip")
    assert all(x["back"] == x["text"] for x in back.where("round_trip").collect())
    assert C.op5(frame(spark, [])).count() == 0


def test_ranks_of_merges_are_not_taken_for_log_scores(spark, codec):
    """The vocabulary file holds byte-pair merges: words that are one piece stay whole, and the scores are the logs of shares."""
    assert C.model_type(open(MODEL, "rb").read()) == 2 and C.model_type(unigram_model()) == C.UNIGRAM
    text = "the government said idiot\nthe government"
    df = frame(spark, [(k, text, "en", "a", 1) for k in range(50)])
    for r in C.op5(df).collect():
        pieces = [codec.pieces[i] for i in r["ids"]]
        assert pieces == ["▁the", "▁government", "▁said", "▁idiot", "<0x0A>", "the", "▁government"] and r["round_trip"]
    c = C.fitted(df)
    assert np.exp(c.scores).sum() == pytest.approx(1) and (c.scores <= 0).all()
    share = lambda p: np.exp(c.scores[c.pieces.index(p)])
    assert share("▁government") / share("▁said") == pytest.approx(100.5 / 50.5)


def test_all_texts_are_counted(spark):
    """In whatever portions, the counts are those of the library over every text."""
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [w + " " + v for w, v in zip(words(), words()[7:]) if MARKER not in w + v]
    n = np.full(m.vocab_size(), 0.5)
    for t in texts:
        np.add.at(n, m.encode(t), 1)
    c = C.fitted(frame(spark, [(k, t, "en", "a", 1) for k, t in enumerate(texts)]))
    assert np.allclose(c.scores, np.log(n / n.sum()))
