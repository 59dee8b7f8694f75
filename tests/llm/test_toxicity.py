import random
import re

import pytest
from pyspark.sql import functions as F

from memlattice.llm import toxicity as X
from memlattice.llm.toxicity import LexiconAutomaton, allowance

from .docs import awkward, clashing, frame


def distance(a: str, b: str) -> int:
    """Edits, with swaps of neighbours (restricted Damerau-Levenshtein)."""
    d = {(-1, -1): 0}
    for i in range(-1, len(a)):
        for j in range(-1, len(b)):
            if i < 0 or j < 0:
                d[i, j] = max(i, j) + 1
                continue
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def found(auto: LexiconAutomaton, word: str):
    codes, starts, ends = X.spans(word)
    hits = list(zip(*auto.finds(codes, starts, ends)))
    return [(auto.terms[t], int(e)) for _, t, e in hits]


def test_automaton_accepts_what_is_near_enough():
    terms = ["idiot", "scum", "disgusting", "dumb", "bad", "éclat"]
    auto = LexiconAutomaton(terms)
    r = random.Random(5)
    seen = set()
    for _ in range(3000):
        w = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(w) + 1)
            kind = r.randrange(4)
            if kind == 0:
                w.insert(k, r.choice("abidosu0é"))
            elif kind == 1 and k < len(w) and len(w) > 1:
                del w[k]
            elif kind == 2 and k < len(w):
                w[k] = r.choice("abidosu0é")
            elif k + 1 < len(w):
                w[k], w[k + 1] = w[k + 1], w[k]
        word = "".join(w)
        near = {t: distance(word, t) for t in terms if distance(word, t) <= allowance(t)}
        got = found(auto, word)
        assert bool(got) == bool(near), (word, near, got)
        if got:
            term, level = got[0]
            assert near[term] == min(near.values()) and level == (near[term] and near[term] + 1)
            seen.add(level)
    assert seen == {0, 2, 3}


def test_stems():
    auto = LexiconAutomaton(["réeux+", "moron"])
    assert found(auto, "réeuxment") == [("réeux+", 1)] and found(auto, "réeux") == [] and found(auto, "réeuX" + "a" * 60)
    assert found(auto, "réeu") == [] and found(auto, "mroon") == [("moron", 2)]


def lexicon():
    auto = LexiconAutomaton(["idiot"])
    likely = {("idiot", 0, "plain"): 0.9, ("idiot", 0, "quoted"): 0.2, ("idiot", 0, "aimed"): 0.95, ("idiot", 2, "plain"): 0.6}
    return X.Lexicon(auto, likely, 0.05)


def test_context_tells_quotation_from_abuse():
    lex = lexicon()
    kinds = lambda t: [k for *_, k in lex.finds(t)]
    assert kinds("what an Idiot!") == ["plain"] and kinds("you idiot") == ["aimed"]
    assert kinds('they wrote "idiot" there') == ["quoted"] and kinds("the slur idiot is old") == ["quoted"] and kinds("a «mere idiot» then") == ["quoted"]
    assert lex.score("you idiot") > lex.score("an idiot") > lex.score("an idoit") > lex.score('"idiot"') > lex.score("fine")
    assert lex.score(None) == lex.score("") == pytest.approx(0.05)


def test_long_texts_are_read_whole(monkeypatch):
    """Wherever a text is cut: the same finds of the same kinds."""
    r = random.Random(3)
    texts = ["calm words here " * 40 + "idiot " + "calm " * 30 + "idoit", " they wrote idiot there", "x" * 300 + " idiot", "\n\t idiot\u00a0idiot ", "İ" * 40 + ' said "idiot" İ']
    for _ in range(30):
        texts.append("".join(r.choice(["idiot", "you", "said", "«", "»", " ", " ", "\n", "calm", '"', "idoit", "...", "İ"]) + r.choice(["", " "]) for _ in range(120)))
    whole = [lexicon().finds(t) for t in texts]
    assert [(w, e) for w, _, _, e, _ in whole[0]] == [(120, 0), (151, 2)] and {k for x in whole for *_, k in x} == set(X.KINDS)
    for piece in (1, 5, 23, 50):
        monkeypatch.setattr(X, "PIECE", piece)
        assert [lexicon().finds(t) for t in texts] == whole


def test_quotation_and_address_in_other_languages():
    kinds = lambda t: [k for *_, k in lexicon().finds(t)]
    assert kinds("er sagte idiot dort") == kinds("il a écrit idiot hier") == kinds("la palabra idiot es vieja") == ["quoted"]
    assert kinds("du bist ein idiot") == kinds("vous êtes idiot") == kinds("eres tú un idiot") == ["aimed"]


def by_hand(lex, text):
    """The score, word by word: distances to all terms, windows of words, likelihoods."""
    words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\t-\r ]+", (text or "").lower())]
    plain = re.compile(r"[a-z0-9\u00c0-\U0010ffff]")
    bare = []
    for w, s, _ in words:
        at = [m.start() for m in plain.finditer(w)]
        bare.append((w[at[0] : at[-1] + 1], s + at[0], s + at[-1] + 1) if at else ("", s, s))
    seen = set()
    for k, (w, s, e) in enumerate(bare):
        near = []
        for t in lex.automaton.terms if w else ():
            if t.endswith("+"):
                near += [(0, True, t)] if w.startswith(t[:-1]) and len(w) >= len(t) else []
            elif (d := distance(w, t)) <= allowance(t):
                near.append((d, False, t))
        if not near:
            continue
        d, stem, term = min(near)
        a, b = max(0, k - 5), min(len(bare), k + 6)
        low = (text or "").lower()
        before, after = low[bare[a - 1][2] if a else 0 : s], low[e : bare[b][1] if b < len(bare) else len(low)]
        around = {bare[x][0].replace("'", "").replace("’", "") for x in range(a, b) if x != k}
        quoted = around & X.REPORTING or (any(q in before for q in X.QUOTES) and any(q in after for q in X.QUOTES))
        seen.add((w, term, 1 if stem else d and d + 1, "quoted" if quoted else "aimed" if around & X.AIMED else "plain"))
    clean = 1 - lex.base
    for _, *f in seen:
        clean *= 1 - lex.likely.get(tuple(f), lex.base)
    return 1 - clean


def corpus(n=600):
    r = random.Random(2)
    base = "river stone cloud meadow lantern window garden bridge letter market candle forest orchard".split()
    docs, labels = [], []
    for k in range(n):
        ws = [r.choice(base) + r.choice("aeiou") * r.randrange(2) for _ in range(60)]
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                ws[r.randrange(60)] = r.choice(["vilething", "grumpface", "nastol" + r.choice(["ed", "er", "ung", "is"])])
        docs.append((k, " ".join(ws), "en", "a", 1))
        labels.append((k, 1, int(bad)))
    return docs, labels


def test_learned_on_some_right_on_the_others(spark):
    docs, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lex = X.learned(frame(spark, docs), lab, ~X.held_out(F.col("doc_id"), 3, 1), least=4)
    assert {"vilething", "grumpface"} <= set(lex.automaton.terms) and any(t.startswith("nast") and t.endswith("+") for t in lex.automaton.terms)
    rows = X.op3(frame(spark, docs), lab).join(lab, "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert 100 < len(out) < 300 and all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.97 * len(out)
    hits = frame(spark, docs[:1]).select(X.finder(spark.range(1), lex)("text").alias("f")).first()["f"]
    assert hits and hits[0]["level"] in (0, 1)


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(200)
    out = {r["doc_id"] for r in frame(spark, docs).where(X.held_out(F.col("doc_id"), 3, 1)).collect()}
    flipped = [(d, q, 1 - t if d in out else t) for d, q, t in labels]
    a, b = (X.op3(frame(spark, docs), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect() for x in (labels, flipped))
    assert sorted(a) == sorted(b)


def test_awkward_documents_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = X.op3(frame(spark), none).collect()
    assert len(rows) == len(awkward()) and {r["score"] for r in rows} == {0.0}
    assert X.op3(frame(spark, []), none).count() == 0
    docs, labels = corpus(100)
    more = X.op3(frame(spark, docs + awkward()), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert more.count() == 100 + len(awkward()) and more.where("score is null or held_out is null").count() == 0


def test_real_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = X.op3(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.95


def test_rare_language_beside_a_frequent_one(spark):
    """A term is judged by its own evidence, in any script, however often another one stands."""
    r = random.Random(6)
    mine, theirs = [["".join(r.choice(x) for _ in range(6)) for _ in range(300)] for x in ("aeiouklmnrst", "абвгдежиклмн")]
    rows = []
    for k in range(900):
        few = k % 30 == 0
        ws = [r.choice(theirs if few else mine) for _ in range(40)]
        toxic = int(k % 3 == 0)
        if toxic:
            ws[r.randrange(1, 39)] = "ублюдок" if few else "vilething"
        rows.append((k, " ".join(ws), toxic))
    lex = X.fit(spark.createDataFrame(rows, "id long, text string, toxic int"))
    assert {"vilething", "ублюдок"} <= set(lex.automaton.terms)
    assert lex.score(" ".join(theirs[:9] + ["ублюдок"])) > 0.7 > lex.score(" ".join(theirs[:9]))
    assert found(lex.automaton, "ублюдак") == [("ублюдок", 2)] and found(lex.automaton, "лишние") == []


def test_query_by_hand(spark):
    """Every score of the query over whole texts, from the same lexicon."""
    docs, labels = corpus(300)
    docs += [(1000 + k, t, "en", "a", 1) for k, t in enumerate(["you vilethign", 'he said "grumpface" once', "nastolest of all, vilething vilething", "(grumpface)", "", None])] + awkward()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lex = X.learned(frame(spark, docs), lab, ~X.held_out(F.col("doc_id"), 3, 1))
    want = sorted((str(d), round(by_hand(lex, t), 9)) for d, t, *_ in docs)
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in X.op3(frame(spark, docs), lab).collect()) == want
    assert len({x for _, x in want}) > 5


def test_short_and_long_terms(spark):
    r = random.Random(8)
    rows = []
    for k in range(600):
        ws = ["".join(r.choice("eioumnrst") for _ in range(6)) for _ in range(30)]
        if k % 3 == 0:
            ws[r.randrange(1, 29)] = r.choice(["zyx", "verylongabusivetermofthirtyletters"])
        rows.append((k, " ".join(ws), int(k % 3 == 0)))
    lex = X.fit(spark.createDataFrame(rows, "id long, text string, toxic int"))
    assert lex.score("so zyx then") > 0.7 and lex.score("so verylongabusivetermofthirtyletters then") > 0.7 > lex.score("so zya then")


def test_clashing_columns(spark):
    df = clashing(frame(spark))
    out = X.score(df, lexicon())
    assert out.columns == [*df.columns, "_score"] and out.where("score <> 'mine' or _score is null").count() == 0
