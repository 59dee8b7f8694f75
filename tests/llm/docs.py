"""Awkward documents for every operator."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven grey owls sing under pale winter moons above quiet hills".split()


def sentence(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def awkward():
    """Null and empty fields, white space only, copies, repeated rows, a very long text."""
    long = "\n".join(sentence(k, 40) for k in range(400))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \t\n ", None, "a", 4), (4, "one", "fr", "b", 3), (5, "one two", None, None, 7),
        (6, sentence(1, 80), "en", "a", 1), (7, sentence(1, 80), "en", "b", 1), (8, sentence(1, 79) + " changed", "en", "a", 1), (6, sentence(1, 80), "en", "a", 1),
        (9, long, "en", "a", 1), (10, "ÄÖÜ ß " + sentence(2, 60), "de", "b", 1), (11, "x " * 200, "en", "c", 1), (12, sentence(3, 60) + " ###$$$ | <b>", "en", "c", 1),
        (None, sentence(4, 60), "en", "a", 1), (13, "▁ odd ▁marker 😀 \x00  ", "en", "a", 1),
    ]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def clashing(df):
    """With columns named like the operators' own."""
    from pyspark.sql import functions as F

    for c in ("size", "copies", "rate", "target", "ledger", "kept_text", "n_lines", "n_dropped", "ids", "n_tokens", "round_trip", "q_base", "m_source", "score", "host", "path", "rule", "verdict", "fp", "component", "l_gone"):
        df = df.withColumn(c, F.lit("mine"))
    return df
