"""Language identification with bitmask n-gram filters.

Per language the n-grams of its letters that are frequent in it go into a Bloom filter. All languages' filters share
their hash functions and are stored sliced: a slot holds one bit per language, so the slots of an n-gram, combined with
AND, give at once all languages whose filter has it. A text's n-grams are looked up together; the counts per language
are corrected for that filter's false-positive rate, and the language with the largest corrected count wins (of equal
ones the first by name).

A null text, or one without a letter, is `und` with score 0. With nothing to learn from, an empty table too, every text is
`und`; of an empty table the result is empty. A text none of whose n-grams is known gets the most frequent language with
score 0; of languages with equal counts (ties) the first by name wins. Repeated rows are judged alike. Long texts are worked
through in pieces, and no n-gram is lost or made up where one ends. Columns with clashing names keep them, the added ones
take free names. The filter is fitted on a sample: about `fit_docs` documents of each language. It holds every n-gram that is in `share` of a language's
sampled texts or more, so no language crowds out another. The shares of a language's n-grams add up to the distinct n-grams of its mean text:
with one in 500 texts, at most 500 times as many are read by the driver and broadcast, whatever the input's size or the script's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialize
from .common import free, sliced, small_batches

#: n-grams of so many characters; a word's edges count as characters.
ORDERS = (2, 3)
#: Characters of a long text looked at in one piece.
PIECE = 1 << 18
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def gram_pieces(text: str) -> Iterator[np.ndarray]:
    """64-bit codes of all n-grams of the text's letters, lower-cased, words set apart by one mark; piece by piece, each with
    the end of what came before it."""
    low = text.lower()
    before, after_letter = np.zeros(1, np.uint64), False
    for at in range(0, len(low) + 1, PIECE):
        codes = np.frombuffer(low[at : at + PIECE].encode("utf-32-le", "replace"), np.uint32)
        letter = _letter_table()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        if len(keep):
            keep[0] |= after_letter
            after_letter = bool(letter[-1])
        last = [0] if after_letter and at + PIECE > len(low) else []  # else the text has ended with a mark
        x = np.concatenate((before, np.where(letter, codes, np.uint32(0))[keep], last)).astype(np.uint64)
        out = []
        for n in ORDERS:
            y = x[max(0, len(before) - n + 1) :]
            if len(y) >= n:
                code = np.full(len(y) - n + 1, n, np.uint64)
                for k in range(n):
                    code = (code << np.uint64(20)) | y[k : len(y) - n + 1 + k]
                out.append(code)
        before = x[-(max(ORDERS) - 1) :]
        if out:
            yield np.concatenate(out)


def grams(text: str) -> np.ndarray:
    """All of gram_pieces()."""
    return np.concatenate([*gram_pieces(text), np.zeros(0, np.uint64)])


def _slots(codes: np.ndarray, n_slots: int) -> list[np.ndarray]:
    out = []
    for m in _MULTIPLIERS:
        h = codes * m
        h ^= h >> np.uint64(29)
        h *= m
        out.append((h >> np.uint64(32)).astype(np.int64) & (n_slots - 1))
    return out


@dataclass
class SlicedFilter:
    """slots[s, w]: bit b of word w is set if language 64 * w + b has something at slot s."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    common: str

    @classmethod
    def of(cls, held: dict[str, np.ndarray], common: str, slots_per_gram: int = 16) -> SlicedFilter:
        languages = sorted(held)
        most = max((len(x) for x in held.values()), default=1)
        n = 1 << max(12, int(np.ceil(np.log2(slots_per_gram * max(most, 1)))))
        slots = np.zeros((n, -(-len(languages) // 64)), np.uint64)
        rate = np.zeros(len(languages))
        for k, name in enumerate(languages):
            for s in _slots(held[name], n):
                slots[s, k // 64] |= np.uint64(1) << np.uint64(k % 64)
            filled = (slots[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean()
            rate[k] = filled ** len(_MULTIPLIERS)
        return cls(languages, slots, rate, common)

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """For each n-gram, the words of bits of the languages that have it (and some that seem to)."""
        a, b = _slots(codes, len(self.slots))
        return self.slots[a] & self.slots[b]

    def predict(self, text: str | None) -> tuple[str, float]:
        counts, total = np.zeros(len(self.languages)), 0
        for codes in gram_pieces(text or ""):
            total += len(codes)
            m = self.masks(codes)
            for k in range(len(self.languages)):
                counts[k] += np.count_nonzero(m[:, k // 64] & (np.uint64(1) << np.uint64(k % 64)))
        if not total or not self.languages:
            return "und", 0.0
        counts = np.maximum(0, (counts - total * self.false_rate) / (1 - self.false_rate))
        k = int(np.argmax(counts))
        return (self.languages[k], float(min(1, counts[k] / total))) if counts[k] > 0 else (self.common, 0.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n), summed over some megabytes of text at a time."""
    for batch in sliced(batches, "text", 8 << 20):
        texts: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = [np.unique(x) for x in gram_pieces(text)]
            if found:  # a text counts once, in however many pieces
                texts.setdefault(lang, []).append(found[0] if len(found) == 1 else np.unique(np.concatenate(found)))
        for lang, parts in texts.items():
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", fit_docs: int = 5_000, share: float = 0.002, least: int = 3, ratio: float = 0.2) -> SlicedFilter:
    """Learn from rows with a language; about fit_docs of each, those with the least hashes of their ids.

    An n-gram belongs to a language if it is in `least` of its texts and in `share` of them or more, and its share of that language's texts is at least
    `ratio` of its largest share in any language: passages of another language leave no trace.
    """
    small_batches(labelled.sparkSession)
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    # written, so that the sizes of the languages are known to be small and the texts stay where they are
    sizes = materialize(known.groupBy("lang").agg(F.count("*").alias("rows")))
    order = F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1 << 30))
    sample = materialize(known.join(sizes, "lang").where(order < F.lit(fit_docs) / F.col("rows") * (1 << 30)).select("lang", "text"))
    per = sample.groupBy("lang").agg(F.count("*").alias("docs"))
    counts = materialize(sample.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    shares = counts.join(per, "lang").where(F.col("n") >= share * F.col("docs")).select("lang", "gram", (F.col("n") / F.col("docs")).alias("share"))
    rows = shares.join(shares.groupBy("gram").agg(F.max("share").alias("most")), "gram").where(F.col("share") >= ratio * F.col("most")).select("lang", "gram").toPandas()
    docs = {r["lang"]: r["rows"] for r in sizes.collect()}
    for x in (sizes, sample, counts):
        discard(x)
    held = {name: np.sort(part["gram"].to_numpy()).view(np.uint64) for name, part in rows.groupby("lang")}
    return SlicedFilter.of(held, max(sorted(docs), key=docs.get) if docs else "und")


def predictor(df: DataFrame, model: SlicedFilter):
    """A column function: text -> struct(lang string, score double)."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: pa.Array) -> pa.Array:
        got = [shared.value.predict(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang", "score"])

    return predict


def identify(df: DataFrame, model: SlicedFilter, text: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    got, lang, score = free(df, "l_got", "lang_pred", "score")
    x = df.withColumn(got, predictor(df, model)(F.col(text)))
    return x.withColumn(lang, F.col(got)["lang"]).withColumn(score, F.col(got)["score"]).drop(got)


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def op7(df: DataFrame) -> DataFrame:
    """The digest of the contract."""
    out = held_out(F.col("doc_id"), 4, 2)
    model = fit(df.where(~out).select("doc_id", "text", "lang"))
    x = identify(df.select("doc_id", "text"), model)
    return x.select("doc_id", out.alias("held_out"), "lang_pred", "score")
