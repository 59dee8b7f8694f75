"""A training corpus from documents: quality rules, line dedup, near-dedup, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents, extra ones included, whatever they are called. Texts are worked through whole, however long. Of an empty
table every stage returns an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlattice.llm import line_dedup, quality_rules, sentencepiece_codec, simhash, source_mix
from memlattice.session import discard, materialize, passing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule. Null and empty texts don't; repeated rows and null ids are judged like any other."""
    return quality_rules.stage(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that many of them share: of the holders of a line the one with the largest id keeps it, repeated
    rows of it too. Null texts become empty; rows with a null id lose no line; a document may become empty, and stays."""
    return line_dedup.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id; of its repeated rows one. Null and empty texts are copies of
    each other; rows with a null id all stay."""
    return simhash.stage(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate has it, perhaps never. A null source is one of its own; null ids share a draw, and so
    do repeated rows; empty texts have size 0 and are taken like the others of their source."""
    return source_mix.stage(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, how many they are, and whether they decode to the text. A null text has null ids, an empty one
    none; equal texts have equal ids."""
    return sentencepiece_codec.stage(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("source_mix", mixed), ("sentencepiece", encoded)]

#: XXH64 fingerprints, components and Viterbi are beyond SQL: tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with passing(spark) as kept:
            kept.append(materialize(stage(spark, docs, sf_dir)))
        discard(docs)
        docs = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)
