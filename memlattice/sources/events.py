"""A catalogue of counter events, from a table: which units count what, with which attributes."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a catalogue; a row without an attribute describes the event itself.
SCHEMA = "pmu string, event string, description string, attribute string, attribute_description string"
#: Characters of a line of a listing.
WIDTH = 100


def read(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue from CSV with a header, JSON lines or Parquet, by the end of its name."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, schema=SCHEMA)
    return spark.read.schema(SCHEMA).json(path) if path.endswith(".json") else spark.read.parquet(path)


def catalogue(df: DataFrame) -> DataFrame:
    """(pmu, event, name, description, attributes): one row for each event, attributes by name."""
    attribute = F.when(F.col("attribute").isNotNull(), F.struct("attribute", F.coalesce("attribute_description", F.lit("")).alias("description")))
    out = df.groupBy("pmu", "event").agg(F.max("description").alias("description"), F.sort_array(F.collect_set(attribute)).alias("attributes"))
    return out.select("pmu", "event", F.concat("pmu", F.lit("::"), "event").alias("name"), F.coalesce("description", F.lit("")).alias("description"), "attributes")


def listing(df: DataFrame, width: int = WIDTH) -> str:
    """The catalogue as a Markdown list: a heading for each unit, an item for each event, and below it one for each attribute. Long
    lines are wrapped and hang under their item. Rows come to the driver one by one, in order."""

    def item(depth: int, name: str, text: str) -> str:
        lead = "  " * depth
        return textwrap.fill(f"`{name}`" + (f": {text}" if text else ""), width, initial_indent=f"{lead}- ", subsequent_indent=f"{lead}  ", break_long_words=False)

    parts, unit = [], object()
    for r in catalogue(df).orderBy("pmu", "event").toLocalIterator():
        if r["pmu"] != unit:
            unit = r["pmu"]
            parts.append(f"## {unit}")
        parts.append("\n".join([item(0, r["event"], r["description"]), *(item(1, a["attribute"], a["description"]) for a in r["attributes"])]))
    return "\n\n".join(parts) + "\n" * bool(parts)
