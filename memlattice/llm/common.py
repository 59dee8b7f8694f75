"""What several operators share: word patterns, free column names, small batches for Python."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import let_go, ship  # noqa: F401

#: White space of the contracts, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have yet, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """The runs of characters other than white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand Python this package, and at most so many rows at once: texts may be long, and workers' memory is bounded."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the column's values in each come to about most_bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(batch.schema.get_field_index(column)).nbytes
        step = max(1, int(batch.num_rows * most_bytes / max(sizes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
