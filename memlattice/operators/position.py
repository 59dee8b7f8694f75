"""Dense global positions without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def positioned(df: DataFrame, order: list[Column | str], name: str = "k") -> DataFrame:
    """df with a column that numbers its rows from 0 in the given order, which has to be total.

    The rows are range-partitioned and sorted where they are; each partition's count then gives the next one's offset.
    A hot key is only a stretch of the order, so it is spread like any other rows. The sorted rows are written once: both
    the counting and the numbering read the same partitions. What is broadcast is one row per partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    x = materialize(x.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = x.groupBy("_part").agg(F.count("*").alias("_n")).collect()
    start, offsets = 0, {}
    for r in sorted(counts):
        offsets[r["_part"]] = start
        start += r["_n"]
    table = df.sparkSession.createDataFrame(sorted(offsets.items()), "_part int, _start long")
    return x.join(F.broadcast(table), "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")
