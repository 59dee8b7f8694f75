"""The driver's tables as matrices and samples."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import SparseMatrix
from ..operators.position import positioned
from ..session import own_dir
from ..sources.config import TraceConfig, parse, read

#: Sizes and line sizes of the caches, by name. Threads 0 and 1 have private ones under "left", 2 and 3 smaller ones under "right",
#: whose lines are longer; all share "all"; no thread reaches "spare".
SIZES = {"a0": (16384, 64), "a1": (16384, 64), "b2": (8192, 64), "b3": (8192, 64), "left": (131072, 64), "right": (65536, 128), "all": (1048576, 128), "spare": (4096, 64)}
#: The same caches with a few lines each.
SMALL_SIZES = {"a0": (256, 64), "a1": (256, 64), "b2": (128, 64), "b3": (128, 64), "left": (512, 64), "right": (768, 128), "all": (1024, 128), "spare": (64, 64)}
PARENTS = {"a0": "left", "a1": "left", "b2": "right", "b3": "right", "left": "all", "right": "all"}


def config_text(sizes: dict[str, tuple[int, int]] = SIZES) -> str:
    caches = {
        name: {"size": size, "line_size": line, "bandwidth": None, "bandwidth_per_numa_domain": None, "cache_miss_event": f"{name}-misses", "parent": PARENTS.get(name)}
        for name, (size, line) in sizes.items()
    }
    events = [["click", "view"], ["click"], ["purchase", "view", "click"], []]
    threads = [{"cpu": n, "cache": c, "numa_domain": n // 2, "event_groups": [{"pid": -1, "cpu": n, "events": events[n]}, {"pid": -1, "cpu": n, "events": ["view"]}]} for n, c in enumerate(("a0", "a1", "b2", "b3"))]
    return json.dumps({"name": "four threads", "description": "two pairs under one", "num_numa_domains": 2, "bandwidth_per_numa_domain": None, "caches": caches, "thread_affinities": threads})


def config(sizes: dict[str, tuple[int, int]] = SIZES) -> TraceConfig:
    return parse(config_text(sizes))


def config_file(spark: SparkSession) -> TraceConfig:
    """The same, written to and read from the shared folder."""
    path = f"{own_dir(spark)}/config-{uuid.uuid4().hex}"
    spark.createDataFrame([(config_text(),)], "value string").coalesce(1).write.text(path)
    return read(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_matrix(spark: SparkSession, sf_dir: str, numbered: bool = True) -> SparseMatrix:
    """Orders x parts, quantities as values. numbered: with positions (which products and counts don't need)."""
    rows = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] + 1
    cols = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 1
    x = table(spark, sf_dir, "lineitem")
    pick = [F.col("l_orderkey").cast("long").alias("i"), F.col("l_partkey").cast("long").alias("j"), F.col("l_quantity").cast("double").alias("a")]
    if not numbered:
        return SparseMatrix(x.select(F.lit(0).cast("long").alias("k"), *pick), rows, cols)
    x = positioned(x.select(*pick, "l_suppkey", "l_linenumber", "l_shipdate"), ["i", "j", "l_suppkey", "l_linenumber", "l_shipdate"], "k")
    return SparseMatrix(x.select("k", "i", "j", "a"), rows, cols)


def square_matrix(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Suppliers and parts in one numbering: quantities by (supplier, part)."""
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 1
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("i"), F.col("l_partkey").cast("long").alias("j")).agg(F.sum("l_quantity").cast("double").alias("a"))
    return SparseMatrix(positioned(x, ["i", "j"], "k").select("k", "i", "j", "a"), n, n)


def part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector x: p_size by part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("idx"), F.col("p_size").cast("double").alias("v"))


def nation_matrix(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Regions x nations: one entry for each nation, all of value 1."""
    rows = table(spark, sf_dir, "region").agg(F.max("r_regionkey")).first()[0] + 1
    cols = table(spark, sf_dir, "nation").agg(F.max("n_nationkey")).first()[0] + 1
    x = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("i"), F.col("n_nationkey").cast("long").alias("j"), F.lit(1.0).alias("a"))
    return SparseMatrix(positioned(x, ["i", "j"], "k").select("k", "i", "j", "a"), rows, cols)


def customer_graph(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Customers, each of whom leads to four others, or some of them more than once."""
    c = table(spark, sf_dir, "customer")
    n = c.agg(F.max("c_custkey")).first()[0] + 1
    far = F.explode(F.array(*(F.lit(400 * m * m) for m in range(4))))
    x = c.select("c_custkey", "c_nationkey", far.alias("far"))
    x = x.select(F.col("c_custkey").cast("long").alias("i"), ((7 * F.col("c_custkey") + F.col("c_nationkey") + F.col("far")) % n).cast("long").alias("j"), F.lit(1.0).alias("a"))
    return SparseMatrix(positioned(x, ["i", "j"], "k").select("k", "i", "j", "a"), n, n)


def bought_together(spark: SparkSession, sf_dir: str, classes: int = 8) -> SparseMatrix:
    """Parts of one order, those of the same class by number, and of every 50th order all: a graph with planted communities."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("long").alias("i"))
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 1
    pairs = x.join(x.withColumnRenamed("i", "j"), "l_orderkey").where(F.col("i") < F.col("j"))
    pairs = pairs.where((F.col("i") % classes == F.col("j") % classes) | (F.col("l_orderkey") % 50 == 0)).select("i", "j").distinct()
    return SparseMatrix(pairs.select(F.lit(0).cast("long").alias("k"), "i", "j", F.lit(1.0).alias("a")), n, n)
