"""Session set-up and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session comes from outside."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("memlattice")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in a local session without it a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="memlattice-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that is this application's."""
    return f"{shared_dir(spark)}/memlattice/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _table_name(spark: SparkSession) -> str:
    return "memlattice_" + re.sub(r"\W", "_", spark.sparkContext.applicationId).lower()


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written in the shared folder, once no frame over them is read any more."""
    written = _written(spark)
    for path, name in list(written.items()):
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        written.pop(path)
    _delete(spark, own_dir(spark))


def _written(spark: SparkSession) -> dict[str, str | None]:
    """Path -> name in the catalogue, if it has one, of this application's tables. When Python ends they go."""
    sc = spark.sparkContext
    if not hasattr(sc, "_memlattice_written"):
        sc._memlattice_written = {}

        def end() -> None:
            with suppress(Exception):  # the session may have gone before
                if sc._jsc is not None:
                    clear(spark)

        atexit.register(end)
    return sc._memlattice_written


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that are written in here are deleted at its end, but for those of the frames put into the list."""
    before, kept = set(_written(spark)), []
    yield kept
    stay = before | {getattr(df, "_memlattice_path", None) for df in kept}
    for path in [x for x in _written(spark) if x not in stay]:
        _discard(spark, path)


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there, whichever executor is lost."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    _written(spark)[path] = None
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._memlattice_path = path
    return out


def materialize_sorted(df: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """Write df as a table dealt into buckets by a hash of the keys, each sorted by them, and read it back. Joins and sums by
    these keys of tables with as many buckets need no exchange, and in_order() spares the joins' sorts where df was dealt out
    by the keys already, as after a groupBy: each bucket is then one file."""
    spark = df.sparkSession
    name = f"{_table_name(spark)}_{uuid.uuid4().hex}"
    path = f"{own_dir(spark)}/{name}"
    _written(spark)[path] = name
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._memlattice_path = path
    return out


#: Buckets are one sorted file each; and a bucketed scan stays one, even where a plan above a union is only right for buckets.
_IN_ORDER = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


@contextmanager
def in_order(spark: SparkSession) -> Iterator[None]:
    """Plans made and run in here read the tables of materialize_sorted() as they lie: dealt out and sorted."""
    before = {key: spark.conf.get(key) for key in _IN_ORDER}
    try:
        for key, value in _IN_ORDER.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _discard(spark: SparkSession, path: str) -> None:
    if name := _written(spark).pop(path, None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that materialize() or materialize_sorted() returned, once nothing reads it any more."""
    if path := getattr(df, "_memlattice_path", None):
        _discard(df.sparkSession, path)


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished queries now, not at the driver's next garbage collection: tables that have been
    written in their place make them useless, and an operator of many steps would keep all of them until its end."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python, once per application: they may not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_memlattice_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="memlattice-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "memlattice.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for top, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    z.write(path, os.path.join("memlattice", os.path.relpath(path, here)))
    sc.addPyFile(archive)
    sc._memlattice_shipped = True
