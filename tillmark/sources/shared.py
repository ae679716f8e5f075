"""Tables written to the folder that all executors share.

A written table cuts the lineage: if an executor is lost later, its rows are read again, not recomputed. The folder is
``spark.checkpoint.dir``; a session without that setting uses a folder in its warehouse, which is shared as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: The compression of whole facts: two thirds of the bytes that Spark's usual one takes.
FACTS = "zstd"
#: Spark's switch for removing what a query has shuffled when the query ends.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """While it lasts, what a query shuffles is removed from the executors' disks when the query ends. Otherwise it stays until the driver
    collects its garbage, which depends on the driver's heap and not on the disks, and the steps of a job add up there."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getConf().get(SETTING) or context.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *folders: str, codec: str | None = None) -> DataFrame:
    """The same rows, written once as parquet and read back, split into ``folders`` by the columns named. ``discard`` removes the
    files. Whole facts are written with ``codec`` FACTS; other tables by the session's setting."""
    path = new_folder(df.sparkSession, name)
    with swept(df.sparkSession):
        df.write.partitionBy(*folders).parquet(path, compression=codec)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Removes the files of tables from ``written`` that nothing reads any more; other tables are left alone."""
    for table in tables:
        path = getattr(table, "__dict__", {}).get("_written_at")
        if path:
            remove(table.sparkSession, path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.delete(place, True)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names of what lies in a folder, in order; none if there is no such folder."""
    system, place = _place(spark, folder)
    return sorted(x.getPath().getName() for x in system.listStatus(place)) if system.exists(place) else []


def mark(spark: SparkSession, path: str) -> None:
    """Creates an empty file that must not be there yet; on every store that is one step, there or not there."""
    system, place = _place(spark, path)
    system.create(place, False).close()
