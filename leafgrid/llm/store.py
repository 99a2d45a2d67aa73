"""Intermediate tables in the folder that all executors share.

A written table cuts lineage and survives a lost executor. The folder is the one
named by ``spark.checkpoint.dir``; a session without one gets a local folder of its own if all
its tasks run on this machine, and an error otherwise. Tables go when they are forgotten, or
when the driver's process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

from leafgrid.session import importable

#: Rows in one Arrow batch: documents may be long, so that a batch stays small.
ARROW_ROWS = "500"

_made: dict[str, SparkSession] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="leafgrid-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; removed at exit."""
    path = f"{shared_folder(spark)}/leafgrid-{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write the rows to the shared folder and return them read back; ``by``: a column that parts the files."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    _paths[out] = path
    return out


def forget(kept: DataFrame, part: str = "") -> None:
    """Remove a kept table, or a part of one (``column=value``), that no later step reads.

    The collection lets Spark remove the shuffle files of finished steps as well.
    """
    spark = kept.sparkSession
    path = _paths[kept]
    drop_path(spark, f"{path}/{part}" if part else path)
    if not part:
        _made.pop(path, None)
    spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path, wherever the shared folder lives."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small for this session, as texts may be long, and let its workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    importable(spark)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):
            drop_path(spark, path)
