"""Session defaults for local runs, tests and the bench; a cluster brings its own."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "leafgrid") -> SparkSession:
    """A local session; settings that a running session already has win."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the driver and all executors share; a session of this machine alone gets one of its own."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="leafgrid-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


_made: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; removed when the driver ends."""
    path = f"{shared_folder(spark)}/leafgrid-{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


@atexit.register
def _drop_all() -> None:
    for path, spark in _made.items():
        with contextlib.suppress(Exception):  # the session may be gone
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_sent: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Let the session's workers import this package; it is sent to them where they can't."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    path = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.master.split("[")[0] == "local":  # workers of this process alone share its folder
        path.append(".")
    if root in {Path(p).resolve() for p in path} or context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(root / "leafgrid", Path(folder, "p", "leafgrid"), ignore=shutil.ignore_patterns("__pycache__"))
        kept = Path(tempfile.mkdtemp(prefix="leafgrid-package-"))  # Spark serves the file for as long as the session lives
        context.addPyFile(shutil.make_archive(str(kept / "leafgrid"), "zip", Path(folder, "p")))


def staged(rows: DataFrame) -> DataFrame:
    """The rows worked out once, in the checkpoint folder, so that later stages do not repeat earlier ones."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()
