"""Session for local use, and the shared folder for stage tables."""

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus or os.cpu_count()}]")
        .appName("quillmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="quillmark-")


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir``.

    A folder of this machine stands in only where the whole of Spark runs on it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder()


_RUNS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """Unused path for one table below the shared folder, or that of the open run."""
    folder = _RUNS[-1] if _RUNS else shared_folder(spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """One folder for all tables staged inside the block, deleted at its end.

    Results that are to outlive the block have to be written or collected in it.
    """
    folder = new_path(spark, "run")
    _RUNS.append(folder)
    try:
        yield folder
    finally:
        _RUNS.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """From here on, Python workers of this session get batches of about 4 MB, not of up to 64 MB.

    A batch of whole texts is held several times over by the executor and its
    worker. Rows and their order do not depend on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run inside the block leaves no shuffle files behind once it has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, True)
    try:
        yield
    finally:
        spark.conf.set(name, before)
