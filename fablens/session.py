"""Session helpers: a local session for tests and benches, and shared scratch folders."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scope = threading.local()


def local_session(cpus: int | str = 8, name: str = "fablens") -> SparkSession:
    """Session used by tests and the bench. On a cluster the caller's own session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        # Driver and executors are one process here, so a folder of this machine is shared by all.
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fablens-"))
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, named by the cluster in ``spark.checkpoint.dir`` or by setCheckpointDir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables that a job writes and reads back."""
    path = f"{shared_folder(spark)}/fablens/{name}-{uuid.uuid4().hex}"
    if getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete all scratch tables made inside, when the block is left. Results must have been written by then."""
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
    finally:
        for path in _scope.paths:
            remove_path(spark, path)
        _scope.paths = outer


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written by the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """What write_text has written; None if there is no such file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return None
    source = system.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a frame once as Parquet in the shared folder and go on from there; later reads prune columns.

    This cuts the lineage for good, and what was computed survives the loss of executors. `options` are the writer's.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
