"""Tables in the folder that driver and executors share: they cut lineage, survive lost executors, and go when they are done with."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of this machine in local mode (as in tests), else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        local = spark.sparkContext.master.startswith("local")
        folder = tempfile.mkdtemp(prefix="procloom-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_procloom"
        if not local and spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share: {folder} is one of this machine")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())).delete(at, True)


#: Folders of this process's applications, whose tables are deleted at its end.
_folders: set[str] = set()


def _own_folder(spark: SparkSession) -> str:
    """Where this application's tables are. What results still read is deleted when the process ends."""
    path = f"{shared_folder(spark)}/procloom/{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration()))

        def clear() -> None:
            try:
                files.delete(at, True)
            except (Py4JError, OSError):  # the JVM has ended first
                return

        atexit.register(clear)
    return path


#: Tables of the computations under way, innermost last, each with what deletes it.
_open: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("open", default=())


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are spilled inside, but for those that outlast it, are deleted at the end."""
    mine: list[tuple[SparkSession, str]] = []
    token = _open.set((*_open.get(), mine))
    try:
        yield
    finally:
        _open.reset(token)
        for spark, path in mine:
            delete(spark, path)


def place(spark: SparkSession, name: str, outlast: int = 0) -> str:
    """A new path in the shared folder, which is deleted like a spilled table."""
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    owners = _open.get()
    if len(owners) > outlast:
        owners[len(owners) - 1 - outlast].append((spark, path))
    return path


def spill(df: DataFrame, name: str, outlast: int = 0, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and a lost executor loses nothing. The table outlasts so many scratches around it.
    by: a column whose values get folders of their own, so that a filter on it reads only these."""
    spark = df.sparkSession
    path = place(spark, name, outlast)
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)
