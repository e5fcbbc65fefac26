"""Folders that driver and executors share, tables stored there, and versions of a table that readers can trust."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_base(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the one set on the context; a local one only in local mode."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read from there, for tables that are used more than once."""
    folder = shared_folder(df.sparkSession, name)
    if (open_ := _SCRATCH.get()) is not None:
        open_.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored meanwhile is removed at the end."""
    outer, mine = _SCRATCH.get(), []
    _SCRATCH.set(mine)
    try:
        yield
    finally:
        _SCRATCH.set(outer)
        for folder in mine:
            remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder with all that is in it."""
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


class Taken(Exception):
    """Another writer has published this version."""


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where it isn't there."""
    fs, path = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The published versions of a table in ascending order. One marker each: `prune` keeps their number small."""
    return sorted(int(n) for n in names(spark, f"{folder}/_versions") if n.isdigit())


def mark(spark: SparkSession, folder: str, version: int, facts: dict) -> None:
    """Publishes a version whose data is written: its marker appears whole by one rename, or Taken is raised."""
    fs, hidden = _file_system(spark, f"{folder}/_versions/_{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(bytearray(json.dumps(facts).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    at = hidden.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jvm.org.apache.hadoop.fs.Path(f"{folder}/_versions/{version}"))
    try:
        context.rename(fs.makeQualified(hidden), at, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        fs.delete(hidden, False)
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            raise Taken(f"{folder}: version {version}") from e
        raise


def facts(spark: SparkSession, folder: str, version: int) -> dict:
    """What the marker of a version says."""
    fs, path = _file_system(spark, f"{folder}/_versions/{version}")
    read = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(read, "UTF-8"))
    finally:
        read.close()


def prune(spark: SparkSession, folder: str, below: int) -> None:
    """Removes the markers of versions below one."""
    for v in versions(spark, folder):
        if v < below:
            remove(spark, f"{folder}/_versions/{v}")
