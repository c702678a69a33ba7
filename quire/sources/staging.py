"""Tables that a job writes for itself, in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting for shuffles that go when their query ends.
DELETE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folder: dict[str, str] = {}
_scopes = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a
    new folder of its own; a cluster has to name one, as executors can't read what others wrote to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_folder[app]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at its end, but for those staged with keep, which belong to the scratch around it."""
    around = getattr(_scopes, "paths", None)
    _scopes.paths, _scopes.around = [], (around, getattr(_scopes, "around", None))
    try:
        yield
    finally:
        done = _scopes.paths
        _scopes.paths, _scopes.around = _scopes.around
        for path in done:
            fs, place = file_system(spark, path)
            fs.delete(place, True)


def new_path(spark: SparkSession, name: str = "quire", keep: bool = False) -> str:
    """A new folder's name in the shared folder. It is deleted at the end of the scratch it belongs to; without one, when the
    driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    owner = (_scopes.around[0] if keep else _scopes.paths) if getattr(_scopes, "around", None) else None
    if owner is None:
        fs, place = file_system(spark, path)
        fs.deleteOnExit(place)
    else:
        owner.append(path)
    return path


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffles of a write inside are deleted at its end (Spark otherwise keeps them until the driver collects its garbage)."""
    before = spark.conf.get(DELETE_SHUFFLES, "false")
    spark.conf.set(DELETE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DELETE_SHUFFLES, before)


def staged(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back. Cuts the lineage: a lost executor costs no recomputation
    of what came before, and a column that is used twice is computed once. The shuffles of the write are deleted at its end."""
    spark, path = df.sparkSession, new_path(df.sparkSession, keep=keep)
    with brief_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
