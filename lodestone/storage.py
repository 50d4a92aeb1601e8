"""Tables written to the folder that all executors share, to cut lineage and to be read more than once; and the size of the batches that workers get."""

from __future__ import annotations

import atexit
import posixpath
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and Spark runs on this machine alone (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    _written.append(posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}"))
    return _written[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Python workers of the jobs that run meanwhile get at most so many rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop(*tables: DataFrame) -> None:
    """Removes stored tables that nothing will read again, so that they take no room beside later ones."""
    for df in tables:
        _remove(df.sparkSession, df.stored_at)
        _written.remove(df.stored_at)


def _remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Removes all that this process has stored, once no result that was made of it is read any more."""
    while _written:
        _remove(spark, _written.pop())
