"""Tables that a query writes for itself in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only on one's own machine may that be unset; then a temporary folder is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    return f"{base(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


#: What ``written`` made in this process and nothing deleted yet.
_LEFT: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet, read again: later steps, and executors that are lost, need none of the work before it."""
    path = folder(df.sparkSession, name)
    _LEFT.add(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a ``written`` table that nothing needs any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _LEFT.difference_update([p for p in _LEFT if p.rsplit("/", 1)[1] == path.getName()])


def cleared(spark: SparkSession) -> int:
    """Deletes the tables that results of this process still read; for when those results are used. How many there were."""
    n = len(_LEFT)
    for name in sorted(_LEFT):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _LEFT.clear()
    return n
