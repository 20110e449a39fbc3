"""Versions of what a job keeps in a folder: a commit is one small file in a folder of its own, and the newest complete one counts.

Data lie in folders of their own names, so what a lost writer leaves behind is never read, and readers of an older version keep
theirs. Of two writers that commit the same version the second fails.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 9  # digits of a version's folder name


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listed(df: DataFrame) -> DataFrame:
    """path, length, modified of the files that ``df`` reads; no content is read."""
    raw = df.sparkSession.read.format("binaryFile").load(list(df.inputFiles()))
    return raw.select("path", "length", F.col("modificationTime").alias("modified"))


def state(df: DataFrame) -> str | None:
    """A digest of which files ``df`` reads, their sizes and times, and what it does with them; None where rows come from elsewhere, so that nothing tells their state but themselves."""
    if not df.inputFiles() or not _only_files(df):
        return None
    seen = listed(df).agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modified"))).first()
    return hashlib.sha256(f"{df.semanticHash()}:{tuple(seen)}".encode()).hexdigest()


def home(df: DataFrame) -> str:
    """A short name for the place of the table that ``df`` reads: its file, or the folder of its parts."""
    files = df.inputFiles()[:1]
    return hashlib.sha256("".join(f.rsplit("/", 1)[0] if "/part-" in f else f for f in files).encode()).hexdigest()[:16]


def _only_files(df: DataFrame) -> bool:
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return all(leaves.apply(i).nodeName().startswith(("LogicalRelation", "Relation")) for i in range(leaves.size()))


def versions(spark: SparkSession, folder: str) -> list[int]:
    files, at = _hadoop(spark, f"{folder}/manifest")
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(int(n) for n in names if n.isdigit() and files.exists(_hadoop(spark, f"{folder}/manifest/{n}/_SUCCESS")[1]))


def read(spark: SparkSession, folder: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest/{version:0{WIDTH}d}").first()[0])


def latest(spark: SparkSession, folder: str) -> dict | None:
    known = versions(spark, folder)
    return read(spark, folder, known[-1]) if known else None


def commit(spark: SparkSession, folder: str, manifest: dict) -> dict:
    """Writes ``manifest``, whose ``version`` must be a new one."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/manifest/{manifest['version']:0{WIDTH}d}")
    return manifest


def fresh(folder: str, kind: str) -> str:
    return f"{folder}/{kind}-{uuid.uuid4().hex}"


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Deletes manifests but the last ``keep``, and data folders that none of those names; how many went. Not to be run beside a writer."""
    known = versions(spark, folder)
    named = json.dumps([read(spark, folder, v) for v in known[-keep:]])
    files, at = _hadoop(spark, folder)
    gone = [f"{folder}/manifest/{v:0{WIDTH}d}" for v in known[:-keep]]
    gone += [f"{folder}/{n}" for n in (s.getPath().getName() for s in files.listStatus(at)) if n != "manifest" and n not in named]
    for path in gone:
        files.delete(_hadoop(spark, path)[1], True)
    return len(gone)
