"""Readers: Parquet tables of a data set, raw files, JSON canonical documents, JSONL frames, and their sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwood.sources import scratch, snapshots

MAX_BYTES = 10 * 1024 * 1024  # of one source file
FRAME_BYTES = 1 << 20  # of one JSONL frame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, size, modified, content, sha256 of files up to ``MAX_BYTES``; larger ones are left out before their content is hashed."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return raw.filter(F.col("length") <= MAX_BYTES).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", F.sha2("content", 256).alias("sha256"))


def decoded(content: Column) -> Column:
    """UTF-8 text with line ends as newlines; null where the bytes are no UTF-8."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "\r\n?", "\n")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """schema_version, request_id, command, params of JSONL frames; oversize and broken frames come with an error instead."""
    shape = "schema_version int, request_id string, command string, params map<string,string>"
    line = spark.read.text(path).filter("trim(value) <> ''")
    read = line.select("value", F.when(F.octet_length("value") <= FRAME_BYTES, F.from_json("value", shape)).alias("frame"))
    error = F.when(F.octet_length("value") > FRAME_BYTES, "FRAME_TOO_LARGE").when(F.col("frame.request_id").isNull() | F.col("frame.command").isNull(), "INVALID_FRAME")
    return read.select("frame.*", error.alias("error"))


PUBLISH_TRIES = 5


def publish_blobs(blobs: DataFrame, folder: str) -> DataFrame:
    """Adds the contents whose hash ``folder`` does not hold yet; hash, size of all it holds. Running it again adds nothing.

    New contents go to a folder of their own and count from its commit on. Of two writers at once, the second finds its version taken, leaves its
    folder unnamed and tries again with what is new by then: so a hash is held once.
    """
    spark = blobs.sparkSession
    every = blobs.select(F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("bigint").alias("size"), "content").dropDuplicates(["hash"])
    for turn in range(PUBLISH_TRIES):
        last = snapshots.latest(spark, folder)
        held = published(spark, folder, last)
        new = every if held is None else every.join(held.select("hash"), "hash", "left_anti")
        path = snapshots.fresh(folder, "objects")
        new.write.parquet(path)
        if last and spark.read.parquet(path).isEmpty():
            break
        try:
            snapshots.commit(spark, folder, {"version": last["version"] + 1 if last else 1, "parts": [*(last["parts"] if last else []), path.rsplit("/", 1)[1]]})
            break
        except AnalysisException:
            if turn == PUBLISH_TRIES - 1:
                raise
    return published(spark, folder).select("hash", "size")


def published(spark: SparkSession, folder: str, manifest: dict | None = None) -> DataFrame | None:
    """hash, size, content of the blobs in a folder; None if there is no commit."""
    manifest = manifest or snapshots.latest(spark, folder)
    return spark.read.parquet(*(f"{folder}/{p}" for p in manifest["parts"])) if manifest else None


def objects_checked(spark: SparkSession, folder: str) -> DataFrame:
    """path, hash, size, fault of files kept under the hash of their content: a null fault where name and content agree."""
    named = F.regexp_extract("path", "([^/]*)$", 1)
    fault = F.when(~named.rlike("^[0-9a-f]{64}$"), "INVALID_NAME").when(named != F.col("sha256"), "OBJECT_CORRUPT").when(~F.col("path").contains(F.concat(F.lit("/"), F.left(named, F.lit(2)), F.lit("/"))), "WRONG_FOLDER")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return raw.select("path", named.alias("hash"), "size", fault.alias("fault"))


def verified(blobs: DataFrame) -> DataFrame:
    """Blobs with whether their content has the stated hash and size."""
    return blobs.withColumn("intact", (F.sha2("content", 256) == F.col("hash")) & (F.octet_length("content") == F.col("size")))


def write_jsonl(chunks: DataFrame, folder: str) -> None:
    """One JSON object a line; fields that are null stay, so every line has the same ones."""
    chunks.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def write_canonical(documents: DataFrame, folder: str, key: str) -> None:
    """Canonical documents as JSON, a folder for each key; keys that are written again replace theirs only."""
    documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(folder)


def read_canonical(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Canonical documents with ``broken``: what is no JSON of this shape."""
    return spark.read.schema(f"{schema}, broken string").option("columnNameOfCorruptRecord", "broken").json(folder)


def append_audit(events: DataFrame, folder: str) -> None:
    """Adds events to a log that is only ever added to, each with the time of writing."""
    events.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(folder)


def memoized(df: DataFrame, folder: str, key: str, compute) -> DataFrame:
    """``compute(df)`` (rows by ``key``), of which only keys that ``folder`` does not hold yet are computed and kept there."""
    spark = df.sparkSession
    if scratch.exists(spark, f"{folder}/_SUCCESS"):
        df = df.join(spark.read.parquet(folder).select(key), key, "left_anti")
    compute(df).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def listing(spark: SparkSession, folder: str, pattern: str = "*", *, depth: int | None = None) -> DataFrame:
    """path, size, modified of files below a folder, of those ``depth`` folders down at most; their contents are not read."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    if depth is not None:
        below = F.substring_index(F.col("path"), folder.rstrip("/").removeprefix("file:") + "/", -1)
        raw = raw.filter(F.length(below) - F.length(F.replace(below, F.lit("/"), F.lit(""))) <= depth)
    return raw.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
