"""A packed copy of a table of vectors: little-endian float32 rows sorted by key, with a manifest that tells whether it still counts.

A search reads 4 bytes a component and the norm instead of arrays. ``build`` writes rows to a folder of their own, checks them, and commits a manifest
(``snapshots``) with dimension, count, bytes, a checksum of the packed rows and a fingerprint of the source; the newest complete manifest
counts, so a switch of versions is one file. ``opened`` says, without reading vectors where the source's files are those of the build:

    vector_binary_scan        the copy is that of this source
    vector_cache_stale        the source has other vectors than the copy
    vector_cache_corrupt      the copy's files are not those of the manifest
    vector_cache_unavailable  there is no copy

Only the first is used; otherwise, or where a packed row turns out to be broken, scores come from the source itself, with the warning beside them.
``verify`` reads everything: packed rows against their checksum and against the source packed anew.

Defined cases: vectors that are null or of another length, with null or non-finite components, zero, or too large for float32 are refused: they are counted
in the manifest and have no score on either path; null keys and keys held twice raise; a table without valid vectors raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwood.functions import vectors as V
from fernwood.sources import snapshots

FAILED = (PySparkException, Py4JJavaError)  # what a job that meets broken files raises
SCAN, STALE, CORRUPT, UNAVAILABLE = "vector_binary_scan", "vector_cache_stale", "vector_cache_corrupt", "vector_cache_unavailable"


@dataclass(frozen=True)
class Copy:
    rows: DataFrame | None  # key, packed, norm; None unless the status is SCAN
    status: str
    manifest: dict | None


def packed(vectors: DataFrame, dim: int, *, key: str, vector: str) -> DataFrame:
    """key, packed, norm of the valid vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, dim)
            norm = np.sqrt((flat.astype(np.float64) ** 2).sum(axis=1))
            good = np.flatnonzero(np.isfinite(flat).all(axis=1) & (norm > 0))
            rows = pa.array([flat[i].tobytes() for i in good], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), rows, pa.array(norm[good])], names=["key", "packed", "norm"])

    whole = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == dim).filter(F.forall("v", lambda x: x.isNotNull()))
    return whole.mapInArrow(run, "key long, packed binary, norm double")


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of packed components; ValueError where a length or component is wrong."""
    rows = column.to_pylist()
    if any(r is None or len(r) != 4 * dim for r in rows):
        raise ValueError("a packed row has a wrong length")
    flat = np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), dim).astype(np.float64)
    if not np.isfinite(flat).all():
        raise ValueError("a packed component is not finite")
    return flat


def _checksum(rows: DataFrame) -> tuple[int, str, int]:
    n, total, size = rows.agg(F.count("*"), F.sum(F.xxhash64("key", "packed").cast("decimal(38,0)")), F.sum(F.octet_length("packed"))).first()
    return n, str(total), size or 0


def _fingerprint(vectors: DataFrame, key: str, vector: str) -> str:
    n, total, mixed = vectors.agg(F.count("*"), F.sum(F.xxhash64(key, vector).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), key, vector))).first()
    return f"{n}:{total}:{mixed}"


def _files(spark: SparkSession, path: str) -> list[list]:
    """Name, size and time of each packed file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "length", "modificationTime")
    return sorted([r.path.rsplit("/", 1)[1], r.length, r.modificationTime.isoformat()] for r in found.collect())


def build(vectors: DataFrame, folder: str, dim: int, *, key: str = "vec_id", vector: str = "embedding", force: bool = False) -> dict:
    """Packs the vectors into ``folder`` unless the copy there is theirs; returns its manifest."""
    spark = vectors.sparkSession
    if not force:
        copy = opened(vectors, folder, key=key, vector=vector)
        if copy.status == SCAN and copy.manifest["dim"] == dim:
            return copy.manifest
    path = snapshots.fresh(folder, "rows")
    packed(vectors, dim, key=key, vector=vector).repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)
    rows = spark.read.parquet(path)
    n, checksum, size = _checksum(rows)
    if n == 0 or rows.filter("key is null").count() or rows.select("key").distinct().count() != n:
        raise ValueError("a packed copy needs valid vectors with keys that are not null and differ")
    last = snapshots.latest(spark, folder)
    manifest = {
        "version": last["version"] + 1 if last else 1, "path": path.rsplit("/", 1)[1], "dim": dim, "count": n, "refused": vectors.count() - n, "bytes": size, "checksum": checksum,
        "dtype": "float32-le", "fingerprint": _fingerprint(vectors, key, vector), "state": snapshots.state(vectors), "files": _files(spark, path),
    }
    return snapshots.commit(spark, folder, manifest)


def opened(vectors: DataFrame, folder: str, *, key: str = "vec_id", vector: str = "embedding") -> Copy:
    """The copy in ``folder``, if it is that of ``vectors``."""
    spark = vectors.sparkSession
    try:
        manifest = snapshots.latest(spark, folder)
        if manifest is None:
            return Copy(None, UNAVAILABLE, None)
        now = snapshots.state(vectors)
        if (now is None or now != manifest["state"]) and _fingerprint(vectors, key, vector) != manifest["fingerprint"]:
            return Copy(None, STALE, manifest)
        path = f"{folder}/{manifest['path']}"
        if _files(spark, path) != manifest["files"]:
            return Copy(None, CORRUPT, manifest)
        return Copy(spark.read.schema("key long, packed binary, norm double").parquet(path), SCAN, manifest)
    except (*FAILED, ValueError, KeyError):
        return Copy(None, CORRUPT, None)


def verify(vectors: DataFrame, folder: str, *, key: str = "vec_id", vector: str = "embedding") -> str:
    """The status of the copy after reading all of it and the source."""
    copy = opened(vectors, folder, key=key, vector=vector)
    if copy.rows is None:
        return copy.status
    m = copy.manifest
    try:
        if _checksum(copy.rows) != (m["count"], m["checksum"], m["bytes"]) or m["bytes"] != 4 * m["dim"] * m["count"]:
            return CORRUPT
    except FAILED:
        return CORRUPT
    return SCAN if _checksum(packed(vectors, m["dim"], key=key, vector=vector))[:2] == (m["count"], m["checksum"]) else STALE


def scores(vectors: DataFrame, folder: str, query: list[float], *, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, str]:
    """(key, score) of every valid vector by cosine, and the status: from the packed copy where that counts, else from the source."""
    copy = opened(vectors, folder, key=key, vector=vector)
    dim = len(query)
    q = np.array(query, np.float64)
    if not np.isfinite(q).all() or not q.any():
        raise ValueError("a query vector must be finite and not zero")
    if copy.rows is not None and copy.manifest["dim"] == dim:
        size = float(np.sqrt(q @ q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(unpacked(batch.column(1), dim) @ q / (batch.column(2).to_numpy() * size))], names=["key", "score"])

        return copy.rows.mapInArrow(run, "key long, score double"), copy.status
    narrow = F.transform(F.col(vector), lambda x: x.cast("float"))
    plain = vectors.select(F.col(key).cast("long").alias("key"), narrow.alias("v")).filter(V.valid(F.col("v"), dim))
    return plain.select("key", V.cosine(F.col("v"), V.literal(query)).alias("score")), copy.status


def best(vectors: DataFrame, folder: str, query: list[float], k: int, *, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, str]:
    """The ``k`` nearest (key, score) as written rows, and the status; a copy that breaks while it is read is passed over."""
    spark = vectors.sparkSession
    found, status = scores(vectors, folder, query, key=key, vector=vector)
    try:
        return spark.createDataFrame(found.orderBy(F.desc("score"), "key").limit(k).collect(), found.schema), status  # ``k`` rows
    except FAILED:
        if status != SCAN:
            raise
        found, _ = scores(vectors, f"{folder}/none", query, key=key, vector=vector)
        return spark.createDataFrame(found.orderBy(F.desc("score"), "key").limit(k).collect(), found.schema), CORRUPT
