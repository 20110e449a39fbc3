"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Words and pairs of neighbouring words (A-Z as a-z) hash into ``n_buckets`` buckets, whose number grows with the root of
the corpus' size, as vocabularies do. Two add-one smoothed bags of buckets are estimated: the target model from at most
``MAX_TARGET`` documents labelled good (those with the smallest key hashes), the raw model from every document. A
document's log weight is the sum over its n-grams of the log ratio of the two models. Adding independent Gumbel noise and keeping the k largest sums is sampling k documents without replacement
with probabilities in proportion to the weights; the noise comes from a hash of key and seed, so runs agree.

The k-th largest key is found by counting histograms of ever narrower ranges over the scored table, exactly and without
a global sort; ties go to the smaller document key.

Defined cases: null and empty texts have log weight 0; without target documents all log weights are 0; null keys share
one noise value; repeated rows get equal keys; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import written

LEAST_BUCKETS = 8192
MAX_TARGET = 20_000
KEEP_PERCENT = 85
SEED = 17
BINS = 4096
FEW = 100_000  # rows left in a range when the k-th key is read by a top-k instead of another histogram


def n_buckets(docs: DataFrame, text: str = "text") -> int:
    """The power of two from ``LEAST_BUCKETS`` plus the root of all texts' bytes on: 16,384 at 1 MB, 262,144 at 30 GB, 16.8 million (134 MB of weights) at 100 TB."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return 1 << math.ceil(math.log2(LEAST_BUCKETS + math.sqrt(size)))


def buckets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a column's texts, and the n+1 offsets of its rows among them."""
    raw, at = words.text_bytes(column)
    raw = words.LOWER[raw]
    starts, ends, first = words.word_spans(raw, at)
    h = words.word_hashes(raw, starts, ends)
    pair = words.mix((h[:-1] * words.MULT[0]) ^ h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
    inner = np.ones(len(pair), bool)
    cut = first[1:-1]
    inner[cut[(cut > 0) & (cut < len(h))] - 1] = False  # pairs that span two rows
    both = np.empty(2 * len(h), np.int64)
    both[0::2] = (h % np.uint64(n)).astype(np.int64)
    both[1::2] = -1
    both[1 : 2 * len(pair) : 2] = np.where(inner, (pair % np.uint64(n)).astype(np.int64), -1)
    real = both >= 0
    count = np.concatenate(([0], np.cumsum(real)))
    return both[real], count[2 * first]


def _models(docs: DataFrame, n: int) -> np.ndarray:
    """Log ratio of target and raw model for each of ``n`` buckets, from (text, target)."""
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            for part in words.slices(batch):
                found, at = buckets(part.column(0), n)
                wanted = np.repeat(part.column(1).to_numpy(zero_copy_only=False), np.diff(at))
                for counts, of in ((raw, found), (target, found[wanted])):
                    some, times = np.unique(of, return_counts=True)
                    counts[some] += times
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], schema=schema)

    counts = docs.select("text", "target").mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    held = counts.toArrow()  # at most n rows of 20 bytes
    raw, target = np.ones(n), np.ones(n)
    at = held["bucket"].to_numpy()
    raw[at] += held["raw"].to_numpy()
    target[at] += held["target"].to_numpy()
    if target.sum() == n:
        return np.zeros(n)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def gumbel(key: str, seed: int = SEED) -> Column:
    """Standard Gumbel noise from a hash of the key."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(scored: DataFrame, k: int, value: str, tie: str) -> tuple[float, int] | None:
    """The k-th row by value downwards, then tie upwards; None if there are fewer rows."""
    rest, low, high = k, None, None
    inside = scored.select(value, tie)
    while True:
        bounds = inside.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")).first()
        if bounds["n"] < rest or rest < 1:
            return None
        low, high = bounds["low"], bounds["high"]
        if bounds["n"] <= FEW or low == high:
            row = inside.orderBy(F.desc(value), F.asc_nulls_last(tie)).limit(rest).orderBy(F.asc(value), F.desc_nulls_first(tie)).first()
            return row[value], row[tie]
        bin_of = F.least(F.lit(BINS - 1), F.floor((F.col(value) - low) / ((high - low) / BINS))).cast("int")
        for r in inside.groupBy(bin_of.alias("bin")).count().orderBy(F.desc("bin")).collect():  # at most BINS rows
            if r["count"] >= rest:
                inside = inside.filter(bin_of == r["bin"])
                break
            rest -= r["count"]


def resample(docs: DataFrame, good: DataFrame, *, keep_percent: float = KEEP_PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_grams, log_weight, gumbel_key, kept of every document; ``good`` holds the keys of target documents."""
    docs = docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    pick = good.select(F.col(key).cast("long").alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(MAX_TARGET).withColumn("target", F.lit(True))
    flagged = docs.join(F.broadcast(pick), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    n = n_buckets(docs)
    ratio = _models(flagged, n)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        def compute(column: pa.Array) -> list[pa.Array]:
            found, at = buckets(column, n)
            sums = np.concatenate(([0.0], np.cumsum(ratio[found])))
            return [pa.array(np.diff(at)), pa.array(sums[at[1:]] - sums[at[:-1]])]

        return compute

    scored = words.appended(docs, {"n_grams": "long", "log_weight": "double"}, make, carry=["id"])
    scored = written(scored.withColumn("gumbel_key", F.col("log_weight") + gumbel("id")), "weights")
    last = kth_largest(scored, int(scored.count() * keep_percent / 100), "gumbel_key", "id")
    if last is None:
        kept = F.lit(False)
    else:
        kept = (F.col("gumbel_key") > last[0]) | ((F.col("gumbel_key") == last[0]) & (F.lit(True) if last[1] is None else F.coalesce(F.col("id") <= last[1], F.lit(False))))
    return scored.select(F.col("id").alias(key), "n_grams", "log_weight", "gumbel_key", kept.alias("kept"))
