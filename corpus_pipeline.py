"""A cleaning pipeline over ``documents``: each stage reads what its predecessor kept; the last one packs windows.

Every stage but the last returns the columns it was given, of any name, unchanged but for what its docstring says; operators
see only the columns they need. Null and empty texts, repeated rows and empty tables are defined by each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwood.llm import ngram_join, packing, pii, repetition, toxicity
from fernwood.llm.queries import VOCABULARY
from fernwood.llm.shared import dropped, joined_by_id, sheltered, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOXIC_FROM = 0.7


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``TOXIC_FROM`` or more go. Null and empty texts score as texts without a match; repeated rows go or stay together."""
    inner, back = sheltered(docs, "doc_id", "text")
    grammar = toxicity.train(inner, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return back(toxicity.score(inner, grammar).filter(F.col("score") < TOXIC_FROM))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go: so do null and empty texts, which have under 20 words; repeated rows go or stay together."""
    inner, back = sheltered(docs, "doc_id", "text")
    return back(repetition.judge(inner).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near copies (five words, 0.8) the document with the smallest id stays; those without words all stay.

    Rows with a null or repeated id are documents of their own under a generated key: of a component one row stays, with
    the smallest id, then text hash; null ids come last. Different texts under one id both stay.
    """
    inner, back = sheltered(docs, "doc_id", "text")
    if inner.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        linked = ngram_join.join(inner, n=5, percent=80)
        gone = written(linked.filter("doc_id <> component_id").select("doc_id"), "gone")
        return back(joined_by_id(inner, gone, "doc_id", "left_anti"))
    rows = written(inner.withColumn("_row", F.monotonically_increasing_id()), "rows")
    place = rows.select("_row", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("hash"), "_row").alias("place"))
    linked = ngram_join.join(rows, n=5, percent=80, key="_row").join(place, "_row")
    kept = written(linked.groupBy("component_id").agg(F.min("place").alias("place")).select("place._row"), "kept")
    return back(joined_by_id(rows, kept, "_row", "left_semi"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become their kind in angle brackets, and n_chars, where there is one, follows; all rows stay, null texts as null."""
    inner, back = sheltered(docs, "doc_id", "text", "n_chars")
    masked = pii.with_spans(inner).withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    if "n_chars" in inner.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(inner.schema["n_chars"].dataType))
    return back(masked)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in windows of at most 2048 tokens; null and empty texts have one token, repeated rows are packed each."""
    return packing.pack(docs, VOCABULARY)


STAGES: list[tuple[str, Stage]] = [("toxicity", remove_toxic), ("quality_rules", keep_quality), ("ngram_jaccard_join", drop_near_copies), ("pii", mask_pii), ("packing", pack_windows)]
#: Learned scores, signatures and token ids are beyond SQL; tests compare each stage with a plain Python version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each but the last is written as Parquet and read again, and deleted once the next is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, before = written(stage(spark, docs, sf_dir), name), last
        if before is not None:
            dropped(before)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
