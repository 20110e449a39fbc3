"""What surrounds a page of evidence: newest records, source status, re-ranking, attribution, acquisition and purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Signs of an answer that asks for a login or a challenge, in lower case.
ACCESS_MARKERS = ['type="password"', "type='password'", "sign in to access", "log in to access", "access denied", "captcha"]
SNIFFED = 200_000  # characters that are looked at for them


def newest_page(records: DataFrame, by: list[str], order: list[Column], size: int) -> DataFrame:
    """The first ``size`` rows of each group with their place, and ``truncated`` where the group has more.

    One row more than the page is kept, so tasks drop the rest of a group before it is shuffled.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    probe = records.withColumn("place", place).filter(F.col("place") <= size + 1)
    more = F.max("place").over(Window.partitionBy(*by)) > size
    return probe.withColumn("truncated", more).filter(F.col("place") <= size).withColumn("place", F.col("place").cast("bigint"))


def enriched(page: DataFrame, labels: DataFrame) -> DataFrame:
    """``page`` with the status of each source and its sorted warnings; several labels of one count as the worst."""
    worst = labels.join(page.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"), F.min("quality").alias("_quality"))
    both = page.join(worst, "doc_id", "left")
    flags = F.array(F.when(F.col("_quality").isNull(), "index_incomplete"), F.when(F.col("_quality") == 0, "source_low_quality"), F.when(F.col("_toxic") == 1, "source_retracted"))
    status = F.when(F.col("_toxic").isNull(), "unknown").when(F.col("_toxic") == 1, "retracted").otherwise("current")
    return both.withColumns({"status": status, "warnings": F.array_join(F.array_sort(F.array_compact(flags)), ",")}).drop("_toxic", "_quality")


def reranked(page: DataFrame, prefix: int) -> DataFrame:
    """``page`` (vec_id, base, new_score) with its first ``prefix`` rows by new_score, those without one last; the rest stays. A page is bounded by its search."""
    head = F.col("base") <= prefix
    order = [F.desc(head), F.when(head, F.col("new_score")).desc_nulls_last(), F.when(head, F.col("vec_id")), F.col("base")]
    return page.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def attributed(parts: DataFrame, *, group: str, order: str, step: int) -> DataFrame:
    """Each multiple ``at`` of ``step`` within a group's joined length, in the part that covers it.

    A part makes the multiples in its own range, so the point-in-interval join needs no join at all.
    """
    upto = F.sum("size").over(Window.partitionBy(group).orderBy(order))
    placed = parts.withColumns({"_first": F.ceil((upto - F.col("size")) / step).cast("bigint"), "_last": F.ceil(upto / step).cast("bigint") - 1}).filter("_first <= _last")
    return placed.withColumn("segment", F.explode(F.sequence("_first", "_last"))).withColumn("at", F.col("segment") * step).drop("_first", "_last")


def acquired(content: Column) -> Column:
    """'empty', 'access_required' or 'evidence'."""
    head = F.lower(F.coalesce(content, F.lit("")).substr(1, SNIFFED))
    asks = F.lit(False)
    for marker in ACCESS_MARKERS:
        asks = asks | F.contains(head, F.lit(marker))
    return F.when(head == "", "empty").when(asks, "access_required").otherwise("evidence")


def mentions(rows: DataFrame, key: str, json: str, owned: DataFrame, id_column: str) -> DataFrame:
    """key, id of rows whose JSON names an owned number: numbers are taken out and joined, so rows and ids never meet all with all."""
    named = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(json, F.lit("[0-9]+"), F.lit(0)))).alias("_n")).select(key, F.expr("try_cast(_n as bigint)").alias(id_column)).distinct()
    return named.join(owned.select(id_column).distinct(), id_column)


def redacted(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with empty texts for the ids in ``gone``, ``purged`` and the hash of what was there."""
    both = docs.join(gone.select("doc_id", F.lit(True).alias("_gone")).distinct(), "doc_id", "left")
    purged = F.coalesce("_gone", F.lit(False))
    return both.withColumns({"purged": purged, "tombstone": F.when(purged, F.sha2("text", 256))}).withColumn("text", F.when(F.col("purged"), F.lit("")).otherwise(F.col("text"))).drop("_gone")
