"""Exact order statistics of groups of any size."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwood.sources.scratch import written


def at_ranks(rows: DataFrame, group: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """group, name, value at 1-based ranks, each given as an expression of the group's row count; nulls do not count.

    Different values with their counts are spread by range over all tasks. Sums of whole ranges say which range holds a
    rank, and only such ranges are counted through. So one group may hold all rows: no task gets more than a range.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    runs = written(counts.repartitionByRange(group, value).withColumn("_run", F.spark_partition_id()), "ranges")
    of_group = Window.partitionBy(group)
    sizes = runs.groupBy(group, "_run").agg(F.sum("_n").alias("_size"))
    placed = sizes.withColumns({"_before": F.sum("_size").over(of_group.orderBy("_run")) - F.col("_size"), "_total": F.sum("_size").over(of_group)})
    targets = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_total")).cast("bigint").alias("rank")) for name, rank in ranks.items()])
    wanted = placed.withColumn("_t", F.explode(targets)).select(group, "_run", "_before", "_size", "_t.name", "_t.rank").filter("rank > _before and rank <= _before + _size")
    upto = F.sum("_n").over(Window.partitionBy(group, "_run").orderBy(value))
    counted = runs.join(wanted.select(group, "_run").distinct(), [group, "_run"], "left_semi").withColumn("_upto", upto)
    met = counted.join(wanted, [group, "_run"]).filter("rank > _before + _upto - _n and rank <= _before + _upto")
    return met.select(group, "name", value)


def quantile(numerator: int, denominator: int) -> Callable[[Column], Column]:
    """The rank of the least value that the given share of rows does not exceed."""
    return lambda n: F.greatest(F.ceil(n * numerator / F.lit(denominator)), F.lit(1))


def wrapped_sum(value: Column) -> Column:
    """The sum of whole numbers modulo 2^64 as a signed 64-bit number: the plain sum wherever that fits, and no error where it does not."""
    half = F.lit(Decimal(2**63))
    return (F.pmod(F.sum(value.cast("decimal(20,0)")) + half, F.lit(Decimal(2**64))) - half).cast("bigint")
