"""How two orders of the same rows differ: the number of inverted pairs, counted without listing pairs.

Rows get dense places in both orders (range partitions, sorted, with the sizes of those before). Places are cut into at most ``RUNS`` runs of one order and buckets
of the other. A pair lies in one run (counted there), in two runs and one bucket (counted in the bucket), or in two of each: then the table of rows for each (run,
bucket) decides, by sums over the bits of the bucket. Runs and buckets hold the same number of rows, so nothing is skewed whatever the values are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwood.sources.scratch import dropped, written

RUNS = 1_024
LEAST = 65_536  # rows of a run at least
DIRECT = 64  # numbers that are compared pair by pair


def placed(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with their place from 0 on in this order: no task sees more than a range of them."""
    sorted_ = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_id", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return sorted_.withColumn("_part", part).join(before, "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_id", "_before")


def count(x: np.ndarray) -> tuple[int, np.ndarray]:
    """How many pairs of a sequence stand in falling order, and the sequence sorted."""
    if len(x) <= DIRECT:
        return int(np.triu(x[:, None] > x[None, :], 1).sum()), np.sort(x)
    half = len(x) // 2
    (a, left), (b, right) = count(x[:half]), count(x[half:])
    across = len(left) * len(right) - int(np.searchsorted(left, right, side="right").sum())
    return a + b + across, np.sort(np.concatenate((left, right)), kind="stable")


def _within(rows: DataFrame, group: str, by: str, value: str) -> DataFrame:
    """inverted: pairs of a group that ``by`` orders one way and ``value`` the other; equal values are no pair."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column(by).to_numpy(), kind="stable")
        return pa.table({"inverted": pa.array([count(table.column(value).to_numpy()[order])[0]], pa.int64())})

    return rows.select(group, by, value).groupBy(group).applyInArrow(run, "inverted long")


def inversions(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """One row: pairs of rows, and how many are ``inverted``: in one order by column ``a``, in the other by column ``b``.

    Ties in either column are no inversion; rows with a null in either take no part; fewer than two rows have no pair. ``key`` tells equal rows apart.
    """
    valid = rows.select(F.col(key).alias("key"), F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    first = placed(valid, ["a", "b", "key"], "x")
    both = written(placed(first, ["b", "a", "key"], "y").select("x", "y"), "places")
    n = both.count()
    size = max(LEAST, -(-n // RUNS))
    cut = written(both.select("x", "y", F.floor(F.col("x") / size).alias("run"), F.floor(F.col("y") / size).alias("bucket")), "cut")
    same_run, same_bucket = _within(cut, "run", "x", "y"), _within(cut, "bucket", "y", "run")
    cells = cut.groupBy("run", "bucket").agg(F.count("*").alias("n"))  # ``RUNS`` squared rows at most
    bits = cells.select("run", "n", F.explode(F.sequence(F.lit(0), F.lit(RUNS.bit_length()))).alias("bit"), "bucket")
    split = bits.select("run", "n", "bit", F.expr("shiftright(bucket, bit + 1)").alias("prefix"), F.expr("shiftright(bucket, bit) & 1").alias("high"))
    earlier = Window.partitionBy("bit", "prefix").orderBy("run").rangeBetween(Window.unboundedPreceding, -1)
    across = split.withColumn("over", F.sum(F.col("n") * F.col("high")).over(earlier)).filter("high = 0").select((F.col("n") * F.coalesce("over", F.lit(0))).alias("inverted"))
    total = same_run.unionByName(same_bucket).unionByName(across).agg(F.coalesce(F.sum("inverted"), F.lit(0)).cast("long").alias("inverted"))
    out = written(total.select(F.lit(n * (n - 1) // 2).alias("pairs"), "inverted"), "inversions")
    for table in (both, cut):
        dropped(table)
    return out
