"""Evidence closure and alias chains: bounded loops of equality joins over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwood.sources.scratch import dropped, written

MAX_DEPTH = 32
MAX_ROUNDS = 20


def closure(roots: DataFrame, edges: DataFrame, *, max_depth: int = MAX_DEPTH) -> DataFrame:
    """root, node, depth: all nodes reachable from each root with the least number of steps; ``edges`` is (src, dst).

    A loop ends when a step finds nothing new, and with an error when ``max_depth`` steps still find something. Its frontier is written, so a lost executor costs no earlier step.
    """
    steps = []
    reached = roots.select("root", F.col("root").alias("node"), F.lit(0).cast("bigint").alias("depth")).distinct()
    frontier = reached
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = step.join(reached.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("bigint"))
        frontier = written(frontier, "frontier")
        steps.append(frontier)
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    else:
        raise ValueError(f"nodes lie more than {max_depth} steps away")
    out = written(reached, "closure")
    for step in steps:
        dropped(step)
    return out


def canonical(aliases: DataFrame, *, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """id, owner, hops: where each id's chain of merges ends, by pointer jumping; ``aliases`` is (id, merged_into) with null for no merge.

    Every round doubles the hops, is written, and the loop ends when no owner moves: a chain of n merges takes log2(n)
    rounds. Ids on a circle have no end, which is an error.
    """
    moved = F.col("merged_into").isNotNull()
    now = written(aliases.select("id", F.coalesce("merged_into", "id").alias("owner"), moved.cast("bigint").alias("hops"), moved.alias("moved")), "owners")
    for turn in range(max_rounds + 1):
        if now.filter("moved").isEmpty():
            break
        if turn == max_rounds:
            raise ValueError("merges run in a circle")
        ahead = now.filter("owner <> id").select(F.col("id").alias("owner"), F.col("owner").alias("next"), F.col("hops").alias("more"))
        joined = now.join(ahead, "owner", "left")
        before, now = now, written(joined.select("id", F.coalesce("next", "owner").alias("owner"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("moved")), "owners")
        dropped(before)
    if not now.filter("owner = id and hops > 0").isEmpty():
        raise ValueError("merges run in a circle")
    return now.drop("moved")
