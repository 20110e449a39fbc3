"""Joins with counted ids, and columns out of the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwood.sources.scratch import dropped, written

__all__ = ["BROADCAST_IDS", "dropped", "joined_by_id", "sheltered", "written"]

#: Rows of one 64-bit id that are sent to all executors at most, about 32 MB as a hash table.
BROADCAST_IDS = 1_000_000


def joined_by_id(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """A join of wide rows with a table of ids: up to ``BROADCAST_IDS`` ids, which are counted, go to the rows; more meet them in a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def sheltered(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but ``used`` under reserved names, and the way back to the names and order of ``df``: so no column of a user can clash with one of an operator."""
    names = [c if c in used else f"sheltered__{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), lambda out: out.select(*names).toDF(*df.columns)
