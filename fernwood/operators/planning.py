"""Budgeted batches of texts for an embedding or ranking service, and its injectable runner."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernwood.functions import text as T
from fernwood.sources.scratch import written

MAX_TOKENS = 8000


def pending(texts: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``texts`` without a result in ``done``."""
    return texts.join(done.select(key).distinct(), key, "left_anti")


def sized(texts: DataFrame) -> DataFrame:
    return texts.withColumns({"chars": F.length("text").cast("bigint"), "tokens": T.token_estimate(F.col("text"))}).withColumn("skipped", F.col("tokens") > MAX_TOKENS)


class Filling:
    """The batch that is being filled: its number, how many texts it has and their characters."""

    def __init__(self, batch_size: int, max_chars: int, batch: int = 0, used: int = 0, held: int = 0) -> None:
        self.batch_size, self.max_chars = batch_size, max_chars
        self.batch, self.used, self.held = batch, used, held

    def add(self, chars: int) -> bool:
        """Adds a text; true if it opened a new batch."""
        opens = self.used > 0 and (self.used >= self.batch_size or self.held + chars > self.max_chars)
        if opens:
            self.batch, self.used, self.held = self.batch + 1, 0, 0
        self.used += 1
        self.held += chars
        return opens


def _by_run(rows: Iterator[pd.DataFrame], group: str) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The consecutive parts of each (group, run) in sorted batches."""
    for part in rows:
        new = (part[group].ne(part[group].shift()) & ~(part[group].isna() & part[group].shift().isna())) | part["_run"].ne(part["_run"].shift())
        for _, some in part.groupby(new.cumsum(), sort=False):
            key = some[group].iloc[0]
            yield (None if pd.isna(key) else key, int(some["_run"].iloc[0])), some


def greedy_batches(texts: DataFrame, *, group: str, order: str, batch_size: int, max_chars: int) -> DataFrame:
    """``texts`` (with chars) numbered in batches: within a group, in order, a batch ends when the next text would exceed either bound; a larger text stands alone.

    Batch numbers depend on all earlier rows, yet a group of any size is shared out: rows are cut by range into runs. What
    enters a run is an open batch, which ends within the run's first ``batch_size`` texts, and from there on all is
    fixed. So each run says, for every such place, how it ends; one short row a run is chained, and runs are numbered side by side.
    """
    names = texts.columns
    fill = functools.partial(Filling, batch_size, max_chars)
    kind = dict(texts.dtypes)[group]
    runs = written(texts.repartitionByRange(group, order).withColumn("_run", F.spark_partition_id()), "runs")
    spread = runs.repartition(group, "_run").sortWithinPartitions(group, "_run", order)

    def summarise(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, heads, ends = None, [], []

        def summary() -> pd.DataFrame:
            return pd.DataFrame({group: [now[0]], "_run": [now[1]], "heads": [heads], "batches": [[e.batch for e in ends]], "used": [[e.used for e in ends]], "held": [[e.held for e in ends]]})

        for key, some in _by_run(rows, group):
            if key != now:
                if now is not None:
                    yield summary()
                now, heads, ends = key, [], []
            for n in some["chars"].tolist():
                if len(heads) <= batch_size:  # a batch may open here
                    heads.append(n)
                    ends.append(fill())
                for e in ends:
                    e.add(n)
        if now is not None:
            yield summary()

    def chain(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for part in rows:
            out = []
            for r in part.itertuples(index=False, name=None):
                key, _, heads, batches, used, held = r
                key = None if pd.isna(key) else key
                if state is None or key != now:
                    now, state = key, fill()
                out.append((state.batch, state.used, state.held))
                for j, n in enumerate(heads):
                    if state.used == 0 or state.add(n):  # the run's own course from its text j on
                        state = fill(state.batch + int(batches[j]), int(used[j]), int(held[j]))
                        break
            yield pd.DataFrame({group: part[group], "_run": part["_run"], "batch": [o[0] for o in out], "used": [o[1] for o in out], "held": [o[2] for o in out]})

    def number(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for key, some in _by_run(rows, group):
            if key != now:
                first = some.iloc[0]
                now, state = key, fill(int(first["_batch"]), int(first["_used"]), int(first["_held"]))
            batch = []
            for n in some["chars"].tolist():
                state.add(n)
                batch.append(state.batch)
            yield some[names].assign(batch=batch)

    numbers = "array<bigint>"
    sums = spread.select(group, "_run", "chars").mapInPandas(summarise, f"`{group}` {kind}, _run int, heads {numbers}, batches {numbers}, used {numbers}, held {numbers}")
    chained = sums.repartition(group).sortWithinPartitions(group, "_run").mapInPandas(chain, f"`{group}` {kind}, _run int, batch long, used long, held long")
    starts = chained.select(F.col(group).alias("_group"), F.col("_run").alias("_of"), F.col("batch").alias("_batch"), F.col("used").alias("_used"), F.col("held").alias("_held"))
    entered = runs.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_run") == F.col("_of"))).drop("_group", "_of")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", batch long"
    return entered.repartition(group, "_run").sortWithinPartitions(group, "_run", order).mapInPandas(number, schema)


def within_budget(batches: DataFrame, *, group: str, max_calls: int, max_chars: int) -> DataFrame:
    """Per group the batches before the first that exceeds the calls or the characters."""
    each = batches.groupBy(group, "batch").agg(F.count("*").alias("rows"), F.sum("chars").alias("chars"))
    run = Window.partitionBy(group).orderBy("batch")
    spent = each.withColumn("spent", F.sum("chars").over(run))
    stop = spent.withColumn("over", F.max((F.col("spent") > max_chars) | (F.col("batch") >= max_calls)).over(run))
    return stop.filter(~F.col("over")).groupBy(group).agg(F.sum("rows").alias("rows"), F.count("*").alias("calls"), F.sum("chars").alias("chars"))


def embed(texts: DataFrame, provider: Callable[[list[str]], list[list[float]]], *, key: str, batch: int = 10) -> DataFrame:
    """key, vector by an injected provider that gets up to ``batch`` texts a call."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            for i in range(0, len(part), batch):
                some = part.iloc[i : i + batch]
                yield pd.DataFrame({key: some[key], "vector": provider(some["text"].tolist())})

    return texts.select(key, "text").mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, vector array<double>")


def index_vectors(texts: DataFrame, vectors: DataFrame, provider: Callable[[list[str]], list[list[float]]], *, key: str, budget: int = 100, batch: int = 10, dim: int | None = None, forbidden: DataFrame | None = None) -> DataFrame:
    """key, vector of the texts that have none yet, by an injected provider; an error before any call if more than ``budget`` lack one or one of them is ``forbidden``.

    A provider that returns another number of vectors, or one that is not valid (of ``dim`` components, finite, not zero), fails the job. Keys with a vector are not sent again.
    """
    lacking = written(texts.select(key, "text").join(vectors.select(key), key, "left_anti"), "lacking")
    n = lacking.count()
    if n > budget:
        raise ValueError(f"{n} texts exceed the budget of {budget}")
    if forbidden is not None and not lacking.join(forbidden.select(key), key, "left_semi").isEmpty():
        raise ValueError("texts whose vectors must not be made anew are among them")

    def checked(some: list[str]) -> list[list[float]]:
        out = provider(some)
        if len(out) != len(some) or any(not all(map(math.isfinite, v)) or not any(v) or (dim and len(v) != dim) for v in out):
            raise ValueError("the provider's vectors are not valid")
        return out

    return embed(lacking, checked, key=key, batch=batch)
