"""Relations between records, versions, batches and links: look-ups whose tables and columns are the caller's.

Joins are equalities that adaptive execution may split; groupings are pre-aggregated in their tasks; ``newest`` and ``listed`` limit each group before the
shuffle where they rank. Null keys meet nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holding(items: DataFrame, key: str, owners: list[str], identifiers: DataFrame, owner: str) -> DataFrame:
    """``key`` of the items that own an identifier themselves or through any of the columns ``owners``; ``identifiers`` has the owners of the wanted one."""
    own = items.select(key, F.explode(F.array(*(F.col(c) for c in owners))).alias("_owner"))
    return own.join(identifiers.select(F.col(owner).alias("_owner")), "_owner", "left_semi").select(key).distinct()


def of_last(rows: DataFrame, group: str, generation: str) -> DataFrame:
    """The rows of each group's last generation; groups and generations that are null have none."""
    last = rows.groupBy(group).agg(F.max(generation).alias(generation))
    return rows.join(last, [group, generation])


def targeting(rows: DataFrame, column: str, targets: DataFrame, target: str) -> DataFrame:
    """The rows that point at one of the targets."""
    return rows.join(targets.select(F.col(target).alias(column)), column, "left_semi")


def with_latest(rows: DataFrame, group: str, events: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the value of their group's latest event, null where it has none."""
    latest = events.groupBy(group).agg(F.max(F.struct(*order, value))[value].alias(name))
    return rows.join(latest, group, "left")


def fresh_or_linked(items: DataFrame, key: str, parts: DataFrame, of: str, when: str, since: str, links: DataFrame, target: str) -> DataFrame:
    """``key`` of items whose newest part is not older than ``since``, or that a link points at."""
    newest = parts.groupBy(F.col(of).alias(key)).agg(F.max(when).alias("_newest"))
    fresh = items.select(key).join(newest, key).filter(F.col("_newest") >= F.lit(since).cast("timestamp")).select(key)
    return fresh.unionByName(items.select(key).join(links.select(F.col(target).alias(key)), key, "left_semi")).distinct()


def whole_groups(members: DataFrame, group: str, member: str, present: DataFrame) -> DataFrame:
    """group, ids of the groups all of whose members are present: none of their ids is without a counterpart. Null ids count as missing."""
    there = present.select(F.col(member)).distinct().withColumn("_there", F.lit(True))
    met = members.select(group, member).join(there, member, "left")
    return met.groupBy(group).agg(F.bool_and(F.col("_there").isNotNull()).alias("_whole"), F.count("*").alias("ids")).filter("_whole").select(group, "ids")


def recoverable(batches: DataFrame, group: str, ids: str, chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """group, missing: succeeded batches (with an array of ids) some of whose chunks are there and have no vector yet, and which ones.

    The array is taken apart, so a batch of any size is rows; ids without a chunk do not count.
    """
    each = batches.select(group, F.explode(F.array_distinct(ids)).alias(key)).join(chunks.select(key).distinct(), key, "left_semi")
    lacking = each.join(vectors.select(key).distinct(), key, "left_anti")
    return lacking.groupBy(group).agg(F.sort_array(F.collect_list(key)).alias("missing"))  # a batch's own ids at most


def outcomes(batches: DataFrame, key: str, requests: DataFrame, of: str, done: Column) -> DataFrame:
    """key, requests, state of every batch, those without a request included."""
    counts = requests.groupBy(F.col(of).alias(key)).agg(F.count("*").alias("requests"), F.count_if(done).alias("_done"))
    state = F.when(F.col("requests").isNull(), "not_sent").when(F.col("_done") == F.col("requests"), "succeeded").when(F.col("_done") == 0, "started").otherwise("ambiguous")
    return batches.select(key).join(counts, key, "left").select(key, F.coalesce("requests", F.lit(0)).alias("requests"), state.alias("state"))


def entries(rows: DataFrame, key: str, manifest: str) -> DataFrame:
    """key, name, value of every entry of JSON objects; broken ones have none."""
    return rows.select(key, F.explode(F.from_json(manifest, "map<string,string>")).alias("name", "value"))


def chained(start: DataFrame, *links: tuple[DataFrame, str, str]) -> DataFrame:
    """Rows joined from link to link (table, column before, column there): every link must exist."""
    for table, before, there in links:
        start = start.join(table, F.col(before) == F.col(there))
    return start


def hanging(goals: DataFrame, key: str, kinds: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """key, kind, n, newest: what hangs on each goal; ``kinds``: name -> (rows, column of the goal, column of the time)."""
    parts = None
    for kind, (rows, of, at) in kinds.items():
        one = rows.select(F.col(of).alias(key), F.lit(kind).alias("kind"), F.col(at).alias("_at"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.join(goals.select(key), key, "left_semi").groupBy(key, "kind").agg(F.count("*").alias("n"), F.to_date(F.max("_at")).alias("newest"))


def newest(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """``rows`` with their place in their group, of the first ``k``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint")).filter(F.col("place") <= k)


def listed(rows: DataFrame, group: str, order: list[Column | str], k: int, value: str) -> DataFrame:
    """group, values: the first ``k`` values of each group as a list in order."""
    top = newest(rows, group, order, k)
    return top.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", value))), lambda x: x[value]).alias("values"))


def behind(rows: DataFrame, group: str, phase: Column) -> DataFrame:
    """group, earlier: how many rows stand in an earlier phase than their group's furthest one."""
    placed = rows.select(group, phase.alias("_phase"))
    furthest = placed.groupBy(group).agg(F.max("_phase").alias("_furthest"))
    return placed.join(furthest, group).filter("_phase < _furthest").groupBy(group).agg(F.count("*").alias("earlier"))


def suffixed(rows: DataFrame, path: str, key: str) -> DataFrame:
    """``rows`` with ``part``: the path, with a running number from its second row on."""
    place = F.row_number().over(Window.partitionBy(path).orderBy(key))
    return rows.withColumn("_place", place).withColumn("part", F.concat(path, F.when(F.col("_place") > 1, F.concat(F.lit("-"), F.col("_place").cast("string"))).otherwise(""))).drop("_place")


def heading_levels(rows: DataFrame, text: str) -> DataFrame:
    """level, n: the headings of markdown texts outside of fences, by their number of signs."""
    lines = rows.select(F.explode(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?ms)^\s{0,3}```.*?(?:^\s{0,3}```[^\n]*$|\z)", ""), "\n")).alias("line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6}) ", 1))
    return lines.select(level.cast("long").alias("level")).filter("level > 0").groupBy("level").agg(F.count("*").alias("n"))


def known(rows: DataFrame, held: DataFrame, keys: list[str], found: str) -> DataFrame:
    """``rows`` with the least ``found`` of the held rows that agree in all ``keys``, nulls with nulls; null where none does."""
    names = {k: f"_{i}" for i, k in enumerate(keys)}
    least = held.groupBy(*(F.col(k).alias(n) for k, n in names.items())).agg(F.min(found).alias(found))
    on = None
    for k, n in names.items():
        one = F.col(k).eqNullSafe(F.col(n))
        on = one if on is None else on & one
    return rows.join(least, on, "left").drop(*names.values())


def research(revisions: DataFrame, current: DataFrame, query: str, *, context: str | None = None, links: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """record_id, id, kind, is_current, created_at, ref of revisions whose body holds the query: current ones first, then the newest, then by id.

    ``revisions``: id, record_id, body, created_at; ``current``: record_id, revision_id, kind, project; with a ``context``, records of that project or that a link
    (context, target) ties to it. An empty query is an error.
    """
    if not query:
        raise ValueError("a query is needed")
    met = revisions.filter(F.contains(F.lower("body"), F.lit(query.lower()))).join(current, "record_id")
    if context is not None:
        tied = F.col("project") == context
        if links is not None:
            met = met.join(links.filter(F.col("context") == context).select(F.col("target").alias("record_id")).distinct().withColumn("_tied", F.lit(True)), "record_id", "left")
            tied = F.coalesce(tied, F.lit(False)) | F.coalesce("_tied", F.lit(False))
        met = met.filter(tied)
    is_current = F.coalesce(F.col("id") == F.col("revision_id"), F.lit(False))
    ref = F.concat(F.lit("ref/"), F.col("record_id").cast("string"), F.lit("/revision/"), F.col("id").cast("string"))
    return met.select("record_id", "id", "kind", is_current.alias("is_current"), "created_at", ref.alias("ref")).orderBy(F.desc("is_current"), F.desc("created_at"), "id").limit(limit)
