"""Small relational look-ups: optional filters, tree context, statuses, ledgers, and the codec of chunk ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwood.functions import vectors as V

MOST_ROWS = 200  # of a dump
#: The second form of chunk ids, ``c2.<generation>.<hash>.<chunker>.<n>:<length of path>:<path>:<part>``, and the first one.
SECOND = r"(?s)^c2\.([0-9a-z]{8})\.([0-9a-f]{12})\.([0-9a-f]{8})\.([0-9]+):([0-9]+):(.*)$"
FIRST = r"^([0-9]+)__(.+)__p([0-9]+)$"


def optional(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows with these values; a value of none leaves its column open."""
    for name, value in values.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def listed(key: Column, keys: str) -> Column:
    """Whether a key is in a comma list."""
    return key.cast("string").isin([k.strip() for k in keys.split(",") if k.strip()])


def included(df: DataFrame, key: str, fields: Mapping[str, str], wanted: Sequence[str]) -> DataFrame:
    """The key and the wanted ones of ``fields`` (name -> column); unknown names are an error."""
    unknown = set(wanted) - set(fields)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    return df.select(key, *(F.col(fields[w]).alias(w) for w in fields if w in wanted))


def tree(chunks: DataFrame) -> DataFrame:
    return chunks.select("parent", "ordinal").distinct()


def context(hits: DataFrame, chunks: DataFrame, reach: int = 1) -> DataFrame:
    """hits with ``context``: the ordinals up to ``reach`` before and after under one parent, hits themselves excepted, in order."""
    around = hits.select("parent", "ordinal", F.explode(F.sequence(F.col("ordinal") - reach, F.col("ordinal") + reach)).alias("other"))
    there = around.join(chunks.select("parent", F.col("ordinal").alias("other")), ["parent", "other"]).join(hits.select("parent", F.col("ordinal").alias("other")), ["parent", "other"], "left_anti")
    lists = there.groupBy("parent", "ordinal").agg(F.array_sort(F.collect_set("other")).alias("context"))  # 2 * reach at most
    return hits.join(lists, ["parent", "ordinal"], "left").withColumn("context", F.coalesce("context", F.array().cast("array<bigint>")))


def status(counts: DataFrame, budget: int) -> DataFrame:
    """matched, unfinished, status of a search."""
    told = F.when(F.col("matched") > budget, "candidate_budget_exhausted").when(F.col("matched") > 0, "matching_results").when(F.col("unfinished") > 0, "processing_incomplete").otherwise("no_matching_results")
    return counts.select("matched", "unfinished", told.alias("status"))


def chunk_id(generation: Column, content_hash: Column, chunker: Column, version: Column, n: Column, path: Column, part: Column) -> Column:
    """A chunk id of the second form; the path may hold any character, as its length goes before it. Null for a generation below 0."""
    number = F.lpad(F.lower(F.conv(generation.cast("string"), 10, 36)), 8, "0")
    mark = F.substring(F.sha2(F.concat(chunker, version), 256), 1, 8)
    made = F.concat(F.lit("c2."), number, F.lit("."), F.substring(F.substring_index(content_hash, ":", -1), 1, 12), F.lit("."), mark, F.lit("."), n.cast("string"), F.lit(":"), F.length(path).cast("string"), F.lit(":"), path, F.lit(":"), part)
    return F.when((generation >= 0) & (generation < 36**8), made)


def parsed_chunk_id(value: Column) -> Column:
    """generation, hash, chunker, n, path, part, legacy, valid of a chunk id; the first form is read-only and has no generation."""
    g = [F.regexp_extract(value, SECOND, i) for i in range(1, 7)]
    length, rest = F.when(F.length(g[4]) <= 9, g[4].try_cast("int")), g[5]
    path = rest.substr(F.lit(1), length)
    second = (g[0] != "") & length.isNotNull() & (rest.substr(length + 1, F.lit(1)) == ":")
    # Numbers with leading zeros would not read back to the same id.
    exact = ~F.rlike(value, F.lit(r"^c2\.[^:]*\.0[0-9]+:")) & ~F.rlike(value, F.lit(r"^c2\.[^:]*:0[0-9]+:"))
    first = F.rlike(value, F.lit(FIRST))
    return F.struct(
        F.when(second, F.conv(g[0], 36, 10).cast("bigint")).alias("generation"), F.when(second, g[1]).alias("hash"), F.when(second, g[2]).alias("chunker"), F.when(second, g[3].try_cast("bigint")).alias("n"),
        F.when(second, path).when(first, F.regexp_extract(value, FIRST, 2)).alias("path"), F.when(second, rest.substr(length + 2, F.length(rest))).when(first, F.concat(F.lit("p"), F.regexp_extract(value, FIRST, 3))).alias("part"),
        first.alias("legacy"), F.coalesce((second & exact) | first, F.lit(False)).alias("valid"),
    )


def similar(vectors: DataFrame, key: int, k: int, *, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, score of the k rows nearest to that of ``key``; degraded and empty if it has no vector."""
    own = vectors.filter(F.col(id_) == key).select(vector).first()
    if own is None or own[0] is None:
        return vectors.select(id_, F.lit(0.0).alias("score"), F.lit(True).alias("degraded")).limit(0)
    near = vectors.filter(F.col(id_) != key).select(id_, V.cosine(F.col(vector), V.literal([float(x) for x in own[0]])).alias("s"))
    return near.orderBy(F.desc("s"), id_).limit(k).select(id_, F.round("s", 6).alias("score"), F.lit(False).alias("degraded"))


def resolver_url(identifier: Column) -> Column:
    """The resolver's address of an identifier; slashes stay, blanks become %20."""
    coded = F.regexp_replace(F.regexp_replace(F.url_encode(identifier), "%2F", "/"), "\\+", "%20")
    return F.concat(F.lit("https://doi.org/"), coded)


def dump(df: DataFrame, key: str, rows: int = 50) -> DataFrame:
    """The first rows by key, 1 to ``MOST_ROWS`` of them."""
    return df.orderBy(key).limit(max(1, min(rows, MOST_ROWS)))


def ledger(chunks: DataFrame, key: str, size: int) -> DataFrame:
    """batch_id, members, chars, state of batches of ``size`` neighbouring keys; ``chunks`` has chars and ``has`` (null: no vector)."""
    ids = F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string"))  # ``size`` at most
    some = chunks.groupBy(F.floor(F.col(key) / size).alias("batch")).agg(F.sha2(F.array_join(ids, ","), 256).alias("batch_id"), F.count("*").alias("members"), F.sum("chars").alias("chars"), F.count("has").alias("with_vector"))
    state = F.when(F.col("with_vector") == F.col("members"), "succeeded").when(F.col("with_vector") == 0, "not_sent").otherwise("ambiguous")
    return some.select("batch_id", "members", "chars", state.alias("state"))


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule, in one pass."""
    counts = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules))).alias("r")).select("r.rule", "r.n")
