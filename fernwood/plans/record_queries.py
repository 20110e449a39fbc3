"""Catalogue, planning, graph and project-fact queries over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernwood.functions import text as T
from fernwood.operators import graphs, literature, planning, statistics
from fernwood.sources.tables import table

NOW = "2000-01-01"


def eligible_join(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue's five-way join with set, range and status filters."""
    t = lambda name: table(spark, d, name)
    asia = t("region").filter(F.col("r_name").isin("ASIA", "EUROPE", "AMERICA")).select("r_regionkey")
    people = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(asia, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name")
    orders = t("orders").filter(F.col("o_orderstatus").isin("O", "F") & F.year("o_orderdate").between(1993, 1997)).select("o_orderkey", "o_custkey")
    items = t("lineitem").filter("l_returnflag <> 'R'").select("l_orderkey", "l_quantity")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n_items"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def linked_scope_semi(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


def missing_embeddings_anti(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return planning.pending(table(spark, d, "documents").select("doc_id", "lang"), done, "doc_id")


def left_join_counts(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "customer").filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "nation").join(per, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_customers"))


def latest_current(spark: SparkSession, d: str) -> DataFrame:
    """The newest order of each customer; of equal dates the larger key."""
    now = literature.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return now.select("o_custkey", "o_orderkey", "o_orderstatus")


def per_group_cap5(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").withColumn("place", F.row_number().over(order)).filter("place <= 5").select("source", F.col("place").cast("bigint").alias("place"), "doc_id", "n_chars")


def context_window(spark: SparkSession, d: str) -> DataFrame:
    """Every turn with the roles one before and two after it."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    around = F.collect_list("role").over(by.rowsBetween(-1, 2))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(around, ",").alias("roles"), F.lag("turn").over(by).alias("before"), F.lead("turn").over(by).alias("after"))


def page_offset(spark: SparkSession, d: str) -> DataFrame:
    """Rows 101 to 150 by price: the head is bounded before it is numbered."""
    head = table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(150)
    place = F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("bigint")
    return head.withColumn("place", place).filter("place > 100").select("place", "o_orderkey", "o_totalprice")


def probe_limit(spark: SparkSession, d: str) -> DataFrame:
    """Whether more than 100 rows match: one more than the limit is asked for."""
    probe = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").orderBy("o_orderkey").limit(101)
    return probe.agg(F.least(F.count("*"), F.lit(100)).cast("bigint").alias("shown"), (F.count("*") > 100).alias("truncated"))


def dedupe_exact_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def composite_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash"), "lang", "source").agg(F.min("doc_id").alias("doc_id"))


def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    return a.union(table(spark, d, "supplier").select("s_nationkey")).distinct()


def candidate_diff(spark: SparkSession, d: str) -> DataFrame:
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    words = table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("thing"))).select("doc_id")
    only = vec.join(words, "doc_id", "left_anti").withColumn("side", F.lit("vector"))
    return only.unionByName(words.join(vec, "doc_id", "left_anti").withColumn("side", F.lit("keyword")))


def multiset_digest(spark: SparkSession, d: str) -> DataFrame:
    """A count and order-free digests of each customer segment's rows; repeated rows count. Totals beyond 64 bits wrap around (modulo 2^64, signed), as a digest may; all rows count."""
    row = F.sha2(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment"), 256)
    part = F.conv(row.substr(1, 12), 16, 10).cast("bigint")
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), statistics.wrapped_sum(part).alias("total"), F.bit_xor(part).alias("parity"))


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median and the value at nearest rank 95 % of each event type, exact without holding a type in one task."""
    ranks = {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor(n / 2) + 1, "p95": statistics.quantile(95, 100)}
    got = statistics.at_ranks(table(spark, d, "events").select("event_type", "value"), "event_type", "value", ranks)
    each = got.groupBy("event_type").agg(F.avg(F.when(F.col("name") != "p95", F.col("value"))).alias("p50"), F.max(F.when(F.col("name") == "p95", F.col("value"))).alias("p95"))
    return each.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def next_sequence(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    people = table(spark, d, "customer").select("c_custkey")
    return people.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", (F.coalesce("last", F.lit(0)) + 1).cast("bigint").alias("next"))


def json_metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    """Year-like range and status on JSON properties; a missing value drops the row from the range and counts as 'unknown' in the status."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    status = F.coalesce(F.get_json_object("props", "$.status"), F.lit("unknown"))
    return table(spark, d, "events").filter(k.between(10, 60) & status.isin("unknown", "active")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


def alias_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Copies merge into the first copy of their source, and that into the first of all; each chain's end is its owner."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), "source")
    of_source = docs.groupBy("hash", "source").agg(F.min("doc_id").alias("near"))
    firsts = of_source.join(of_source.groupBy("hash").agg(F.min("near").alias("far")), "hash")
    target = F.when(F.col("doc_id") != F.col("near"), F.col("near")).when(F.col("near") != F.col("far"), F.col("far"))
    chain = docs.join(firsts, ["hash", "source"]).select(F.col("doc_id").alias("id"), target.alias("merged_into"))
    return graphs.canonical(chain).select("id", "owner")


def merge_impact(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each relation point at the suppliers of one nation."""
    gone = table(spark, d, "supplier").filter("s_nationkey = 3").select("s_suppkey")
    items = table(spark, d, "lineitem").join(gone, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    orders = table(spark, d, "orders").join(items.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return items.agg(F.lit("lineitem").alias("relation"), F.count("*").alias("n")).unionByName(orders.agg(F.lit("orders").alias("relation"), F.count("*").alias("n"))).unionByName(gone.agg(F.lit("supplier").alias("relation"), F.count("*").alias("n")))


def evidence_closure(spark: SparkSession, d: str) -> DataFrame:
    """Steps from each large part to what its chain of halved keys reaches."""
    parts = table(spark, d, "part")
    edges = parts.filter("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("bigint").alias("dst"))
    roots = parts.filter("p_size = 50").select(F.col("p_partkey").alias("root"))
    return graphs.closure(roots, edges).groupBy("root").agg(F.count("*").alias("nodes"), F.max("depth").alias("height"))


def doc_relevance_max(spark: SparkSession, d: str) -> DataFrame:
    """Turns as chunks of a conversation: the best matched length, else half the best one."""
    hit = F.contains(F.lower("text"), F.lit("thing"))
    per = table(spark, d, "conversations").groupBy("conv_id").agg(literature.relevance(F.length("text") / 1000.0, hit).alias("r"))
    return per.select("conv_id", F.round("r", 6).alias("relevance"))


def recommendation_bucket(spark: SparkSession, d: str) -> DataFrame:
    rel = F.least(F.col("n_chars") / 4000.0, F.lit(1.0))
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(literature.recommendation(rel, F.when(F.col("quality") == 1, 0.75).otherwise(0.4)).alias("bucket"))
    return both.groupBy("bucket").agg(F.count("*").alias("n"))


def quality_mean(spark: SparkSession, d: str) -> DataFrame:
    q, t = F.col("quality").cast("double"), F.when(F.col("toxic") == 0, 1.0)
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", literature.mean_of(q, t).alias("evidence"), F.when(F.col("n_chars") > 1000, 0.6).alias("prior"))
    return both.select("doc_id", F.round("evidence", 6).alias("evidence_mean"), F.round(F.greatest("prior", "evidence"), 6).alias("quality_final"))


def pending_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = planning.sized(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chars", "skipped")
    done = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("done"))
    both = docs.join(done, "doc_id", "left")
    left = F.col("done").isNull()
    return both.agg(F.count("*").alias("total"), F.sum(left.cast("bigint")).alias("pending"), F.sum(F.when(left, F.col("chars")).otherwise(0)).alias("pending_chars"), F.sum((left & F.col("skipped")).cast("bigint")).alias("skipped"), F.round(F.count("done") / F.count("*"), 6).alias("completion"))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", F.length("text").cast("bigint").alias("chars"))
    return planning.greedy_batches(docs, group="source", order="doc_id", batch_size=10, max_chars=12_000)


def greedy_batches(spark: SparkSession, d: str) -> DataFrame:
    return _batches(spark, d).select("source", "doc_id", "batch")


def prefix_budget(spark: SparkSession, d: str) -> DataFrame:
    return planning.within_budget(_batches(spark, d), group="source", max_calls=5, max_chars=40_000)


def fact_status_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        one = table(spark, d, name).agg(F.lit(name).alias("relation"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def stale_projects(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose last order is over two years old at the stated time, while newer work exists in their segment."""
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    both = table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"))
    newest = both.groupBy("c_mktsegment").agg(F.max("at").alias("newest"))
    age = F.datediff(F.lit(NOW).cast("date"), F.col("at").cast("date"))
    return both.join(newest, "c_mktsegment").select("c_custkey", age.cast("bigint").alias("age_days"), ((age > 730) & (F.col("newest") > F.col("at"))).alias("stale"))


def journal_search(spark: SparkSession, d: str) -> DataFrame:
    """Every given word must stand in some text column, whatever its case."""
    fields = ["p_name", "p_brand", "p_type"]
    found = table(spark, d, "part")
    for word in ("brand", "e"):
        any_field = F.lit(False)
        for f in fields:
            any_field = any_field | F.col(f).ilike(f"%{word}%")
        found = found.filter(any_field)
    return found.select("p_partkey", "p_brand", "p_type")


def goal_order(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer by position, those without one last, then by key."""
    position = F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey") % 7)
    order = Window.partitionBy("o_custkey").orderBy(F.coalesce(position, F.lit(999)), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).cast("bigint").alias("place"))


def phase_counts(spark: SparkSession, d: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("phase")).agg(F.sum(done.cast("bigint")).alias("done"), F.count("*").alias("total"))


def upsert_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Each user's newest event of a type replaces the older ones; of equal times the larger id."""
    now = literature.latest(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return now.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def warning_union(spark: SparkSession, d: str) -> DataFrame:
    """Per source the sorted set of all warnings of its documents."""
    flags = F.filter(F.array(F.when(F.col("toxic") == 1, "source_toxic"), F.when(F.col("quality") == 0, "source_low_quality"), F.when(F.col("quality").isNull(), "source_unrated")), lambda x: x.isNotNull())
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.select("source", F.explode(flags).alias("w")).distinct().groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("w")), ",").alias("warnings"))


def blob_audit(spark: SparkSession, d: str) -> DataFrame:
    """Stored texts against the texts that pages and labels refer to: unreferenced or missing."""
    have = table(spark, d, "documents").select("doc_id").withColumn("stored", F.lit(1))
    refs = table(spark, d, "pages").select(F.col("page_id").alias("doc_id")).unionByName(table(spark, d, "labels").select((F.col("doc_id") + 100).alias("doc_id"))).distinct().withColumn("wanted", F.lit(1))
    both = have.join(refs, "doc_id", "full_outer").select(F.when(F.col("stored").isNull(), "missing").when(F.col("wanted").isNull(), "unreferenced").otherwise("ok").alias("state"))
    return both.groupBy("state").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        eligible_join, linked_scope_semi, missing_embeddings_anti, left_join_counts, latest_current, per_group_cap5, context_window, page_offset, probe_limit, dedupe_exact_hash, composite_dedupe,
        union_distinct, candidate_diff, multiset_digest, percentiles, next_sequence, json_metadata_filter, alias_canonical, merge_impact, evidence_closure, doc_relevance_max, recommendation_bucket, quality_mean,
        pending_stats, greedy_batches, prefix_budget, fact_status_counts, stale_projects, journal_search, goal_order, phase_counts, upsert_latest_wins, warning_union, blob_audit,
    )
}
BATCH_SQL = """numbered AS (SELECT source, doc_id, length(text)::BIGINT AS chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    walk(source, i, doc_id, chars, batch, used, held) AS (
        SELECT source, i, doc_id, chars, 0::BIGINT, 1::BIGINT, chars FROM numbered WHERE i = 1
        UNION ALL
        SELECT n.source, n.i, n.doc_id, n.chars, CASE WHEN w.used >= 10 OR w.held + n.chars > 12000 THEN w.batch + 1 ELSE w.batch END,
               CASE WHEN w.used >= 10 OR w.held + n.chars > 12000 THEN 1 ELSE w.used + 1 END, CASE WHEN w.used >= 10 OR w.held + n.chars > 12000 THEN n.chars ELSE w.held + n.chars END
        FROM walk w JOIN numbered n ON n.source = w.source AND n.i = w.i + 1
    )"""
SQL = {
    "eligible_join": """SELECT n_name, count(*) AS n_items, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name IN ('ASIA', 'EUROPE', 'AMERICA') AND o_orderstatus IN ('O', 'F') AND year(o_orderdate) BETWEEN 1993 AND 1997 AND l_returnflag <> 'R' GROUP BY n_name""",
    "linked_scope_semi": "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "missing_embeddings_anti": "SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)",
    "left_join_counts": "SELECT n_name, count(c_custkey) AS n_customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY n_name",
    "latest_current": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders) WHERE p = 1",
    "per_group_cap5": "SELECT source, place, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 5",
    "context_window": "SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), ',') AS roles, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations",
    "page_offset": "SELECT * FROM (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderkey, o_totalprice FROM orders) WHERE place BETWEEN 101 AND 150",
    "probe_limit": "SELECT CAST(least(count(*), 100) AS BIGINT) AS shown, count(*) > 100 AS truncated FROM orders WHERE o_orderpriority = '1-URGENT'",
    "dedupe_exact_hash": "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "composite_dedupe": "SELECT sha256(text) AS hash, lang, source, min(doc_id) AS doc_id FROM documents GROUP BY ALL",
    "union_distinct": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "candidate_diff": """SELECT vec_id AS doc_id, 'vector' AS side FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE contains(lower(text), 'thing'))
        UNION ALL SELECT doc_id, 'keyword' FROM documents WHERE contains(lower(text), 'thing') AND doc_id NOT IN (SELECT vec_id FROM embeddings)""",
    "multiset_digest": """WITH h AS (SELECT c_mktsegment, ('0x' || left(sha256(c_custkey || '|' || c_name || '|' || c_mktsegment), 12))::BIGINT AS part FROM customer)
        SELECT c_mktsegment, count(*) AS n, CAST(sum(part) AS BIGINT) AS total, bit_xor(part) AS parity FROM h GROUP BY 1""",
    "percentiles": "SELECT event_type, round(median(value), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    "next_sequence": "SELECT c_custkey, CAST(coalesce(max(o_orderkey), 0) + 1 AS BIGINT) AS next FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "json_metadata_filter": """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events
        WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 60 AND coalesce(json_extract_string(props, '$.status'), 'unknown') IN ('unknown', 'active') GROUP BY 1""",
    "alias_canonical": "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY sha256(text)) AS owner FROM documents",
    "merge_impact": """WITH gone AS (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3), items AS (SELECT * FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM gone))
        SELECT 'lineitem' AS relation, count(*) AS n FROM items UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM items) UNION ALL SELECT 'supplier', count(*) FROM gone""",
    "evidence_closure": """WITH RECURSIVE c(root, node, depth) AS (SELECT p_partkey, p_partkey, 0::BIGINT FROM part WHERE p_size = 50 UNION SELECT root, p_partkey // 2, depth + 1 FROM c JOIN part ON p_partkey = node AND p_partkey > 1)
        SELECT root, count(*) AS nodes, max(depth) AS height FROM c GROUP BY root""",
    "doc_relevance_max": "SELECT conv_id, round(coalesce(max(CASE WHEN contains(lower(text), 'thing') THEN length(text) / 1000.0::DOUBLE END), max(length(text) / 1000.0::DOUBLE) * 0.5::DOUBLE, 0), 6) AS relevance FROM conversations GROUP BY 1",
    "recommendation_bucket": """WITH b AS (SELECT least(n_chars / 4000.0::DOUBLE, 1) AS r, CASE WHEN quality = 1 THEN 0.75 ELSE 0.4 END AS q FROM documents JOIN labels USING (doc_id))
        SELECT CASE WHEN q >= 0.55 AND r >= 0.75 THEN 'primary' WHEN q >= 0.55 AND r >= 0.5 THEN 'supporting' ELSE 'background' END AS bucket, count(*) AS n FROM b GROUP BY 1""",
    "quality_mean": """WITH b AS (SELECT doc_id, quality::DOUBLE AS q, CASE WHEN toxic = 0 THEN 1.0::DOUBLE END AS t, CASE WHEN n_chars > 1000 THEN 0.6::DOUBLE END AS prior FROM documents LEFT JOIN labels USING (doc_id)),
        e AS (SELECT doc_id, prior, list_avg(list_filter([q, t], lambda x: x IS NOT NULL)) AS evidence FROM b)
        SELECT doc_id, round(evidence, 6) AS evidence_mean, round(CASE WHEN prior IS NULL THEN evidence WHEN evidence IS NULL THEN prior ELSE greatest(prior, evidence) END, 6) AS quality_final FROM e""",
    "pending_stats": r"""WITH s AS (SELECT doc_id, length(text)::BIGINT AS chars, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))::BIGINT AS a, EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id) AS done FROM documents)
        SELECT count(*) AS total, count(*) FILTER (NOT done) AS pending, CAST(sum(CASE WHEN done THEN 0 ELSE chars END) AS BIGINT) AS pending_chars, count(*) FILTER (NOT done AND (3 * a + 8 * (chars - a) + 11) // 12 > 8000) AS skipped,
               round((count(*) FILTER (done))::DOUBLE / count(*), 6) AS completion FROM s""",
    "greedy_batches": f"WITH RECURSIVE {BATCH_SQL} SELECT source, doc_id, batch FROM walk",
    "prefix_budget": f"""WITH RECURSIVE {BATCH_SQL}, e AS (SELECT source, batch, count(*) AS n, sum(chars) AS c FROM walk GROUP BY ALL),
        s AS (SELECT *, sum(c) OVER (PARTITION BY source ORDER BY batch) AS spent FROM e),
        o AS (SELECT *, bool_or(spent > 40000 OR batch >= 5) OVER (PARTITION BY source ORDER BY batch) AS over FROM s)
        SELECT source, CAST(sum(n) AS BIGINT) AS rows, count(*) AS calls, CAST(sum(c) AS BIGINT) AS chars FROM o WHERE NOT over GROUP BY source""",
    "fact_status_counts": " UNION ALL ".join(f"SELECT '{t}' AS relation, count(*) AS n FROM {t}" for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")),
    "stale_projects": """WITH l AS (SELECT o_custkey, max(o_orderdate) AS last_at FROM orders GROUP BY 1), b AS (SELECT c_custkey, c_mktsegment, last_at FROM customer JOIN l ON o_custkey = c_custkey),
        n AS (SELECT c_mktsegment, max(last_at) AS newest FROM b GROUP BY 1)
        SELECT c_custkey, date_diff('day', last_at::DATE, DATE '2000-01-01') AS age_days, date_diff('day', last_at::DATE, DATE '2000-01-01') > 730 AND newest > last_at AS stale FROM b JOIN n USING (c_mktsegment)""",
    "journal_search": "SELECT p_partkey, p_brand, p_type FROM part WHERE (p_name ILIKE '%brand%' OR p_brand ILIKE '%brand%' OR p_type ILIKE '%brand%') AND (p_name ILIKE '%e%' OR p_brand ILIKE '%e%' OR p_type ILIKE '%e%')",
    "goal_order": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderstatus = 'O' THEN o_orderkey % 7 END, 999), o_orderkey) AS place FROM orders",
    "phase_counts": "SELECT o_orderpriority AS phase, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done, count(*) AS total FROM orders GROUP BY 1",
    "upsert_latest_wins": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p = 1",
    "warning_union": """WITH w AS (SELECT source, unnest(list_filter([CASE WHEN toxic = 1 THEN 'source_toxic' END, CASE WHEN quality = 0 THEN 'source_low_quality' END, CASE WHEN quality IS NULL THEN 'source_unrated' END], lambda x: x IS NOT NULL)) AS w FROM documents LEFT JOIN labels USING (doc_id))
        SELECT source, array_to_string(list_sort(list_distinct(list(w))), ',') AS warnings FROM w GROUP BY source""",
    "blob_audit": """WITH r AS (SELECT page_id AS id FROM pages UNION SELECT doc_id + 100 FROM labels)
        SELECT CASE WHEN doc_id IS NULL THEN 'missing' WHEN id IS NULL THEN 'unreferenced' ELSE 'ok' END AS state, count(*) AS n FROM documents FULL JOIN r ON id = doc_id GROUP BY 1""",
}
