"""Evidence queries: overviews, related reports, enrichment, re-ranking, acquisition checks, purges and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernwood.functions import vectors as V
from fernwood.operators import evidence
from fernwood.plans.search_queries import SCORED_SQL, _query_vector
from fernwood.sources.tables import table

PAGE = 20


def _scored(spark: SparkSession, d: str) -> DataFrame:
    query = V.literal(_query_vector(spark, d))
    return table(spark, d, "embeddings").select("vec_id", "label", V.cosine(F.col("embedding"), query).alias("score"))


def overview_records(spark: SparkSession, d: str) -> DataFrame:
    """The newest 20 orders of each nation and status, and whether there are more."""
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    records = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus").join(people, "o_custkey")
    page = evidence.newest_page(records, ["c_nationkey", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")], PAGE)
    return page.select("c_nationkey", "o_orderstatus", "place", "o_orderkey", "truncated")


def related_reports(spark: SparkSession, d: str) -> DataFrame:
    """Orders that cite small parts of one kind, each once, with how many of them."""
    wanted = table(spark, d, "part").filter("p_size <= 5 and p_type = 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"))
    cites = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(wanted, "l_partkey", "left_semi").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("n_cited"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return cites.join(orders, "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"), "o_orderstatus", "n_cited")


def hit_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """The page of the longest documents with the status and warnings of their sources: joined after the page is cut."""
    page = table(spark, d, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(PAGE)
    return evidence.enriched(page, table(spark, d, "labels")).select("doc_id", "source", "status", "warnings")


def rerank_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The nearest 50 vectors; the first 20 in the order of another score, the rest as they were."""
    near = _scored(spark, d).orderBy(F.desc("score"), "vec_id").limit(50)
    base = near.select("vec_id", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).alias("base"))
    other = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("n_chars").cast("double").alias("new_score"))
    return evidence.reranked(base.join(other, "vec_id", "left"), 20).select("position", "vec_id")


def path_boost(spark: SparkSession, d: str) -> DataFrame:
    """The nearest 200 vectors, raised by 0.05 for every other hit under the same label."""
    near = _scored(spark, d).orderBy(F.desc("score"), "vec_id").limit(200)
    fellows = F.count("*").over(Window.partitionBy("label"))
    raised = near.withColumn("boosted", F.col("score") + 0.05 * (fellows - 1))
    return raised.orderBy(F.desc("boosted"), "vec_id").limit(PAGE).select("vec_id", F.round("boosted", 6).alias("boosted"))


def acquisition_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page is evidence or a login, challenge or empty answer."""
    return table(spark, d, "pages").select("page_id", evidence.acquired(F.col("html")).alias("verdict"))


def profile_identity(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by the identity of their configuration; only equal identities may be compared."""
    config = F.concat(F.lit('{"dim":'), F.size("embedding").cast("string"), F.lit(',"metric":"cosine","model":"label-'), F.col("label").cast("string"), F.lit('"}'))
    return table(spark, d, "embeddings").groupBy(F.sha2(config, 256).alias("profile")).agg(F.count("*").alias("n"), F.max("vec_id").alias("last"))


def page_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Segments of 200 characters of a whole conversation and the turn that each begins in."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size"))
    return evidence.attributed(turns, group="conv_id", order="turn", step=200).select("conv_id", "turn", "segment", "at")


def goal_closure(spark: SparkSession, d: str) -> DataFrame:
    """Open items of each customer by kind; one without any may be closed."""
    orders = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("owner"), F.lit("task").alias("kind"))
    errors = table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("owner"), F.lit("issue").alias("kind"))
    items = orders.unionByName(errors).groupBy("owner").agg(F.count_if(F.col("kind") == "task").alias("tasks"), F.count_if(F.col("kind") == "issue").alias("issues"))
    both = table(spark, d, "customer").select("c_custkey").join(items, F.col("c_custkey") == F.col("owner"), "left")
    tasks, issues = F.coalesce("tasks", F.lit(0)).cast("bigint"), F.coalesce("issues", F.lit(0)).cast("bigint")
    return both.select("c_custkey", tasks.alias("tasks"), issues.alias("issues"), (tasks + issues == 0).alias("may_close"))


def import_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Old keys of vectors and labels with their new addresses; those without a document are issues."""
    old = table(spark, d, "embeddings").select((F.col("vec_id") * 2).alias("key"), F.lit("vector").alias("kind")).unionByName(table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.lit("label").alias("kind")))
    have = table(spark, d, "documents").select("doc_id")
    mapped = old.join(have, F.col("key") == F.col("doc_id"), "left")
    return mapped.select("kind", "key", F.concat(F.lit("version/"), F.col("doc_id").cast("string")).alias("address"), F.when(F.col("doc_id").isNull(), "unresolved").alias("issue"))


def purge_blockers(spark: SparkSession, d: str) -> DataFrame:
    """Events whose properties name a supplier of one nation: all numbers in the JSON meet the ids in one equality join."""
    owned = table(spark, d, "supplier").filter("s_nationkey <= 3").select("s_suppkey")
    return evidence.mentions(table(spark, d, "events"), "event_id", "props", owned, "s_suppkey").groupBy("s_suppkey").agg(F.count("*").alias("n_blockers"))


def purge_redact(spark: SparkSession, d: str) -> DataFrame:
    """Documents after toxic ones lost their text; a tombstone keeps its hash."""
    gone = table(spark, d, "labels").filter("toxic = 1").select("doc_id").distinct()
    return evidence.redacted(table(spark, d, "documents").select("doc_id", "text"), gone).select("doc_id", "purged", F.length("text").cast("bigint").alias("kept_chars"), "tombstone")


def jsonl_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of the JSON frame that each turn makes, and whether a frame may hold it."""
    t = table(spark, d, "conversations")
    size = F.octet_length(F.to_json(F.struct(F.col("role").alias("command"), F.col("conv_id").alias("request_id"))))
    return t.groupBy("role").agg(F.count("*").alias("n"), F.max(size).cast("bigint").alias("largest"), F.count_if(size > 64).alias("oversize"))


def key_word_score(spark: SparkSession, d: str) -> DataFrame:
    """0.5 for words in the head line, and a third of 0.5 for any word in the text: values 0, 1/6 and 2/3."""
    wanted = ["thing", "oution", "erly"]
    low = F.lower("text")

    def any_of(c: Column) -> Column:
        hit = F.contains(c, F.lit(wanted[0]))
        for w in wanted[1:]:
            hit = hit | F.contains(c, F.lit(w))
        return hit

    head = F.substring_index(low, "\n", 1)
    score = F.when(any_of(low), 0.5 * any_of(head).cast("double") + 0.5 / 3).otherwise(0.0)
    return table(spark, d, "documents").select("doc_id", F.round(score, 6).alias("score")).filter("score > 0")


QUERIES = {f.__name__: f for f in (overview_records, related_reports, hit_enrichment, rerank_prefix, path_boost, acquisition_verdict, profile_identity, page_attribution, goal_closure, import_mapping, purge_blockers, purge_redact, jsonl_sizes, key_word_score)}
SQL = {
    "overview_records": """WITH r AS (SELECT c_nationkey, o_orderstatus, o_orderkey, row_number() OVER w AS place, count(*) OVER (PARTITION BY c_nationkey, o_orderstatus) > 20 AS truncated
        FROM orders JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY c_nationkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC)) SELECT c_nationkey, o_orderstatus, place, o_orderkey, truncated FROM r WHERE place <= 20""",
    "related_reports": "SELECT o_orderkey, o_orderstatus, count(DISTINCT l_partkey) AS n_cited FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_size <= 5 AND p_type = 'ECONOMY' GROUP BY ALL",
    "hit_enrichment": """WITH p AS (SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20),
        l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id)
        SELECT doc_id, source, CASE WHEN toxic IS NULL THEN 'unknown' WHEN toxic = 1 THEN 'retracted' ELSE 'current' END AS status,
               array_to_string(list_filter([CASE WHEN quality IS NULL THEN 'index_incomplete' END, CASE WHEN quality = 0 THEN 'source_low_quality' END, CASE WHEN toxic = 1 THEN 'source_retracted' END], lambda x: x IS NOT NULL), ',') AS warnings
        FROM p LEFT JOIN l USING (doc_id)""",
    "rerank_prefix": f"""WITH {SCORED_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS base FROM scored),
        b AS (SELECT n.vec_id, base, base <= 20 AS head, n_chars FROM n LEFT JOIN documents ON doc_id = n.vec_id WHERE base <= 50)
        SELECT row_number() OVER (ORDER BY head DESC, CASE WHEN head THEN n_chars END DESC NULLS LAST, CASE WHEN head THEN vec_id END, base) AS position, vec_id FROM b""",
    "path_boost": f"""WITH {SCORED_SQL}, n AS (SELECT * FROM scored ORDER BY score DESC, vec_id LIMIT 200), b AS (SELECT vec_id, score + 0.05::DOUBLE * (count(*) OVER (PARTITION BY label) - 1) AS boosted FROM n)
        SELECT vec_id, round(boosted, 6) AS boosted FROM b ORDER BY b.boosted DESC, vec_id LIMIT 20""",
    "acquisition_verdict": """WITH h AS (SELECT page_id, lower(left(coalesce(html, ''), 200000)) AS head FROM pages)
        SELECT page_id, CASE WHEN head = '' THEN 'empty' WHEN contains(head, 'type="password"') OR contains(head, 'type=''password''') OR contains(head, 'sign in to access') OR contains(head, 'log in to access') OR contains(head, 'access denied') OR contains(head, 'captcha') THEN 'access_required' ELSE 'evidence' END AS verdict FROM h""",
    "profile_identity": """SELECT sha256('{"dim":' || len(embedding) || ',"metric":"cosine","model":"label-' || label || '"}') AS profile, count(*) AS n, max(vec_id) AS last FROM embeddings GROUP BY 1""",
    "page_attribution": """WITH t AS (SELECT conv_id, turn, coalesce(length(text), 0) AS size, sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations),
        s AS (SELECT conv_id, unnest(range(0, CAST(max(upto) AS BIGINT), 200)) AS at FROM t GROUP BY conv_id)
        SELECT s.conv_id, t.turn, s.at // 200 AS segment, s.at FROM s JOIN t ON t.conv_id = s.conv_id AND s.at >= t.upto - t.size AND s.at < t.upto""",
    "goal_closure": """WITH o AS (SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), e AS (SELECT user_id AS c, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
        SELECT c_custkey, coalesce(o.n, 0) AS tasks, coalesce(e.n, 0) AS issues, coalesce(o.n, 0) + coalesce(e.n, 0) = 0 AS may_close FROM customer LEFT JOIN o ON o.c = c_custkey LEFT JOIN e ON e.c = c_custkey""",
    "import_mapping": """WITH old AS (SELECT vec_id * 2 AS key, 'vector' AS kind FROM embeddings UNION ALL SELECT doc_id, 'label' FROM labels)
        SELECT kind, key, 'version/' || doc_id AS address, CASE WHEN doc_id IS NULL THEN 'unresolved' END AS issue FROM old LEFT JOIN documents ON doc_id = key""",
    "purge_blockers": """WITH m AS (SELECT DISTINCT event_id, unnest(regexp_extract_all(props, '[0-9]+'))::BIGINT AS id FROM events)
        SELECT s_suppkey, count(*) AS n_blockers FROM m JOIN supplier ON id = s_suppkey WHERE s_nationkey <= 3 GROUP BY 1""",
    "purge_redact": """SELECT doc_id, g.id IS NOT NULL AS purged, CASE WHEN g.id IS NULL THEN length(text) ELSE 0 END AS kept_chars, CASE WHEN g.id IS NOT NULL THEN sha256(text) END AS tombstone
        FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS id FROM labels WHERE toxic = 1) g ON id = doc_id""",
    "jsonl_sizes": """WITH s AS (SELECT role, strlen('{"command":"' || role || '","request_id":' || conv_id || '}') AS n FROM conversations)
        SELECT role, count(*) AS n, max(n) AS largest, count(*) FILTER (n > 64) AS oversize FROM s GROUP BY role""",
    "key_word_score": """WITH k AS (SELECT doc_id, lower(text) AS low, split_part(lower(text), chr(10), 1) AS head FROM documents)
        SELECT doc_id, round(CASE WHEN len(list_filter(['thing', 'oution', 'erly'], lambda w: contains(head, w))) > 0 THEN 0.5 ELSE 0 END + 0.5::DOUBLE / 3, 6) AS score FROM k WHERE len(list_filter(['thing', 'oution', 'erly'], lambda w: contains(low, w))) > 0""",
}
