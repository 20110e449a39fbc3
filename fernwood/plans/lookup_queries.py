"""Look-ups by identifier, tree context, batches, manifests, identifiers' codecs and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwood.functions import vectors as V
from fernwood.operators import index, lookup, relations, search
from fernwood.plans.search_queries import SCORED_SQL, _scored
from fernwood.plans.text_queries import PLAIN_SQL, QUERY
from fernwood.sources.tables import table

FIELDS = ("orderstatus", "orderpriority")


def identifier_filter(spark: SparkSession, d: str) -> DataFrame:
    """Orders that own, themselves or through their customer, the identifier with one normal key."""
    names = table(spark, d, "customer").filter(F.lower(F.trim("c_name")) == "customer#000000007")
    return relations.holding(table(spark, d, "orders"), "o_orderkey", ["o_orderkey", "o_custkey"], names, "c_custkey")


def active_generation(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the last generation (turn) of each conversation."""
    return relations.of_last(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    """Filters that are off when their value is none: source is left open, language and length are given."""
    docs = table(spark, d, "documents")
    return lookup.optional(docs, {"source": None, "lang": "en"}).filter("n_chars > 500").select("doc_id", "source")


def key_whitelist(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose id is in a comma list, blanks and empty entries aside."""
    return table(spark, d, "documents").filter(lookup.listed(F.col("doc_id"), "1, 5,9,, 12 ,77,x")).select("doc_id", "lang")


def included_fields(spark: SparkSession, d: str) -> DataFrame:
    """Only the fields asked for, by name, beside the key."""
    return lookup.included(table(spark, d, "orders"), "o_orderkey", {"orderstatus": "o_orderstatus", "totalprice": "o_totalprice", "orderpriority": "o_orderpriority"}, FIELDS)


def reviews_by_target(spark: SparkSession, d: str) -> DataFrame:
    """Events (reviews) of users among the suppliers of one nation."""
    return relations.targeting(table(spark, d, "events"), "user_id", table(spark, d, "supplier").filter("s_nationkey = 3"), "s_suppkey").select("event_id", "user_id")


def source_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Line (version) to order (work) to customer (canonical work), with each order's latest returned line."""
    lines = table(spark, d, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))
    chain = relations.chained(lines.filter("l_suppkey = 3"), (table(spark, d, "orders"), "l_orderkey", "o_orderkey"), (table(spark, d, "customer"), "o_custkey", "c_custkey"))
    met = relations.with_latest(chain, "l_orderkey", lines.filter("l_returnflag = 'R'"), ["l_shipdate"], "l_linenumber", "latest_partial")
    return met.select("l_orderkey", F.col("l_linenumber").alias("line"), "o_custkey", "c_mktsegment", "latest_partial")


def current_or_linked(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose newest line was shipped in 1997 or later, or that a large event points at."""
    big = table(spark, d, "events").filter("value > 100")
    return relations.fresh_or_linked(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey", "l_shipdate", "1997-01-01", big, "user_id")


def recovered_batches(spark: SparkSession, d: str) -> DataFrame:
    """Orders (batches) all of whose parts are big enough: none of their ids is without a vector."""
    return relations.whole_groups(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey")))


def recoverable_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of ten documents of a source, some of which have no vector yet though their batch succeeded: only ids that are still there count."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    batches = docs.groupBy(F.floor(F.col("doc_id") / 10).alias("batch")).agg(F.collect_list("doc_id").alias("ids"))
    there = docs.filter("lang <> 'fr'")
    missing = relations.recoverable(batches, "batch", "ids", there, table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    return missing.select("batch", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


def batch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Orders (batches) by the state that their lines (requests) give them, those without one included."""
    told = relations.outcomes(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey", F.col("l_linestatus") == "F")
    return told.groupBy("state").agg(F.count("*").alias("n"))


def link_targets(spark: SparkSession, d: str) -> DataFrame:
    """Customers met by a key made of words and number."""
    key = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    orders = table(spark, d, "orders").select(key.alias("c_name"), "o_totalprice")
    return orders.join(table(spark, d, "customer"), "c_name").groupBy("c_name").agg(F.count("*").alias("n"))


def manifest_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every entry of the JSON manifests kept with events."""
    return relations.entries(table(spark, d, "events"), "event_id", "props")


def quality_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Current quality rows met with their document by key."""
    return table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").filter("quality = 1").groupBy("source", "lang").agg(F.countDistinct("doc_id").alias("n"))


def group_listing(spark: SparkSession, d: str) -> DataFrame:
    """Nations (groups) of a region (project) with their number of suppliers."""
    groups = table(spark, d, "nation").filter("n_regionkey = 2")
    return groups.join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_name").agg(F.count("*").alias("members"))


def tree_context(spark: SparkSession, d: str) -> DataFrame:
    """Parent, neighbours and siblings of hit chunks, without the hits themselves."""
    chunks = lookup.tree(table(spark, d, "conversations").select(F.col("conv_id").alias("parent"), F.col("turn").alias("ordinal")))
    hits = chunks.filter("ordinal % 3 = 0")
    return lookup.context(hits, chunks).select("parent", "ordinal", F.array_join("context", ",").alias("context"))


def tombstone_chain(spark: SparkSession, d: str) -> DataFrame:
    """From purged lines up to region: every link must exist."""
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45")
    chain = relations.chained(lines, (table(spark, d, "orders"), "l_orderkey", "o_orderkey"), (table(spark, d, "customer"), "o_custkey", "c_custkey"), (table(spark, d, "nation"), "c_nationkey", "n_nationkey"))
    return chain.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("works"))


def goal_detail(spark: SparkSession, d: str) -> DataFrame:
    """What hangs on a customer (goal): orders, lines and events, each kind with its number and newest date."""
    orders = table(spark, d, "orders")
    lines = relations.chained(orders, (table(spark, d, "lineitem"), "o_orderkey", "l_orderkey"))
    goals = table(spark, d, "customer").filter("c_custkey < 20").select(F.col("c_custkey").alias("goal"))
    return relations.hanging(goals, "goal", {"order": (orders, "o_custkey", "o_orderdate"), "line": (lines, "o_custkey", "l_shipdate"), "event": (table(spark, d, "events"), "user_id", "ts")})


def recent_items(spark: SparkSession, d: str) -> DataFrame:
    """The five newest orders of each customer, newest first, ties to the larger key."""
    return relations.newest(table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_custkey", "place", "o_orderkey")


def phase_warning(spark: SparkSession, d: str) -> DataFrame:
    """Orders in an earlier phase than their customer's furthest one."""
    return relations.behind(table(spark, d, "orders"), "o_custkey", F.array_position(F.array(*map(F.lit, ("O", "P", "F"))), F.col("o_orderstatus")))


def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return index.fingerprint(table(spark, d, "embeddings"), "vec_id")


def search_status(spark: SparkSession, d: str) -> DataFrame:
    """Status and counters of a search whose candidate budget is 200."""
    hit = table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("thing")))
    open_jobs = table(spark, d, "orders").filter("o_orderstatus = 'O'").agg(F.count("*").alias("unfinished"))
    return lookup.status(hit.agg(F.count("*").alias("matched")).join(open_jobs), budget=200)


def heading_counts(spark: SparkSession, d: str) -> DataFrame:
    level = F.explode(F.regexp_extract_all("html", F.lit("(?i)<h([1-6])[ >]"), F.lit(1)))
    return table(spark, d, "pages").select(level.alias("level")).groupBy("level").agg(F.count("*").alias("n"))


def best_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Up to three longest turns with the word of each conversation, as a list."""
    hits = table(spark, d, "conversations").filter(F.contains(F.lower("text"), F.lit("the"))).select("conv_id", "turn", F.length("text").alias("score"))
    best = relations.listed(hits, "conv_id", [F.desc("score"), "turn"], 3, "turn")
    return best.select("conv_id", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("turns"))


def part_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Rows under one path get a running suffix from the second on."""
    return relations.suffixed(table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[^?#]*", 0).alias("path")), "path", "page_id").select("page_id", "part")


def self_search(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of one's own documents (English and German), raised where several lie under one path, with snippets and their neighbours in the tree."""
    pieces = table(spark, d, "documents").filter("lang in ('en', 'de')").select("doc_id", F.concat(F.lit("/"), "lang", F.lit("/"), "source").alias("path"), F.lit(2).alias("level"), F.concat("lang", F.lit(":"), "source").alias("parent_id"), "text")
    near = _scored(spark, d).select(F.col("vec_id").alias("doc_id"), (F.lit(1.0) - F.col("score")).alias("distance"), F.col("score").alias("similarity"))
    found = search.self_search(pieces.withColumnRenamed("doc_id", "chunk_id"), near.withColumnRenamed("doc_id", "chunk_id"), ["the", "keiten"], level=2, top_k=10)
    return found.select(F.col("chunk_id").alias("vec_id"), "path", "similarity", "boost", "score", F.size("context").cast("bigint").alias("neighbours"))


def first_match(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each text, by key."""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def chunk_id_codec(spark: SparkSession, d: str) -> DataFrame:
    """Chunk ids of the second form, with what reading them back gives."""
    docs = table(spark, d, "documents")
    made = lookup.chunk_id(F.col("doc_id") * 7919, F.sha2("text", 256), F.lit("lines"), F.lit("2"), F.lit(3), F.concat("lang", F.lit("/a:b"), F.col("doc_id").cast("string")), F.lit("p1"))
    back = lookup.parsed_chunk_id(F.col("chunk_id"))
    return docs.select("doc_id", made.alias("chunk_id")).select("doc_id", "chunk_id", back["generation"].alias("generation"), back["path"].alias("path"), back["part"].alias("part"), back["valid"].alias("valid"))


def ascii_query_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of letters, digits and hyphens."""
    words = F.filter(F.split("text", "[^a-zA-Z0-9\\-]+"), lambda w: w != "")
    return table(spark, d, "documents").select("doc_id", F.size(words).cast("bigint").alias("n"), F.array_join(F.slice(words, 1, 5), " ").alias("head"))


def similar_by_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Rows near the vector of a chosen row, itself excepted, and whether there was a vector at all."""
    return lookup.similar(table(spark, d, "embeddings"), 3, 20)


def resolver_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", lookup.resolver_url(F.concat("source", F.lit("/"), F.col("lang"), F.lit(":"), F.col("doc_id").cast("string"))).alias("link"))


def table_dump(spark: SparkSession, d: str) -> DataFrame:
    return lookup.dump(table(spark, d, "part"), "p_partkey", 50).select("p_partkey", "p_brand")


def value_codecs(spark: SparkSession, d: str) -> DataFrame:
    head = F.substring("text", 1, 12)
    return table(spark, d, "documents").select("doc_id", F.base64(F.encode(head, "utf-8")).alias("b64"), F.lower(F.hex(F.encode(head, "utf-8"))).alias("hex"))


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in embedding in four dimensions, from hashes of text and dimension."""
    return table(spark, d, "documents").select("doc_id", *(F.round(V.hashed(F.col("text"), i), 6).alias(f"x{i}") for i in range(4)))


def batch_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Batches of ten chunks by id: their id is a hash of their members, their state follows from what has vectors."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars"))
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has")).distinct()
    return lookup.ledger(docs.join(have, "doc_id", "left"), "doc_id", 10)


def node_violations(spark: SparkSession, d: str) -> DataFrame:
    """How often rows break each rule for documents."""
    rules = {"empty_text": F.trim(F.coalesce("text", F.lit(""))) == "", "bad_language": ~F.col("lang").isin("en", "de", "fr"), "bad_length": F.col("n_chars") != F.length("text"), "long": F.col("n_chars") > 10_000}
    return lookup.violations(table(spark, d, "documents"), rules)


def indexed_bm25(spark: SparkSession, d: str) -> DataFrame:
    """All documents with a word of the query by the kept index, substrings counted too; the best 20."""
    found = index.matches(index.kept(table(spark, d, "documents").select("doc_id", "text")), QUERY)
    return found.orderBy(F.desc("score"), "id").limit(20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def indexed_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the indexed search with its text, which only the page's rows are joined with."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    page = index.topk(index.kept(docs), QUERY, 5).rows
    return docs.join(F.broadcast(page.withColumnRenamed("id", "doc_id")), "doc_id").select("doc_id", F.round("score", 6).alias("score"), F.length("text").cast("bigint").alias("chars"), F.substring("text", 1, 30).alias("head"))


def known_sources(spark: SparkSession, d: str) -> DataFrame:
    """For every document the first one outside French that agrees in all seven parts of a source's key, missing ones with missing ones."""
    key = {"hash": F.sha2("text", 256), "version_kind": F.col("lang"), "coverage": F.when(F.col("n_chars") > 500, "full"), "media_type": F.lit("text/plain"), "origin": F.col("source"), "url": F.lit(None).cast("string"), "relation": F.when(F.col("n_chars") > 2000, "long")}
    keyed = table(spark, d, "documents").select("doc_id", *(c.alias(k) for k, c in key.items()))
    return relations.known(keyed, keyed.filter("version_kind <> 'fr'").withColumnRenamed("doc_id", "first_id"), list(key), "first_id").select("doc_id", "first_id")


def research_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Turns (revisions) of conversations (records) with a word, those that are current first; a record's project is its first role."""
    turns = table(spark, d, "conversations")
    revisions = turns.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), F.col("conv_id").alias("record_id"), F.col("text").alias("body"), F.col("turn").alias("created_at"))
    current = turns.groupBy(F.col("conv_id").alias("record_id")).agg((F.col("record_id") * 100_000 + F.max("turn")).alias("revision_id"), F.min(F.struct("turn", "role"))["role"].alias("project")).withColumn("kind", F.lit("talk"))
    return relations.research(revisions, current, "ING", context="user").select("record_id", "id", "is_current", "ref")


QUERIES = {
    f.__name__: f
    for f in (
        identifier_filter, active_generation, optional_filters, key_whitelist, included_fields, reviews_by_target, source_evidence, current_or_linked, recovered_batches, recoverable_batches, batch_outcomes, link_targets, manifest_entries,
        quality_evidence, group_listing, tree_context, tombstone_chain, goal_detail, recent_items, phase_warning, table_fingerprint, search_status, heading_counts, best_chunks, part_suffix, self_search, first_match,
        chunk_id_codec, ascii_query_tokens, similar_by_chunk, resolver_links, table_dump, value_codecs, hash_embedding, batch_ledger, node_violations, known_sources, research_lookup, indexed_bm25, indexed_page,
    )
}
BM25_SQL = f"""WITH words AS (SELECT doc_id, text, regexp_extract_all({PLAIN_SQL}, '[\\p{{L}}\\p{{N}}_]+') AS words FROM documents),
    stats AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM words), terms AS (SELECT unnest(['the', 'thing', 'of', 'and']) AS term),
    dfs AS (SELECT t.term, sum(CASE WHEN list_contains(w.words, t.term) THEN 1 ELSE 0 END) AS df FROM terms t, words w GROUP BY t.term),
    scored AS (SELECT w.doc_id, w.text, sum(greatest(ln((s.n - f.df + 0.5) / (f.df + 0.5)), 1e-6) * (len(list_filter(w.words, lambda x: x = f.term)) * 2.2)
        / (len(list_filter(w.words, lambda x: x = f.term)) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w.words) / s.avgdl))) AS score FROM words w, dfs f, stats s GROUP BY ALL HAVING score > 0)"""
SQL = {
    "identifier_filter": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE lower(trim(c_name)) = 'customer#000000007' AND c_custkey IN (o_orderkey, o_custkey))",
    "active_generation": "SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) IN (SELECT conv_id, max(turn) FROM conversations GROUP BY 1)",
    "optional_filters": "SELECT doc_id, source FROM documents WHERE lang = 'en' AND n_chars > 500",
    "key_whitelist": "SELECT doc_id, lang FROM documents WHERE doc_id IN (1, 5, 9, 12, 77)",
    "included_fields": "SELECT o_orderkey, o_orderstatus AS orderstatus, o_orderpriority AS orderpriority FROM orders",
    "reviews_by_target": "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)",
    "source_evidence": """WITH p AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS i FROM lineitem WHERE l_returnflag = 'R')
        SELECT l.l_orderkey, l.l_linenumber::BIGINT AS line, o_custkey, c_mktsegment, p.l_linenumber::BIGINT AS latest_partial
        FROM lineitem l JOIN orders ON o_orderkey = l.l_orderkey JOIN customer ON c_custkey = o_custkey LEFT JOIN p ON p.l_orderkey = l.l_orderkey AND p.i = 1 WHERE l.l_suppkey = 3""",
    "current_or_linked": """SELECT o_orderkey FROM orders WHERE (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) >= TIMESTAMP '1997-01-01'
        OR EXISTS (SELECT 1 FROM events WHERE user_id = o_orderkey AND value > 100)""",
    "recovered_batches": "SELECT l_orderkey, count(*) AS ids FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING bool_and(coalesce(p_size > 10, false))",
    "batch_outcomes": """WITH b AS (SELECT o_orderkey, count(l_orderkey) AS r, count(*) FILTER (l_linestatus = 'F') AS d FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
        SELECT CASE WHEN r = 0 THEN 'not_sent' WHEN d = r THEN 'succeeded' WHEN d = 0 THEN 'started' ELSE 'ambiguous' END AS state, count(*) AS n FROM b GROUP BY 1""",
    "link_targets": "SELECT c_name, count(*) AS n FROM orders JOIN customer ON c_name = 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') GROUP BY 1",
    "manifest_entries": "WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS name FROM events) SELECT event_id, name, json_extract_string(props, '$.' || name) AS value FROM k",
    "quality_evidence": "SELECT source, lang, count(DISTINCT doc_id) AS n FROM labels JOIN documents USING (doc_id) WHERE quality = 1 GROUP BY 1, 2",
    "group_listing": "SELECT n_name, count(*) AS members FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY 1",
    "tree_context": """WITH h AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 3 = 0),
        c AS (SELECT h.conv_id, h.turn, x.turn AS other FROM h JOIN (SELECT DISTINCT conv_id, turn FROM conversations) x ON x.conv_id = h.conv_id AND x.turn BETWEEN h.turn - 1 AND h.turn + 1 AND x.turn % 3 <> 0)
        SELECT h.conv_id AS parent, h.turn AS ordinal, coalesce((SELECT string_agg(other::VARCHAR, ',' ORDER BY other) FROM c WHERE c.conv_id = h.conv_id AND c.turn = h.turn), '') AS context FROM h""",
    "tombstone_chain": """SELECT n_regionkey, count(*) AS n, count(DISTINCT o_orderkey) AS works FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1""",
    "goal_detail": """WITH p AS (SELECT o_custkey AS goal, 'order' AS kind, o_orderdate AS moment FROM orders UNION ALL SELECT o_custkey, 'line', l_shipdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT user_id, 'event', ts FROM events)
        SELECT goal, kind, count(*) AS n, max(moment)::DATE AS newest FROM p WHERE goal IN (SELECT c_custkey FROM customer WHERE c_custkey < 20) GROUP BY 1, 2""",
    "recent_items": "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, o_orderkey FROM orders QUALIFY place <= 5",
    "phase_warning": """WITH p AS (SELECT o_custkey, list_position(['O', 'P', 'F'], o_orderstatus) AS phase, max(list_position(['O', 'P', 'F'], o_orderstatus)) OVER (PARTITION BY o_custkey) AS furthest FROM orders)
        SELECT o_custkey, count(*) AS earlier FROM p WHERE phase < furthest GROUP BY 1""",
    "table_fingerprint": "SELECT count(*) AS n, max(vec_id) AS last, sha256(count(*)::VARCHAR || ':' || coalesce(max(vec_id), -1)::VARCHAR) AS digest FROM embeddings",
    "search_status": """WITH c AS (SELECT (SELECT count(*) FROM documents WHERE contains(lower(text), 'thing')) AS matched, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS unfinished)
        SELECT matched, unfinished, CASE WHEN matched > 200 THEN 'candidate_budget_exhausted' WHEN matched > 0 THEN 'matching_results' WHEN unfinished > 0 THEN 'processing_incomplete' ELSE 'no_matching_results' END AS status FROM c""",
    "heading_counts": "SELECT level, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '(?i)<h([1-6])[ >]', 1)) AS level FROM pages) GROUP BY 1",
    "best_chunks": """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS place FROM conversations WHERE contains(lower(text), 'the'))
        SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY place) AS turns FROM t WHERE place <= 3 GROUP BY 1""",
    "part_suffix": """WITH p AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS path FROM pages), q AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page_id) AS i FROM p)
        SELECT page_id, path || CASE WHEN i > 1 THEN '-' || i ELSE '' END AS part FROM q""",
    "self_search": f"""WITH {SCORED_SQL}, own AS (SELECT doc_id, '/' || lang || '/' || source AS path, lang || ':' || source AS parent FROM documents WHERE lang IN ('en', 'de')),
        near AS (SELECT vec_id, score FROM scored ORDER BY 1 - scored.score, vec_id LIMIT greatest(4 * (SELECT count(*) FROM own), 200)),
        c AS (SELECT vec_id, path, parent, round(score, 4) AS similarity, round(0.05::DOUBLE * (count(*) OVER (PARTITION BY path) - 1), 4) AS boost FROM near JOIN own ON doc_id = vec_id),
        top AS (SELECT *, round(similarity + boost, 4) AS score FROM c ORDER BY round(similarity + boost, 4) DESC, vec_id LIMIT 10)
        SELECT vec_id, path, similarity, boost, score, (SELECT count(*) FROM own o WHERE o.parent = t.parent AND o.doc_id NOT IN (SELECT vec_id FROM top)) AS neighbours FROM top t""",
    "recoverable_batches": "SELECT doc_id // 10 AS batch, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS missing FROM documents WHERE lang <> 'fr' AND doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY 1",
    "first_match": "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "chunk_id_codec": """WITH c AS (SELECT doc_id, lang || '/a:b' || doc_id AS path, doc_id * 7919 AS g, text FROM documents)
        SELECT doc_id, 'c2.' || lpad(lower(to_base(g, 36)), 8, '0') || '.' || left(sha256(text), 12) || '.' || left(sha256('lines2'), 8) || '.3:' || length(path) || ':' || path || ':p1' AS chunk_id, g AS generation, path, 'p1' AS part, true AS valid FROM c""",
    "ascii_query_tokens": """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^a-zA-Z0-9\\-]+'), lambda x: x <> '') AS w FROM documents)
        SELECT doc_id, len(w) AS n, array_to_string(w[1:5], ' ') AS head FROM w""",
    "similar_by_chunk": """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)) AS score FROM embeddings WHERE vec_id <> 3)
        SELECT vec_id, round(score, 6) AS score, false AS degraded FROM s ORDER BY s.score DESC, vec_id LIMIT 20""",
    "resolver_links": "SELECT doc_id, 'https://doi.org/' || replace(url_encode(source || '/' || lang || ':' || doc_id), '%2F', '/') AS link FROM documents",
    "table_dump": "SELECT p_partkey, p_brand FROM part ORDER BY p_partkey LIMIT 50",
    "value_codecs": "SELECT doc_id, base64(encode(substring(text, 1, 12))) AS b64, lower(hex(encode(substring(text, 1, 12)))) AS hex FROM documents",
    "hash_embedding": "SELECT doc_id, " + ", ".join(f"round(('0x' || left(sha256(text || ':{i}'), 8))::BIGINT / 2147483648.0::DOUBLE - 1, 6) AS x{i}" for i in range(4)) + " FROM documents",
    "batch_ledger": """WITH n AS (SELECT doc_id, length(text)::BIGINT AS chars, EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id) AS has FROM documents)
        SELECT sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS batch_id, count(*) AS members, sum(chars)::BIGINT AS chars,
               CASE WHEN count(*) FILTER (has) = count(*) THEN 'succeeded' WHEN count(*) FILTER (has) = 0 THEN 'not_sent' ELSE 'ambiguous' END AS state FROM n GROUP BY doc_id // 10""",
    "node_violations": """SELECT 'empty_text' AS rule, count(*) AS n FROM documents WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT 'bad_language', count(*) FROM documents WHERE lang NOT IN ('en', 'de', 'fr')
        UNION ALL SELECT 'bad_length', count(*) FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'long', count(*) FROM documents WHERE n_chars > 10000""",
    "indexed_bm25": BM25_SQL.replace("sum(greatest(", "sum(CAST(contains(lower(w.text), f.term) AS INT) + greatest(") + " SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 20",
    "indexed_page": f"{BM25_SQL}, page AS (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 5) SELECT doc_id, round(score, 6) AS score, length(text)::BIGINT AS chars, substring(text, 1, 30) AS head FROM page",
    "known_sources": """WITH k AS (SELECT doc_id, sha256(text) AS hash, lang, CASE WHEN n_chars > 500 THEN 'full' END AS coverage, source, CASE WHEN n_chars > 2000 THEN 'long' END AS relation FROM documents)
        SELECT a.doc_id, min(b.doc_id) AS first_id FROM k a LEFT JOIN k b ON a.hash = b.hash AND a.lang = b.lang AND a.coverage IS NOT DISTINCT FROM b.coverage AND a.source = b.source AND a.relation IS NOT DISTINCT FROM b.relation AND b.lang <> 'fr' GROUP BY a.doc_id""",
    "research_lookup": """WITH c AS (SELECT conv_id, max(turn) AS last, arg_min(role, turn) AS project FROM conversations GROUP BY conv_id)
        SELECT conv_id AS record_id, conv_id * 100000 + turn AS id, turn = last AS is_current, 'ref/' || conv_id || '/revision/' || (conv_id * 100000 + turn) AS ref
        FROM conversations JOIN c USING (conv_id) WHERE contains(lower(text), 'ing') AND project = 'user' ORDER BY (turn = last) DESC, turn DESC, 2 LIMIT 20""",
}
