"""Vector, fusion and hybrid search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernwood.functions import text as T
from fernwood.functions import vectors as V
from fernwood.operators import artefact, literature, search
from fernwood.plans.text_queries import CHUNKS_SQL, KEYWORDS, PLAIN_SQL, QUERY, SPLIT_SQL, normal_sql
from fernwood.sources import scratch, snapshots
from fernwood.sources.tables import table

DIM, BUDGET, TOP = 64, 10_000, 10
SMALL = 200  # the budget of the query that shows what a budget cuts


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", V.cosine(F.col("embedding"), V.literal(_query_vector(spark, d))).alias("score"))


def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).orderBy(F.desc("score"), "vec_id").limit(50).select("vec_id", F.round("score", 6).alias("score"))


def vector_topk_l2(spark: SparkSession, d: str) -> DataFrame:
    far = V.distance(F.col("embedding"), V.literal(_query_vector(spark, d)))
    best = table(spark, d, "embeddings").select("vec_id", far.alias("d")).orderBy("d", "vec_id").limit(50)
    return best.select("vec_id", F.round("d", 6).alias("distance"), F.round(V.similarity_exp(F.col("d"), DIM), 6).alias("by_exp"), F.round(1 / (1 + F.col("d")), 6).alias("by_inverse"), F.round(1 - F.least("d", F.lit(2.0)) / 2, 6).alias("by_share"))


def vector_validity(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", V.valid(v, DIM).alias("valid"), F.round(F.sqrt(V.dot(v, v)), 5).alias("norm"))


def knn_per_label_top5(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    return _scored(spark, d).withColumn("place", F.row_number().over(order)).filter("place <= 5").select("label", F.col("place").cast("bigint").alias("place"), "vec_id")


def post_filter_knn(spark: SparkSession, d: str) -> DataFrame:
    """The nearest 100 first, then those in English: fewer rows may remain."""
    near = _scored(spark, d).orderBy(F.desc("score"), "vec_id").limit(100)
    docs = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("vec_id"), "source")
    return near.join(docs, "vec_id").select("vec_id", "source")


def pre_filter_knn(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("vec_id"), "source")
    return _scored(spark, d).join(docs, "vec_id").orderBy(F.desc("score"), "vec_id").limit(100).select("vec_id", "source")


def similar_level(spark: SparkSession, d: str) -> DataFrame:
    """0.6 vector + 0.4 wording of headings, among vectors of the query's label."""
    lead = T.normal_tokens(F.slice(F.split("text", "[ \\n\\t]+", 7), 1, 6))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), T.jaccard(lead, T.normal_tokens(F.array(*map(F.lit, KEYWORDS)))).alias("j"))
    label = table(spark, d, "embeddings").filter("vec_id = 0").select("label")
    mixed = _scored(spark, d).join(label, "label", "left_semi").join(docs, "vec_id").select("vec_id", (0.6 * F.col("score") + 0.4 * F.col("j")).alias("mix"))
    return mixed.orderBy(F.desc("mix"), "vec_id").limit(20).select("vec_id", F.round("mix", 6).alias("mix"))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """All documents are eligible versions; English counts as formal, good quality as preferred."""
    good = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("version_id")).distinct().withColumn("preferred", F.lit(True))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), (F.col("lang") == "en").alias("formal"))
    return docs.join(good, "version_id", "left").withColumn("preferred", F.coalesce("preferred", F.lit(False)))


def _copy(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The embeddings, and the folder of their packed copy, which is built if it is not there or not theirs."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    folder = f"{scratch.base(spark)}/vectors-{snapshots.home(vectors)}"
    artefact.build(vectors, folder, DIM)
    return vectors, folder


def packed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Scores from the packed copy, the nearest 50."""
    vectors, folder = _copy(spark, d)
    found, status = artefact.scores(vectors, folder, _query_vector(spark, d))
    return found.orderBy(F.desc("score"), "key").limit(50).select(F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), F.lit(status).alias("status"))


def _lists(spark: SparkSession, d: str, budget: int = BUDGET) -> search.Lists:
    """A document's vector stands for its first chunk."""
    vectors, folder = _copy(spark, d)
    near, status = artefact.scores(vectors, folder, _query_vector(spark, d))
    first = near.select(F.concat_ws(":", F.col("key").cast("string"), F.lit("0")).alias("chunk_id"), "score")
    kept = search.chunk_index(table(spark, d, "documents").select("doc_id", "text"))
    return search.lists(kept, _flags(spark, d), QUERY, first, budget=budget, warnings=(status,))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """A page with its texts, over the kept index and the packed vectors."""
    return search.page(_lists(spark, d), table(spark, d, "documents").select("doc_id", "text"), top_k=TOP)


def search_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return search.diagnostics(_lists(spark, d), table(spark, d, "orders").filter("o_orderstatus = 'O'"), top_k=TOP)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    found = _lists(spark, d)
    return search.fused([found.lexical, found.near]).select("chunk_id", F.round("rrf", 9).alias("rrf"))


def truncation_bound(spark: SparkSession, d: str) -> DataFrame:
    """What a budget of 200 cuts, and whether that could have reached the page."""
    found = _lists(spark, d, SMALL)
    return search.diagnostics(found, table(spark, d, "orders").limit(0), top_k=TOP).select("best_discarded", "page_floor", "truncated")


def scan_search(spark: SparkSession, d: str) -> DataFrame:
    """The ranking of ``hybrid_search`` without an index: all texts are cut, read and scored anew."""
    pieces = search.chunks(table(spark, d, "documents")).join(_flags(spark, d).withColumnRenamed("version_id", "doc_id"), "doc_id")
    eligible = pieces.select(search.chunk_key("doc_id", "ordinal").alias("chunk_id"), F.col("doc_id").alias("version_id"), "text", "formal", "preferred")
    vectors = table(spark, d, "embeddings").select(F.concat_ws(":", F.col("vec_id").cast("string"), F.lit("0")).alias("chunk_id"), F.col("embedding").alias("vector"))
    return search.hybrid(eligible, vectors, QUERY, _query_vector(spark, d), budget=BUDGET, top_k=TOP)


def literature_query(spark: SparkSession, d: str) -> DataFrame:
    """Vector and keyword candidates mixed 0.6 to 0.4, raised to documents with quality and recommendation."""
    docs = table(spark, d, "documents")
    low = F.lower("text")
    keys = [k for k in KEYWORDS if len(k) >= 3]
    hit = F.contains(low, F.lit(keys[0]))
    for k in keys[1:]:
        hit = hit | F.contains(low, F.lit(k))
    lead = T.jaccard(T.normal_tokens(F.slice(F.split("text", "[ \\n\\t]+", 7), 1, 6)), T.normal_tokens(F.array(*map(F.lit, KEYWORDS))))
    near = _scored(spark, d).select(F.col("vec_id").alias("doc_id"), "score")
    quality = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    both = docs.select("doc_id", hit.alias("hit"), lead.alias("j")).join(near, "doc_id", "left").filter("hit or score is not null").join(quality, "doc_id", "left")
    kw = F.when(F.col("hit"), 0.5 * F.col("j") + 0.5 * (1.0 / 3)).otherwise(0.0)
    scored = both.withColumn("relevance", 0.6 * F.coalesce("score", F.lit(0.0)) + 0.4 * kw)
    whole = scored.groupBy("doc_id", "quality").agg(literature.relevance(F.col("relevance"), (F.col("j") >= literature.LEAST_JACCARD) | F.col("hit")).alias("r"))
    best = whole.orderBy(F.desc("r"), "doc_id").limit(50)
    return best.select("doc_id", F.round("r", 6).alias("relevance"), literature.recommendation(F.col("r"), F.coalesce("quality", F.lit(0.4))).alias("recommendation"))


V0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
SCORED_SQL = f"scored AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], {V0}) AS score FROM embeddings)"
def lists_sql(budget: int) -> str:
    return f"""{CHUNKS_SQL},
eligible AS (
    SELECT c.doc_id || ':' || c.ordinal AS chunk_id, c.doc_id AS version_id, c.text, d.lang = 'en' AS formal,
           EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id AND l.quality = 1) AS preferred
    FROM chunks c JOIN documents d USING (doc_id)
),
words AS (SELECT *, regexp_extract_all({PLAIN_SQL}, '[\\p{{L}}\\p{{N}}_]+') AS words FROM eligible),
stats AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM words),
terms AS (SELECT unnest(['the', 'thing', 'of', 'and']) AS term),
dfs AS (SELECT t.term, sum(CASE WHEN list_contains(w.words, t.term) THEN 1 ELSE 0 END) AS df FROM terms t, words w GROUP BY t.term),
lex AS (
    SELECT w.chunk_id, w.version_id, w.formal, w.preferred,
           sum(CAST(contains(lower(w.text), f.term) AS INT) + greatest(ln((s.n - f.df + 0.5) / (f.df + 0.5)), 1e-6) * (len(list_filter(w.words, lambda x: x = f.term)) * 2.2)
               / (len(list_filter(w.words, lambda x: x = f.term)) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w.words) / s.avgdl))) AS score
    FROM words w, dfs f, stats s GROUP BY ALL HAVING score > 0
),
near AS (SELECT e.chunk_id, e.version_id, e.formal, e.preferred, list_cosine_similarity(v.embedding::DOUBLE[], {V0}) AS score FROM eligible e JOIN embeddings v ON e.chunk_id = v.vec_id || ':0'),
kept AS (
    SELECT * FROM (SELECT * FROM lex ORDER BY formal DESC, preferred DESC, score DESC, chunk_id LIMIT {budget})
),
kept2 AS (
    SELECT * FROM (SELECT * FROM near ORDER BY formal DESC, preferred DESC, score DESC, chunk_id LIMIT {budget})
),
ranked AS (
    SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM kept
    UNION ALL SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM kept2
),
fused AS (SELECT chunk_id, version_id, formal, preferred, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM ranked GROUP BY ALL)"""


LISTS_SQL = lists_sql(BUDGET)
ORDER = "formal DESC, preferred DESC, rrf DESC, chunk_id"



def facts_sql(budget: int) -> str:
    return f"""p AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS place FROM fused),
        c AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY place) AS of_version FROM p),
        shown AS (SELECT rrf FROM c WHERE of_version <= 5 AND place <= {budget} ORDER BY place LIMIT {TOP}),
        counts AS (SELECT (SELECT count(*) FROM lex) AS n_lex, (SELECT count(*) FROM near) AS n_near, (SELECT count(*) FROM fused) AS union_count, (SELECT max(rrf) FROM p WHERE place > {budget}) AS over,
                          (SELECT count(*) FROM shown) AS hits, (SELECT min(rrf) FROM shown) AS page_floor),
        facts AS (SELECT *, greatest(over, CASE WHEN n_lex > {budget} OR n_near > {budget} THEN 2.0::DOUBLE / (60 + {budget}) END) AS best FROM counts)"""


QUERIES = {f.__name__: f for f in (vector_topk_cosine, vector_topk_l2, vector_validity, knn_per_label_top5, post_filter_knn, pre_filter_knn, similar_level, packed_vectors, hybrid_search, scan_search, search_diagnostics, rrf_fusion, truncation_bound, literature_query)}
KEYS_SQL = "['tions', 'thing', 'ouren', 'the', 'ende']"


def _lead() -> str:
    return f"CASE WHEN len({normal_sql(SPLIT_SQL + '[1:6]')}) > 0 THEN len(list_intersect({normal_sql(SPLIT_SQL + '[1:6]')}, {normal_sql(KEYS_SQL)}))::DOUBLE / len(list_distinct(list_concat({normal_sql(SPLIT_SQL + '[1:6]')}, {normal_sql(KEYS_SQL)}))) ELSE 0 END"


SQL = {
    "vector_topk_cosine": f"WITH {SCORED_SQL} SELECT vec_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, vec_id LIMIT 50",
    "vector_topk_l2": f"""WITH s AS (SELECT vec_id, list_distance(embedding::DOUBLE[], {V0}) AS d FROM embeddings)
        SELECT vec_id, round(d, 6) AS distance, round(exp(-d / 6.4::DOUBLE), 6) AS by_exp, round(1 / (1 + d), 6) AS by_inverse, round(1 - least(d, 2.0::DOUBLE) / 2, 6) AS by_share FROM s ORDER BY d, vec_id LIMIT 50""",
    "vector_validity": "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings",
    "knn_per_label_top5": f"WITH {SCORED_SQL}, p AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS place, vec_id FROM scored) SELECT * FROM p WHERE place <= 5",
    "post_filter_knn": f"WITH {SCORED_SQL}, near AS (SELECT * FROM scored ORDER BY score DESC, vec_id LIMIT 100) SELECT vec_id, source FROM near JOIN documents ON doc_id = vec_id WHERE lang = 'en'",
    "pre_filter_knn": f"WITH {SCORED_SQL} SELECT vec_id, source FROM scored JOIN documents ON doc_id = vec_id WHERE lang = 'en' ORDER BY score DESC, vec_id LIMIT 100",
    "similar_level": f"""WITH {SCORED_SQL}, m AS (SELECT s.vec_id, 0.6::DOUBLE * s.score + 0.4::DOUBLE * ({_lead()}) AS mix FROM scored s JOIN documents ON doc_id = vec_id WHERE s.label = (SELECT label FROM embeddings WHERE vec_id = 0))
        SELECT vec_id, round(mix, 6) AS mix FROM m ORDER BY m.mix DESC, vec_id LIMIT 20""",
    "scan_search": f"""WITH {LISTS_SQL}, best AS (SELECT * FROM fused ORDER BY {ORDER} LIMIT {BUDGET}),
        capped AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY {ORDER}) AS of_version FROM best),
        page AS (SELECT row_number() OVER (ORDER BY {ORDER}) AS position, chunk_id, version_id, formal, preferred, rrf FROM capped WHERE of_version <= 5)
        SELECT position, chunk_id, version_id, formal, preferred, round(rrf, 9) AS rrf FROM page WHERE position <= {TOP}""",
    "hybrid_search": f"""WITH {LISTS_SQL}, best AS (SELECT * FROM fused ORDER BY {ORDER} LIMIT {BUDGET}),
        capped AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY {ORDER}) AS of_version FROM best),
        page AS (SELECT row_number() OVER (ORDER BY {ORDER}) AS position, chunk_id, version_id, formal, preferred, rrf FROM capped WHERE of_version <= 5)
        SELECT position, p.chunk_id, p.version_id, p.formal, p.preferred, round(rrf, 9) AS rrf, round(l.score, 6) AS lexical_score, round(n.score, 6) AS vector_score, e.text
        FROM page p JOIN eligible e USING (chunk_id) LEFT JOIN kept l ON l.chunk_id = p.chunk_id LEFT JOIN kept2 n ON n.chunk_id = p.chunk_id WHERE position <= {TOP}""",
    "rrf_fusion": f"WITH {LISTS_SQL} SELECT chunk_id, round(rrf, 9) AS rrf FROM fused",
    "packed_vectors": f"WITH {SCORED_SQL} SELECT vec_id, round(score, 6) AS score, 'vector_binary_scan' AS status FROM scored ORDER BY scored.score DESC, vec_id LIMIT 50",
    "truncation_bound": f"WITH {lists_sql(SMALL)}, {facts_sql(SMALL)} SELECT round(best, 9) AS best_discarded, round(page_floor, 9) AS page_floor, coalesce(best >= page_floor, false) AS truncated FROM facts",
    "search_diagnostics": f"""WITH {LISTS_SQL}, {facts_sql(BUDGET)}
        SELECT (SELECT count(*) FROM eligible) AS eligible, n_lex AS lexical_matches, n_near AS vectors, n_lex > {BUDGET} AS lexical_list_cut, n_near > {BUDGET} AS vector_list_cut, union_count, union_count > {BUDGET} AS union_cut,
               round(best, 9) AS best_discarded, round(page_floor, 9) AS page_floor, coalesce(best >= page_floor, false) AS truncated,
               CASE WHEN best >= page_floor THEN 'candidate_budget_exhausted' WHEN hits > 0 THEN 'matching_results' WHEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') > 0 THEN 'processing_incomplete' ELSE 'no_matching_results' END AS status,
               'vector_binary_scan' AS warnings
        FROM facts""",
    "literature_query": f"""WITH {SCORED_SQL}, b AS (
            SELECT doc_id, len(list_filter({KEYS_SQL}, lambda k: contains(lower(text), k))) > 0 AS hit, {_lead()} AS j, s.score, l.quality
            FROM documents LEFT JOIN scored s ON s.vec_id = doc_id LEFT JOIN labels l USING (doc_id)),
        c AS (SELECT *, 0.6::DOUBLE * coalesce(score, 0) + 0.4::DOUBLE * CASE WHEN hit THEN 0.5::DOUBLE * j + 0.5::DOUBLE * (1.0::DOUBLE / 3) ELSE 0 END AS relevance FROM b WHERE hit OR score IS NOT NULL),
        r AS (SELECT doc_id, quality, coalesce(max(CASE WHEN j >= 0.3::DOUBLE OR hit THEN relevance END), max(relevance) * 0.5::DOUBLE, 0) AS r FROM c GROUP BY doc_id, quality)
        SELECT doc_id, round(r, 6) AS relevance, CASE WHEN coalesce(quality, 0.4) >= 0.55 AND r >= 0.75 THEN 'primary' WHEN coalesce(quality, 0.4) >= 0.55 AND r >= 0.5 THEN 'supporting' ELSE 'background' END AS recommendation
        FROM r ORDER BY r.r DESC, doc_id LIMIT 50""",
}
