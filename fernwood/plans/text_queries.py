"""Queries over texts: chunks, words, scores, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernwood.functions import text as T
from fernwood.operators import documents, index, planning, search
from fernwood.sources.tables import table

QUERY = "the thing of and"
KEYWORDS = ["tions", "thing", "ouren", "the", "ende"]

CHUNKS_SQL = """
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents),
placed AS (SELECT doc_id, line_no, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS pos FROM lines),
parts AS (SELECT doc_id, line_no, line, pos, unnest(range(0, length(line), 800)) AS off FROM placed WHERE length(line) > 0),
cut AS (SELECT doc_id, CAST(pos + off AS BIGINT) AS char_start, substring(line, CAST(off AS BIGINT) + 1, 800) AS text FROM parts),
chunks AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY char_start) - 1 AS ordinal, char_start, CAST(char_start + length(text) AS BIGINT) AS char_end, text
    FROM cut WHERE trim(text, ' ') <> ''
)"""


def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.chunks(table(spark, d, "documents"))


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    sizes = search.chunks(table(spark, d, "documents")).groupBy(F.length("text").cast("bigint").alias("size")).agg(F.count("*").alias("n"))
    # At most SEGMENT different sizes are left, so the running count needs one small window.
    run = sizes.withColumns({"upto": F.sum("n").over(Window.orderBy("size")), "total": F.sum("n").over(Window.partitionBy())})
    return run.agg(F.sum("n").alias("n_chunks"), F.min("size").alias("min_chars"), F.max("size").alias("max_chars"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("size"))).alias("median_chars"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.tokens(T.folded(F.col("text"))).alias("words"))


def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    one = index.term_counts(table(spark, d, "documents"), "doc_id", "text")
    return one.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).select("doc_id", F.size("words").cast("bigint").alias("n_words"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """From the kept index, which reads the blocks that can reach the best 20."""
    best = index.topk(index.kept(table(spark, d, "documents").select("doc_id", "text")), QUERY, 20).rows
    return best.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same without an index: all texts are read."""
    terms = search.query_terms(QUERY)
    held = search.tallied(table(spark, d, "documents").select("doc_id", "text"), terms)
    best = held.select("doc_id", search.bm25(held, terms).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)
    return best.select("doc_id", F.round("score", 6).alias("score"))


def substring_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.substring_hits(F.col("text"), ["thing", "ouren", "keit", "the"]).alias("hits")).filter("hits > 0")


def normalize_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = T.normal_tokens(F.split("text", "[ \\n\\t]+"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(words), " ").alias("tokens"), F.size(words).cast("bigint").alias("n_tokens"))


def heading_jaccard(spark: SparkSession, d: str) -> DataFrame:
    heading = T.normal_tokens(F.slice(F.split("text", "[ \\n\\t]+"), 1, 6))
    wanted = T.normal_tokens(F.array(*map(F.lit, KEYWORDS)))
    both = table(spark, d, "documents").select("doc_id", T.jaccard(heading, wanted).alias("j"))
    return both.filter("j > 0").select("doc_id", F.round("j", 6).alias("jaccard"), (F.col("j") >= 0.30).alias("matched"))


def token_hit(spark: SparkSession, d: str) -> DataFrame:
    words = T.normal_tokens(F.split("text", "[ \\n\\t]+"))
    return table(spark, d, "documents").select("doc_id", F.arrays_overlap(words, T.normal_tokens(F.array(F.lit("inging"), F.lit("keiten"), F.lit("vouser")))).alias("hit"))


def article_type_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.article_kind(F.col("text")).alias("kind"), F.col("lang")).groupBy("kind", "lang").agg(F.count("*").alias("n"))


def raw_match_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Documents held against a stated title and abstract: the documents' own first words and a passage."""
    docs = table(spark, d, "documents")
    low = F.lower("text")
    title = ["thing", "them", "that", "ingthe", "tion"]
    hits = sum((F.contains(low.substr(1, 1000), F.lit(t)).cast("bigint") for t in title), F.lit(0).cast("bigint"))
    head = F.regexp_replace(low.substr(1, 500), "[ \\n\\t]+", "")
    pieces = ["anthething", "tiontheing", "oftheandth", "ingtheofth"]
    share = sum((F.contains(head, F.lit(p)).cast("double") for p in pieces), F.lit(0.0)) / len(pieces)
    both = docs.select("doc_id", hits.alias("title_hits"), share.alias("overlap"))
    ok, near = F.col("title_hits") >= 3, F.col("overlap") >= 0.1
    return both.withColumn("status", F.when(ok & near, "ok").when(ok | near, "warn").otherwise("fail"))


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    return planning.sized(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chars", "tokens", "skipped")


def identifier_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.web_identifier(F.col("url")).alias("identifier"))


def html_visible_text(spark: SparkSession, d: str) -> DataFrame:
    return documents.visible_text(table(spark, d, "pages"))


def page_markdown_nodes(spark: SparkSession, d: str) -> DataFrame:
    return documents.page_nodes(table(spark, d, "pages"))


def page_tree_chunks(spark: SparkSession, d: str) -> DataFrame:
    return documents.tree_chunks(documents.markdown_of(table(spark, d, "pages")))


def snippet_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), ["thing", "keit"]).alias("s")).select("doc_id", "s.snippet", "s.source")


PLAIN_SQL = "translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
WORDS_SQL = f"words AS (SELECT doc_id, regexp_extract_all({PLAIN_SQL}, '[\\p{{L}}\\p{{N}}_]+') AS words FROM documents)"


def normal_sql(words: str) -> str:
    return f"""list_distinct(list_transform(list_filter(list_transform({words}, lambda w: trim(lower(w), '.,;:()[]{{}}''"')), lambda w: length(w) > 1), lambda t:
        CASE WHEN ends_with(t, 'ies') AND length(t) > 4 THEN left(t, length(t) - 3) || 'y'
             WHEN ends_with(t, 'es') AND length(t) > 3 AND NOT ends_with(t, 'oes') THEN left(t, length(t) - 2)
             WHEN ends_with(t, 's') AND length(t) > 3 THEN left(t, length(t) - 1) ELSE t END))"""


SPLIT_SQL = r"string_split_regex(text, '[ \n\t]+')"
QUERIES = {f.__name__: f for f in (chunk_lines, chunk_stats, tokenize_terms, doc_lengths, bm25_topk, bm25_scan, substring_score, normalize_tokens, heading_jaccard, token_hit, article_type_case, raw_match_verdict, token_budget, identifier_normalize, html_visible_text, page_markdown_nodes, page_tree_chunks, snippet_extract)}
SQL = {
    "chunk_lines": f"WITH {CHUNKS_SQL} SELECT * FROM chunks",
    "chunk_stats": f"""WITH {CHUNKS_SQL}, sizes AS (SELECT length(text) AS size, row_number() OVER (ORDER BY length(text)) - 1 AS place, count(*) OVER () AS n FROM chunks)
        SELECT count(*) AS n_chunks, CAST(min(size) AS BIGINT) AS min_chars, CAST(max(size) AS BIGINT) AS max_chars, CAST(max(CASE WHEN place = n // 2 THEN size END) AS BIGINT) AS median_chars FROM sizes""",
    "tokenize_terms": f"WITH {WORDS_SQL}, one AS (SELECT unnest(words) AS term, doc_id FROM words) SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM one GROUP BY term",
    "doc_lengths": f"WITH {WORDS_SQL} SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words FROM words",
    "bm25_topk": f"""WITH {WORDS_SQL}, stats AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM words),
        terms AS (SELECT unnest(['the', 'thing', 'of', 'and']) AS term),
        dfs AS (SELECT t.term, sum(CASE WHEN list_contains(w.words, t.term) THEN 1 ELSE 0 END) AS df FROM terms t, words w GROUP BY t.term),
        scored AS (
            SELECT w.doc_id, sum(greatest(ln((s.n - f.df + 0.5) / (f.df + 0.5)), 1e-6) * (len(list_filter(w.words, lambda x: x = f.term)) * 2.2)
                / (len(list_filter(w.words, lambda x: x = f.term)) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w.words) / s.avgdl))) AS score
            FROM words w, dfs f, stats s GROUP BY w.doc_id)
        SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 20""",
    "substring_score": """SELECT * FROM (SELECT doc_id, CAST(contains(lower(text), 'thing') AS BIGINT) + CAST(contains(lower(text), 'ouren') AS BIGINT) + CAST(contains(lower(text), 'keit') AS BIGINT) + CAST(contains(lower(text), 'the') AS BIGINT) AS hits FROM documents) WHERE hits > 0""",
    "normalize_tokens": f"SELECT item_id, array_to_string(list_sort({normal_sql(SPLIT_SQL)}), ' ') AS tokens, CAST(len({normal_sql(SPLIT_SQL)}) AS BIGINT) AS n_tokens FROM benchmark",
    "heading_jaccard": f"""WITH h AS (SELECT doc_id, {normal_sql(SPLIT_SQL + '[1:6]')} AS a, {normal_sql("['tions', 'thing', 'ouren', 'the', 'ende']")} AS b FROM documents),
        j AS (SELECT doc_id, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) ELSE 0 END AS j FROM h)
        SELECT doc_id, round(j, 6) AS jaccard, j >= 0.3::DOUBLE AS matched FROM j WHERE j > 0""",
    "token_hit": f"""SELECT doc_id, list_has_any({normal_sql(SPLIT_SQL)}, {normal_sql("['inging', 'keiten', 'vouser']")}) AS hit FROM documents""",
    "article_type_case": "SELECT kind, lang, count(*) AS n FROM (SELECT lang, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for k, p in T.ARTICLE_KINDS) + " ELSE 'unknown' END AS kind FROM documents) GROUP BY kind, lang",
    "raw_match_verdict": r"""WITH s AS (SELECT doc_id, left(lower(text), 1000) AS head, regexp_replace(left(lower(text), 500), '[ \n\t]+', '', 'g') AS packed FROM documents),
        c AS (SELECT doc_id, len(list_filter(['thing', 'them', 'that', 'ingthe', 'tion'], lambda t: contains(head, t)))::BIGINT AS title_hits,
                     len(list_filter(['anthething', 'tiontheing', 'oftheandth', 'ingtheofth'], lambda t: contains(packed, t)))::DOUBLE / 4 AS overlap FROM s)
        SELECT *, CASE WHEN title_hits >= 3 AND overlap >= 0.1 THEN 'ok' WHEN title_hits >= 3 OR overlap >= 0.1 THEN 'warn' ELSE 'fail' END AS status FROM c""",
    "token_budget": r"""WITH s AS (SELECT doc_id, length(text)::BIGINT AS chars, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))::BIGINT AS a FROM documents),
        e AS (SELECT doc_id, chars, CAST((3 * a + 8 * (chars - a) + 11) // 12 AS BIGINT) AS tokens FROM s)
        SELECT *, tokens > 8000 AS skipped FROM e""",
    "identifier_normalize": r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://([^/?#@\s]+)([^?#\s]*)([^\s]*)$', 1)) AS scheme, lower(regexp_extract(url, '^([A-Za-z]+)://([^/?#@\s]+)([^?#\s]*)([^\s]*)$', 2)) AS host,
            regexp_extract(url, '^([A-Za-z]+)://([^/?#@\s]+)([^?#\s]*)([^\s]*)$', 3) AS path, regexp_extract(url, '^([A-Za-z]+)://([^/?#@\s]+)([^?#\s]*)([^\s]*)$', 4) AS rest FROM pages)
        SELECT page_id, CASE WHEN scheme IN ('http', 'https') THEN scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || rest END AS identifier FROM p""",
}
SQL["bm25_scan"] = SQL["bm25_topk"]
