"""Canonical documents, articles, rankings and functions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwood.functions import registered
from fernwood.functions import text as T
from fernwood.functions import vectors as V
from fernwood.operators import canonical, jats, rankings, relations
from fernwood.plans.search_queries import V0
from fernwood.plans.text_queries import CHUNKS_SQL
from fernwood.sources.tables import table


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as markdown: a heading, and for each turn a numbered heading and a paragraph."""
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]+", " "))
    turn = F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit(" "), "role", F.lit("\n\n"), said, F.lit("\n"))
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", turn.alias("md")).alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return turns.select("conv_id", F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.array_join("x.md", "\n")).alias("text"))


def transcript_nodes(spark: SparkSession, d: str) -> DataFrame:
    found = canonical.nodes(_transcripts(spark, d), key="conv_id")
    return found.select(F.col("doc_id").alias("conv_id"), "ordinal", "kind", "level", "sec_num", F.array_join("heading_chain", " > ").alias("chain"), "path", "char_start", "text")


def document_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the whole grammar."""
    return canonical.nodes(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ordinal", "node_id", "parent_id", "kind", "level", "path", "char_start", "text")


def transcript_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the transcripts in chunks, with parents, children and siblings."""
    found = canonical.chunks(canonical.nodes(_transcripts(spark, d), key="conv_id"))
    return found.select(F.col("doc_id").alias("conv_id"), "path", "part", "level", "section_number", "section_title", F.array_join("heading_chain", " > ").alias("chain"), F.size("child_ids").cast("bigint").alias("children"), F.size("sibling_ids").cast("bigint").alias("siblings"), F.col("parent_id").isNotNull().alias("has_parent"), "text", "char_count")


def transcript_sections(spark: SparkSession, d: str) -> DataFrame:
    """The same by section."""
    kept = ["conv_id", "path", "level", "section_number", "section_title", "chain", "children", "siblings", "has_parent"]
    return transcript_chunks(spark, d).groupBy(kept).agg(F.sum(F.length(F.regexp_replace("text", " ", ""))).alias("letters"))


def located_chunks(spark: SparkSession, d: str) -> DataFrame:
    return canonical.located(table(spark, d, "documents").select("doc_id", "text")).drop("row")


def tree_violations(spark: SparkSession, d: str) -> DataFrame:
    """How often the checks of trees find what was broken in four of five transcripts: levels, parents, paths, ordinals."""
    kind, which = F.col("kind"), F.col("doc_id") % 5
    sound = canonical.nodes(_transcripts(spark, d), key="conv_id").drop("row")
    edited = sound.withColumns({
        "level": F.when((which == 1) & (kind == "heading"), 9).otherwise(F.col("level")), "parent_id": F.when((which == 2) & (kind == "paragraph"), "nd_gone").otherwise(F.col("parent_id")),
        "path": F.when((which == 3) & (kind == "paragraph"), "/0").otherwise(F.col("path")), "ordinal": F.when(which == 4, 1).otherwise(F.col("ordinal")),
    })
    return canonical.broken(edited).groupBy("rule").agg(F.count("*").alias("n"))


def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    """Headings of the transcripts by level."""
    return relations.heading_levels(_transcripts(spark, d), "text")


def jats_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as articles in JATS and read back as markdown."""
    safe = F.col("text")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(sign), F.lit(name))
    said = F.trim(F.regexp_replace(F.regexp_replace(safe, "[\\x00-\\x1f]+", " "), " +", " "))
    xml = F.concat(
        F.lit("<article xmlns:j='urn:x'><front><article-meta><article-title>Document <b>"), F.col("doc_id").cast("string"), F.lit("</b></article-title><abstract><p>In <i>"), "lang", F.lit("</i></p></abstract></article-meta></front><body><sec><title>"), "source",
        F.lit("</title><p>first</p><fig><p>left out</p></fig><sec><title>Text</title><p>"), said, F.lit("</p></sec></sec></body></article>"),
    )
    return jats.read(table(spark, d, "documents").select("doc_id", xml.alias("xml")))


def rank_inversions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors that two queries' similarities order differently."""
    vectors = table(spark, d, "embeddings").filter("vec_id in (0, 1)").select("vec_id", "embedding").collect()
    a, b = ([float(x) for x in r.embedding] for r in sorted(vectors))
    scored = table(spark, d, "embeddings").select("vec_id", *(F.round(V.cosine(F.col("embedding"), V.literal(q)), 4).alias(c) for q, c in ((a, "a"), (b, "b"))))
    return rankings.inversions(scored, "vec_id", "a", "b")


def sql_text_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The registered table function, called in SQL."""
    registered.register(spark)
    return spark.sql("SELECT d.doc_id, p.ordinal, p.char_start, p.piece AS text FROM {docs} d, LATERAL text_pieces(d.text, 800) p", docs=table(spark, d, "documents"))


def sql_visible_text(spark: SparkSession, d: str) -> DataFrame:
    """Registered functions over batches, called in SQL."""
    registered.register(spark)
    return spark.sql("SELECT page_id, length(visible_text(html)) AS visible, length(html_markdown(html)) AS markdown, instr(visible_text(html), '<') = 0 AS clean FROM {pages}", pages=table(spark, d, "pages"))


def identifier_keys(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of all schemes under the keys by which they are looked up."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    key, name = F.col("c_custkey").cast("string"), F.replace("c_name", F.lit("#"), F.lit("-"))
    raw = {"doi": F.concat(F.lit("https://DOI.org/10.1234/"), name), "pmid": key, "pmcid": F.concat(F.lit("PMC"), key), "url": F.concat(F.lit("HTTPS://Host.Example/"), name), "isbn": key}
    each = c.select("c_custkey", F.explode(F.array(*(F.struct(F.lit(k).alias("scheme"), v.alias("raw")) for k, v in raw.items()))).alias("x"))
    return each.select("c_custkey", "x.scheme", T.identifier(F.col("x.scheme"), F.col("x.raw")).alias("key"))


QUERIES = {f.__name__: f for f in (transcript_nodes, document_nodes, transcript_chunks, transcript_sections, located_chunks, tree_violations, heading_levels, jats_markdown, rank_inversions, sql_text_pieces, sql_visible_text, identifier_keys)}
TURNS_SQL = r"""t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn, role, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g')) AS said FROM conversations),
    s AS (SELECT *, length('## ' || turn || ' ' || role || chr(10) || chr(10)) AS head, length('## ' || turn || ' ' || role || chr(10) || chr(10) || said || chr(10)) + 1 AS size FROM t),
    p AS (SELECT *, length('# Conversation ' || conv_id) + 2 + coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
    n AS (
        SELECT DISTINCT conv_id, 0 AS k, 0 AS j, 'heading' AS kind, 1 AS level, NULL AS sec_num, '' AS chain, '/1' AS path, 0 AS char_start, 'Conversation ' || conv_id AS text FROM p
        UNION ALL SELECT conv_id, k, 0, 'heading', 2, turn::VARCHAR, 'Conversation ' || conv_id, '/1/' || k, start, role FROM p
        UNION ALL SELECT conv_id, k, 1, 'paragraph', 0, NULL, 'Conversation ' || conv_id || ' > ' || role, '/1/' || k || '/1', start + head, said FROM p WHERE said <> ''
    ), nodes AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k, j) AS ordinal, kind, level::BIGINT AS level, sec_num, chain, path, char_start::BIGINT AS char_start, text FROM n)"""
SQL = {
    "heading_levels": "SELECT 1::BIGINT AS level, count(DISTINCT conv_id) AS n FROM conversations UNION ALL SELECT 2, count(*) FROM conversations",
    "transcript_nodes": f"WITH {TURNS_SQL} SELECT * FROM nodes",
    "transcript_sections": f"""WITH {TURNS_SQL}, h AS (SELECT conv_id, count(*) - 1 AS turns FROM nodes WHERE kind = 'heading' GROUP BY conv_id)
        SELECT n.conv_id, n.path, n.level, n.sec_num AS section_number, n.text AS section_title, CASE WHEN n.level = 1 THEN n.text ELSE n.chain || ' > ' || n.text END AS chain, CASE WHEN n.level = 1 THEN turns ELSE 0 END AS children,
               CASE WHEN n.level = 1 THEN 0 ELSE turns - 1 END AS siblings, n.level > 1 AS has_parent, coalesce(length(replace(p.text, ' ', '')), 0)::BIGINT AS letters
        FROM nodes n JOIN h USING (conv_id) LEFT JOIN nodes p ON p.conv_id = n.conv_id AND p.kind = 'paragraph' AND p.path = n.path || '/1' WHERE n.kind = 'heading'""",
    "tree_violations": f"""WITH {TURNS_SQL}, c AS (SELECT *, conv_id % 5 AS which, count(*) FILTER (kind = 'paragraph') OVER (PARTITION BY conv_id) AS said FROM nodes)
        SELECT rule, count(*) AS n FROM (
            SELECT 'heading_level' AS rule FROM c WHERE which = 1 AND kind = 'heading' UNION ALL SELECT 'dangling_parent' FROM c WHERE which = 2 AND kind = 'paragraph'
            UNION ALL SELECT 'path_of_parent' FROM c WHERE which = 3 AND kind = 'paragraph' UNION ALL SELECT 'repeated_path' FROM c WHERE which = 3 AND kind = 'paragraph' AND said > 1
            UNION ALL SELECT 'repeated_ordinal' FROM c WHERE which = 4 UNION ALL SELECT 'parent_after_child' FROM c WHERE which = 4 AND ordinal > 1) GROUP BY rule""",
    "jats_markdown": r"""SELECT doc_id, '# Document ' || doc_id || chr(10) || chr(10) || '## Abstract' || chr(10) || chr(10) || 'In ' || lang || chr(10) || chr(10) || '## ' || source || chr(10) || chr(10) || 'first' || chr(10) || chr(10) || '### Text' || chr(10)
               || CASE WHEN said = '' THEN '' ELSE chr(10) || said || chr(10) END AS text, false AS broken
        FROM (SELECT *, trim(regexp_replace(regexp_replace(text, '[\x00-\x1f]+', ' ', 'g'), ' +', ' ', 'g')) AS said FROM documents)""",
    "rank_inversions": f"""WITH s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {V0}), 4) AS a, round(list_cosine_similarity(embedding::DOUBLE[], {V0.replace('vec_id = 0', 'vec_id = 1')}), 4) AS b FROM embeddings)
        SELECT (SELECT count(*) * (count(*) - 1) // 2 FROM s)::BIGINT AS pairs, count(*) AS inverted FROM s x JOIN s y ON x.a < y.a AND x.b > y.b""",
    "sql_text_pieces": f"WITH {CHUNKS_SQL} SELECT doc_id, ordinal, char_start, text FROM chunks",
    "identifier_keys": """WITH c AS (SELECT c_custkey, replace(c_name, '#', '-') AS name FROM customer)
        SELECT c_custkey, 'doi' AS scheme, '10.1234/' || lower(name) AS key FROM c UNION ALL SELECT c_custkey, 'pmid', CASE WHEN c_custkey > 0 THEN c_custkey::VARCHAR END FROM c
        UNION ALL SELECT c_custkey, 'pmcid', CASE WHEN c_custkey > 0 THEN 'PMC' || c_custkey END FROM c UNION ALL SELECT c_custkey, 'url', 'https://host.example/' || name FROM c UNION ALL SELECT c_custkey, 'isbn', NULL FROM c""",
}
