"""Lexical, vector and hybrid evidence search over chunks.

Nothing is collected but the query's own statistics: one row with the number of chunks, their mean length and a count
for each query term. Chunking and scoring need no shuffle and read texts once; lists are bounded by the candidate budget before they meet.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwood.functions import text as T
from fernwood.functions import vectors as V
from fernwood.operators import index
from fernwood.sources.scratch import written

SEGMENT = 800  # characters of a chunk
BLOCK = 500  # lines whose lengths are summed at once
K1, B = 1.2, 0.75
RRF_K = 60
PER_VERSION = 5


def _starts(lengths: Column) -> Column:
    """Sums of all elements before each one. Appending copies an array, so blocks of ``BLOCK`` elements keep the work linear."""

    def running(values: Column, base: Column) -> Column:
        return F.aggregate(values, F.array(base), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda acc, n: acc + n))
    zero = F.lit(0).cast("bigint")
    return F.flatten(F.zip_with(blocks, F.slice(running(totals, zero), F.lit(1), F.size(blocks)), lambda x, base: F.slice(running(x, base), F.lit(1), F.size(x))))


def chunks(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ordinal, char_start, char_end, text and the columns ``carry``: every line in segments of ``SEGMENT`` characters; blank ones go, offsets stay.

    All chunks of a document are made where its row is: nothing is shuffled.
    """
    keep = ["doc_id", *carry]
    lines = docs.select(*keep, F.split(F.coalesce("text", F.lit("")), "\n").alias("_lines"))
    sized = lines.withColumn("_lengths", F.transform("_lines", lambda x: F.length(x).cast("bigint") + 1))
    placed = sized.withColumn("_starts", _starts(F.col("_lengths")))
    segments = F.zip_with(
        "_lines", "_starts",
        lambda line, start: F.transform(
            F.regexp_extract_all(line, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0)),
            lambda part, i: F.struct((start + i * SEGMENT).alias("char_start"), part.alias("text")),
        ),
    )
    solid = F.filter(F.flatten(segments), lambda x: F.trim(x["text"]) != "")
    cut = placed.select(*keep, F.posexplode(solid).alias("_at", "_x"))
    start, text = F.col("_x.char_start"), F.col("_x.text")
    return cut.select(*keep, F.col("_at").cast("bigint").alias("ordinal"), start.alias("char_start"), (start + F.length(text)).cast("bigint").alias("char_end"), text.alias("text"))


def query_terms(query: str) -> list[str]:
    return index.query_terms(query)


def tallied(pieces: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """``pieces`` without their text but with what scores need: _hits (terms found as substrings), _n_words and _tf of each different term.

    Texts are read once: the numbers are written, and statistics, scores and later joins read only them.
    """
    # Words are made once a row: no projection moves below the generator and repeats the expression there.
    held = pieces.select("*", F.explode(F.array(T.tokens(T.folded(F.col(text))))).alias("_words"))
    tf = F.array(*[F.size(F.filter("_words", _equals(t))) for t in dict.fromkeys(terms)])
    numbers = held.withColumns({"_hits": T.substring_hits(F.col(text), terms), "_n_words": F.size("_words"), "_tf": tf})
    return written(numbers.drop(text, "_words"), "tallies")


def bm25(tallies: DataFrame, terms: list[str]) -> Column:
    """The expression of the BM25 score of ``tallied`` rows; repeated terms count again, statistics cover all rows."""
    keys = list(dict.fromkeys(terms))
    stats = tallies.agg(F.count("*").alias("n"), F.avg("_n_words").alias("avgdl"), *(F.count_if(F.col("_tf")[i] > 0).alias(f"df{i}") for i in range(len(keys)))).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    score = F.lit(0.0)
    for t in terms:
        df = stats[f"df{keys.index(t)}"]
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) if n else 0.0
        tf = F.col("_tf")[keys.index(t)].cast("double")
        score = score + idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("_n_words") / avgdl))
    return score


def _equals(term: str):
    return lambda w: w == term


def matching(tallies: DataFrame, terms: list[str]) -> DataFrame:
    """``tallied`` rows that match: score = substring hits + BM25, above 0."""
    if not terms:
        return tallies.withColumn("score", F.lit(0.0)).filter("false")
    return tallies.withColumn("score", F.col("_hits") + bm25(tallies, terms)).drop("_hits", "_n_words", "_tf").filter("score > 0")


def lexical(pieces: DataFrame, query: str) -> DataFrame:
    """``pieces`` (without their text) that match ``query``, with their score."""
    terms = query_terms(query)
    return matching(tallied(pieces, terms) if terms else pieces.drop("text"), terms)


def retained(scored: DataFrame, budget: int) -> DataFrame:
    """The best ``budget`` rows, formal and preferred versions first, with ranks by score alone."""
    best = scored.orderBy(F.desc("formal"), F.desc("preferred"), F.desc("score"), "chunk_id").limit(budget)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))  # at most ``budget`` rows


def fused(lists: list[DataFrame]) -> DataFrame:
    """chunk_id, formal, preferred, version_id, rrf over bounded ranked lists."""
    one = lists[0]
    for more in lists[1:]:
        one = one.unionByName(more)
    return one.groupBy("chunk_id", "version_id", "formal", "preferred").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf"))


def final_order(*more: Column) -> list[Column]:
    return [F.desc("formal"), F.desc("preferred"), F.desc("rrf"), F.asc("chunk_id"), *more]


def hybrid(eligible: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], *, budget: int = 10_000, top_k: int = 10) -> DataFrame:
    """position, chunk_id, version_id, rrf of the best chunks, at most five of a version.

    ``eligible``: chunk_id, version_id, text, formal, preferred; ``vectors``: chunk_id, vector.
    """
    fields = ["chunk_id", "version_id", "formal", "preferred", "score"]
    terms = query_terms(query)
    tallies = tallied(eligible, terms)
    lex = retained(matching(tallies, terms).select(fields), budget)
    near = tallies.join(vectors, "chunk_id").withColumn("score", V.cosine(F.col("vector"), V.literal(query_vector))).select(fields)
    both = fused([lex, retained(near, budget)]).orderBy(*final_order()).limit(budget)
    capped = both.withColumn("of_version", F.row_number().over(Window.partitionBy("version_id").orderBy(*final_order()))).filter(F.col("of_version") <= PER_VERSION)
    page = capped.orderBy(*final_order()).limit(top_k)
    return page.select(F.row_number().over(Window.orderBy(*final_order())).cast("bigint").alias("position"), "chunk_id", "version_id", "formal", "preferred", F.round("rrf", 9).alias("rrf"))


def chunk_key(owner: str, ordinal: str) -> Column:
    return F.concat_ws(":", F.col(owner).cast("string"), F.col(ordinal).cast("string"))


def chunk_index(docs: DataFrame) -> index.Index:
    """The kept index of the chunks of documents (doc_id, text); a chunk's id is its document's and its ordinal."""

    def cut(source: DataFrame) -> DataFrame:
        return chunks(source.withColumnRenamed("owner", "doc_id")).select(F.col("doc_id").alias("owner"), chunk_key("doc_id", "ordinal").alias("id"), "text")

    return index.kept(docs, name="chunks", cut=cut)


@dataclass(frozen=True)
class Lists:
    """The two ranked lists of a search over a kept index, each bounded by the budget, with what was cut."""

    lexical: DataFrame  # chunk_id, version_id, formal, preferred, score, rank
    near: DataFrame
    eligible: int
    lexical_matches: int
    vectors: int
    budget: int
    warnings: tuple[str, ...]


def lists(kept: index.Index, flags: DataFrame, query: str, near: DataFrame | None, *, budget: int = 10_000, warnings: tuple[str, ...] = ()) -> Lists:
    """Lists of the eligible chunks of ``kept``. ``flags``: version_id, formal, preferred of eligible versions; ``near``: chunk_id, score of vectors, or None. No text is read."""
    fields = ["chunk_id", "version_id", "formal", "preferred", "score"]
    versions = flags.select("version_id", "formal", "preferred")
    eligible = kept.units().select(F.col("owner").alias("version_id"), F.col("id").alias("chunk_id")).join(versions, "version_id")
    found = index.matches(kept, query).select(F.col("owner").alias("version_id"), F.col("id").alias("chunk_id"), "score")
    lex = written(found.join(versions, "version_id").select(fields), "lexical")
    scored = written(near.join(eligible, "chunk_id").select(fields), "near") if near is not None else lex.limit(0)
    best = [written(retained(x, budget), "retained") for x in (lex, scored)]
    return Lists(*best, eligible.count(), lex.count(), scored.count(), budget, warnings)


def ranked_union(found: Lists) -> DataFrame:
    """chunk_id, version_id, formal, preferred, rrf, place over both lists; at most twice the budget."""
    return fused([found.lexical, found.near]).withColumn("place", F.row_number().over(Window.orderBy(*final_order())))


def page(found: Lists, texts: DataFrame, *, top_k: int = 10) -> DataFrame:
    """position, chunk_id, version_id, formal, preferred, rrf, lexical_score, vector_score, text of the best chunks, at most ``PER_VERSION`` of a version.

    ``texts``: doc_id, text; only the documents of the page are read for it.
    """
    within = ranked_union(found).filter(F.col("place") <= found.budget)
    capped = within.withColumn("of_version", F.row_number().over(Window.partitionBy("version_id").orderBy("place"))).filter(F.col("of_version") <= PER_VERSION)
    top = written(capped.withColumn("position", F.row_number().over(Window.orderBy("place")).cast("bigint")).filter(F.col("position") <= top_k), "page")
    shown = F.broadcast(top.select(F.col("version_id").alias("doc_id")).distinct())  # ``top_k`` rows at most
    pieces = chunks(texts.join(shown, "doc_id", "left_semi")).select(chunk_key("doc_id", "ordinal").alias("chunk_id"), "text")
    scores = [x.select("chunk_id", F.col("score").alias(name)) for x, name in ((found.lexical, "lexical_score"), (found.near, "vector_score"))]
    out = top.join(pieces, "chunk_id").join(scores[0], "chunk_id", "left").join(scores[1], "chunk_id", "left")
    return out.select("position", "chunk_id", "version_id", "formal", "preferred", F.round("rrf", 9).alias("rrf"), F.round("lexical_score", 6).alias("lexical_score"), F.round("vector_score", 6).alias("vector_score"), "text")


def diagnostics(found: Lists, unfinished: DataFrame, *, top_k: int = 10) -> DataFrame:
    """One row: what was scanned, matched and cut, whether that could have changed the page, status and warnings. ``unfinished``: jobs that are not done."""
    place = ranked_union(found).withColumn("on_page", F.row_number().over(Window.partitionBy("version_id").orderBy("place")) <= PER_VERSION)
    shown = place.filter(F.col("on_page") & (F.col("place") <= found.budget)).orderBy("place").limit(top_k).agg(F.count("*").alias("hits"), F.min("rrf").alias("page_floor"))
    facts = place.agg(F.count("*").alias("union_count"), F.max(F.when(F.col("place") > found.budget, F.col("rrf"))).alias("over"))
    cut = (found.lexical_matches > found.budget, found.vectors > found.budget)
    list_bound = F.lit(2.0 / (RRF_K + found.budget) if any(cut) else None).cast("double")
    best = F.greatest("over", list_bound)  # nulls are passed over
    truncated = F.coalesce(best >= F.col("page_floor"), F.lit(False))
    todo = unfinished.agg(F.count("*").alias("unfinished"))
    status = F.when(truncated, "candidate_budget_exhausted").when(F.col("hits") > 0, "matching_results").when(F.col("unfinished") > 0, "processing_incomplete").otherwise("no_matching_results")
    return facts.join(shown).join(todo).select(
        F.lit(found.eligible).cast("bigint").alias("eligible"), F.lit(found.lexical_matches).cast("bigint").alias("lexical_matches"), F.lit(found.vectors).cast("bigint").alias("vectors"),
        F.lit(cut[0]).alias("lexical_list_cut"), F.lit(cut[1]).alias("vector_list_cut"), "union_count", (F.col("union_count") > found.budget).alias("union_cut"),
        F.round(best, 9).alias("best_discarded"), F.round("page_floor", 9).alias("page_floor"), truncated.alias("truncated"), status.alias("status"), F.array_join(F.array(*map(F.lit, found.warnings)), ",").alias("warnings"),
    )


def self_search(pieces: DataFrame, near: DataFrame, keywords: list[str], *, level: int | None = None, top_k: int = 10) -> DataFrame:
    """chunk_id, path, level, similarity, boost, score, snippet, snippet_source, context of the best ``top_k`` of one's own chunks.

    ``pieces``: chunk_id, path, level, parent_id, text of the chunks that count; ``near``: chunk_id, distance, similarity of all vectors, of which the nearest are fetched: four times
    as many as there are own chunks, 20 times the page, 200 at least. A chunk gains 0.05 for every other candidate under its path; ties go to the smaller id.
    ``context`` holds the ids of parent and siblings, chunks of the page excepted.
    """
    reach = max(4 * pieces.count(), 20 * top_k, 200)
    fetched = near.orderBy("distance", "chunk_id").limit(reach)
    own = pieces if level is None else pieces.filter(F.col("level") == level)
    met = written(fetched.join(own.drop("text"), "chunk_id"), "own")
    counts = met.groupBy("path").agg((F.count("*") - 1).alias("others"))
    boosted = met.join(counts, "path").withColumns({"similarity": F.round("similarity", 4), "boost": F.round(F.col("others") * 0.05, 4)}).withColumn("score", F.round(F.col("similarity") + F.col("boost"), 4))
    top = written(boosted.orderBy(F.desc("score"), "chunk_id").limit(top_k), "top")
    shown = F.broadcast(top.select("chunk_id"))  # ``top_k`` rows
    parents = F.broadcast(top.select("parent_id").filter("parent_id is not null").distinct())
    around = pieces.select("chunk_id", "parent_id").join(parents, "parent_id", "left_semi").join(shown, "chunk_id", "left_anti")
    above = pieces.select("chunk_id", F.col("chunk_id").cast("string").alias("parent_id")).join(parents, "parent_id", "left_semi").join(shown, "chunk_id", "left_anti")
    lists = around.unionByName(above.select("chunk_id", "parent_id")).groupBy("parent_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("context"))
    texts = pieces.join(shown, "chunk_id", "left_semi").select("chunk_id", T.snippet(F.col("text"), keywords).alias("s"))
    out = top.join(texts, "chunk_id").join(lists, "parent_id", "left")
    return out.select("chunk_id", "path", "level", "similarity", "boost", "score", F.col("s.snippet").alias("snippet"), F.col("s.source").alias("snippet_source"), F.coalesce("context", F.array().cast(lists.schema["context"].dataType)).alias("context"))


def bound(lex: DataFrame, near: DataFrame, budget: int, top_k: int) -> DataFrame:
    """best_discarded, page_floor, truncated: whether what the budget cut could have reached the page."""
    cut = 2.0 / (RRF_K + budget)
    place = fused([retained(lex, budget), retained(near, budget)]).withColumn("place", F.row_number().over(Window.orderBy(*final_order())))
    facts = place.agg(F.coalesce(F.max(F.when(F.col("place") > budget, F.col("rrf"))), F.lit(0.0)).alias("over"), F.min(F.when(F.col("place") <= top_k, F.col("rrf"))).alias("page_floor"))
    was_cut = lex.count() > budget or near.count() > budget
    best = F.greatest("over", F.lit(cut if was_cut else 0.0))
    return facts.select(F.round(best, 9).alias("best_discarded"), F.round("page_floor", 9).alias("page_floor"), (best >= F.col("page_floor")).alias("truncated"))
