"""Small fixtures with known numbers."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from fernwood.functions import text as T
from fernwood.functions import vectors as V
from fernwood.operators import documents, graphs, index, literature, lookup, planning, search, statistics
from fernwood.sources import tables
from fernwood.streaming import events


def one(df):
    return df.first()[0]


def test_bm25_counts_repeated_terms_twice(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox fox"), (3, "green")], "id long, text string")
    held, held2 = search.tallied(docs, ["red"]), search.tallied(docs, ["red", "red"])
    a = dict(held.select("id", search.bm25(held, ["red"])).collect())
    b = dict(held2.select("id", search.bm25(held2, ["red", "red"])).collect())
    assert b[1] == 2 * a[1] > 0 and a[3] == 0


def test_substring_finds_parts_of_long_runs(spark):
    docs = spark.createDataFrame([(1, "中文研究资料", 1, True, False), (2, "none", 2, True, False)], "chunk_id long, text string, version_id long, formal boolean, preferred boolean")
    assert [r.chunk_id for r in search.lexical(docs, "研究").collect()] == [1]
    assert search.lexical(docs, '"" ()').count() == 0


def test_budget_bound_is_reached_by_equality(spark):
    rows = [(i, i, False, False, 1.0) for i in range(3)]
    lists = spark.createDataFrame(rows, "chunk_id long, version_id long, formal boolean, preferred boolean, score double")
    r = search.bound(lists, lists.filter("false"), 1, 1).first()
    assert r.best_discarded == round(2 / 61, 9) and r.truncated
    whole = search.bound(lists, lists.filter("false"), 10, 1).first()
    assert whole.best_discarded == 0 and not whole.truncated


def test_ranks_follow_score_after_formal_rows_were_kept(spark):
    rows = [(1, 1, True, False, 0.1), (2, 2, False, False, 0.9), (3, 3, False, False, 0.5)]
    lists = spark.createDataFrame(rows, "chunk_id long, version_id long, formal boolean, preferred boolean, score double")
    assert {r.chunk_id: r["rank"] for r in search.retained(lists, 2).collect()} == {1: 2, 2: 1}


def test_five_of_a_version_at_most(spark):
    rows = [(i, 7, f"word {i}", False, False) for i in range(9)] + [(99, 8, "word", False, False)]
    eligible = spark.createDataFrame(rows, "chunk_id long, version_id long, text string, formal boolean, preferred boolean")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "chunk_id long, vector array<double>")
    got = search.hybrid(eligible, vectors, "word", [1.0, 0.0], budget=100, top_k=10).collect()
    assert sum(r.version_id == 7 for r in got) == 5 and sum(r.version_id == 8 for r in got) == 1


def test_chunks_of_many_lines_and_of_none(spark):
    many = "\n".join(f"line {i}" for i in range(2 * search.BLOCK + 3))
    docs = spark.createDataFrame([(1, many, "x"), (2, None, "y"), (3, "", "z"), (4, " \n\n ", "z")], "doc_id long, text string, lang string")
    got = search.chunks(docs, carry=("lang",)).orderBy("ordinal").collect()
    assert len(got) == 2 * search.BLOCK + 3 and {r.doc_id for r in got} == {1} and {r.lang for r in got} == {"x"}
    assert all(many[r.char_start : r.char_end] == r.text and r.ordinal == i for i, r in enumerate(got))


def test_chunks_keep_offsets(spark):
    text = "a" * 801 + "\n\n  \nß😀z"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = search.chunks(docs).orderBy("doc_id", "ordinal").collect()
    assert [(r.char_start, r.char_end) for r in got] == [(0, 800), (800, 801), (806, 809)]
    assert all(text[r.char_start : r.char_end] == r.text for r in got)


def test_planner_numbers(spark):
    rows = [("g", k, 5) for k in ("alpha", "bravo", "charm", "delta", "eagle")]
    texts = spark.createDataFrame(rows, "grp string, id string, chars long")
    made = planning.greedy_batches(texts, group="grp", order="id", batch_size=2, max_chars=12)
    assert [r.batch for r in made.orderBy("id").collect()] == [0, 0, 1, 1, 2]
    cut = planning.within_budget(made, group="grp", max_calls=10, max_chars=12).first()
    assert (cut.rows, cut.calls, cut.chars) == (2, 1, 10)
    large = spark.createDataFrame([("g", "a", 3), ("g", "b", 50), ("g", "c", 3)], "grp string, id string, chars long")
    assert [r.batch for r in planning.greedy_batches(large, group="grp", order="id", batch_size=9, max_chars=12).orderBy("id").collect()] == [0, 1, 2]


def test_injected_provider(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "bb")], "id long, text string")
    got = planning.embed(texts, lambda some: [[float(len(t))] for t in some], key="id", batch=1)
    assert {r.id: r.vector for r in got.collect()} == {1: [1.0], 2: [2.0]}


def test_token_estimate(spark):
    df = spark.createDataFrame([("abcd",), ("éé",), ("",)], "text string")
    assert [r[0] for r in df.select(T.token_estimate(F.col("text"))).collect()] == [1, 2, 0]


def test_singular_and_jaccard(spark):
    df = spark.createDataFrame([(["Studies,", "boxes", "cats", "shoes", "a", "IS"],)], "w array<string>")
    assert one(df.select(T.normal_tokens(F.col("w")))) == ["study", "box", "cat", "shoe", "is"]
    assert one(df.select(T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")))) == 0.0


def test_snippet_sources(spark):
    df = spark.createDataFrame([("A first sentence that fits well. Then more comes, far beyond.",), ("x" * 100 + " keyword " + "y" * 100,), ("short",)], "t string")
    got = [tuple(r[0]) for r in df.select(T.snippet(F.col("t"), ["keyword"])).collect()]
    assert got[0] == ("A first sentence that fits well.", "first_sentence") and got[1][1] == "keyword_window" and "keyword" in got[1][0] and got[2] == ("short", "fallback_short")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("E. coli is a name that holds a mark early. It goes on for far more than sixty characters.", ("E. coli is a name that holds a mark early.", "first_sentence")),
        ("One short end here. And one that still ends near. Far more text follows here.", ("One short end here. And one that still ends near.", "first_sentence")),
        ("A heading of a section\nthen text without any end that goes on and on for long", ("A heading of a section", "first_sentence")),
        ("a" * 12 + ". " + "b" * 80, ("a" * 12 + ". " + "b" * 36 + "...", "fallback_short")),
        ("word " * 30, ("word " * 10 + "word...", "fallback_short")),
        ("no end but thirty characters or so", ("no end but thirty characters or so", "first_sentence")),
        ("", ("", "fallback_short")),
        (None, ("", "fallback_short")),
        ("left words before it and then the keyword stands here with many more words behind it without end", ("...before it and then the keyword stands here with many mo", "keyword_window")),
    ],
)
def test_snippet_cuts(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(T.snippet(F.col("t"), ["keyword"])).first()[0]
    assert tuple(got) == want


def test_nodes_know_fences_and_documents(spark):
    text = "# A\n\n```py\n# no heading\n\n- no list\n```\ntext\n- item\n- more\n| a | b |\n### C\nlast"
    got = [(n["kind"], n["level"], n["text"], n["path"], n["ordinal"]) for n in documents.read_nodes(text)]
    assert got == [
        ("heading", 1, "A", "/1", 0), ("code", 0, "```py\n# no heading\n\n- no list\n```", "/1/1", 0), ("paragraph", 0, "text", "/1/2", 1), ("list", 0, "- item\n- more", "/1/3", 2),
        ("table", 0, "| a | b |", "/1/4", 3), ("heading", 2, "C", "/1/5", 4), ("paragraph", 0, "last", "/1/5/1", 0),
    ]
    assert all(text[n["char_start"] :].startswith(n["text"][:3] if n["kind"] != "heading" else "#") for n in documents.read_nodes(text))
    docs = spark.createDataFrame([(1, "same"), (2, "same\n\nother"), (3, "same")], "doc_id long, text string")
    ids = {(r.doc_id, r.text): r.node_id for r in documents.nodes(docs).collect()}
    assert ids[1, "same"] == ids[3, "same"] != ids[2, "same"]
    many = documents.read_nodes("\n\n".join(f"p{i}" for i in range(30_000)))
    assert len(many) == 30_000 and many[-1]["path"] == "/30000"
    assert [n["kind"] for n in documents.read_nodes("```\nnever closed\n# x")] == ["code"]


def test_plain_text_sections(spark):
    text = "Abstract\nWe did it.\n\n1. Methods\nHow we did.\n1.1 Samples\nThree of them.\nRESULTS OF IT\nFine.\n12 of these were lost."
    heads = [(n["level"], n["text"], n["path"]) for n in documents.read_nodes(text, markdown=False) if n["kind"] == "heading"]
    assert heads == [(1, "Abstract", "/1"), (1, "1. Methods", "/2"), (2, "1.1 Samples", "/2/2"), (1, "RESULTS OF IT", "/3")]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {r.section_title for r in documents.tree_chunks(docs, markdown=False).collect()} == {h[1] for h in heads}


def test_visible_text_of_pages_against_removal_of_tags(spark, sf_dir):
    import html
    import re

    for r in documents.visible_text(tables.table(spark, sf_dir, "pages")).join(tables.table(spark, sf_dir, "pages"), "page_id").collect():
        bare = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>|<[^>]*>", "", r.html)
        assert re.sub(r"\s+", "", r.text) == re.sub(r"\s+", "", html.unescape(bare))


def test_chunk_id_codec(spark):
    rows = [("c2.0000000a.0123456789ab.89abcdef.3:4:a:/b:p1",), ("123__some/path__p2",), ("c2.0000000a.0123456789ab.89abcdef.3:9:a:/b:p1",), ("c2.0000000a.0123456789ab.89abcdef.03:4:a:/b:p1",), ("nothing",), (None,), ("c2.0000000a.0123456789ab.89abcdef.3:4:a:/bp1",)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(lookup.parsed_chunk_id(F.col("v"))).collect()]
    assert [r.valid for r in got] == [True, True, False, False, False, False, False]
    assert (got[0].generation, got[0].path, got[0].part, got[0].n) == (10, "a:/b", "p1", 3) and got[1].legacy and (got[1].path, got[1].part, got[1].generation) == ("some/path", "p2", None)
    assert spark.range(1).select(lookup.chunk_id(F.lit(-1), F.lit("ab"), F.lit("x"), F.lit("1"), F.lit(0), F.lit("p"), F.lit("q"))).first()[0] is None


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert lookup.optional(df, {"v": None, "id": 2}).count() == 1 and lookup.dump(df, "id", 0).count() == 1
    with pytest.raises(ValueError, match="unknown"):
        lookup.included(df, "id", {"v": "v"}, ["w"])
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert lookup.similar(vectors, 9, 3).count() == 0 and [r.vec_id for r in lookup.similar(vectors, 1, 3).collect()] == [2]
    counts = spark.createDataFrame([(0, 0), (0, 4), (3, 0), (500, 0)], "matched long, unfinished long")
    assert [r.status for r in lookup.status(counts, 200).collect()] == ["no_matching_results", "processing_incomplete", "matching_results", "candidate_budget_exhausted"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "pmid long, title string, note string")
    tables.write_jsonl(rows, str(tmp_path / "jsonl"))
    lines = [json.loads(x) for f in (tmp_path / "jsonl").glob("part*") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["pmid"]) == [{"pmid": 1, "title": "a", "note": None}, {"pmid": 2, "title": "b", "note": "x"}]
    for title in ("a", "c"):
        tables.write_canonical(rows.filter("pmid = 1 or title = 'b'").withColumn("title", F.lit(title)) if title == "a" else rows.filter("pmid = 1").withColumn("title", F.lit("c")), str(tmp_path / "canon"), "pmid")
    back = tables.read_canonical(spark, str(tmp_path / "canon"), "pmid long, title string, note string")
    assert sorted((r.pmid, r.title) for r in back.collect()) == [(1, "c"), (2, "a")]
    (tmp_path / "canon" / "pmid=3").mkdir()
    (tmp_path / "canon" / "pmid=3" / "x.json").write_text("{broken\n")
    assert [r.pmid for r in tables.read_canonical(spark, str(tmp_path / "canon"), "pmid long, title string").filter("broken is not null").cache().collect()] == [3]
    for _ in range(2):
        tables.append_audit(rows.select("pmid"), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).filter("logged_at is not null").count() == 4
    calls = []
    for some in (rows.filter("pmid = 1"), rows, rows):
        out = tables.memoized(some, str(tmp_path / "memo"), "pmid", lambda df: calls.append(df.count()) or df.select("pmid", F.upper("title").alias("title")))
    assert calls == [1, 1, 0] and sorted(tuple(r) for r in out.collect()) == [(1, "A"), (2, "B")]
    assert tables.listing(spark, str(tmp_path / "canon"), "*.json").count() == 3
    blobs = spark.createDataFrame([(bytearray(b"a"), hashlib.sha256(b"a").hexdigest(), 1), (bytearray(b"b"), "00", 1)], "content binary, hash string, size long")
    assert [r.intact for r in tables.verified(blobs).collect()] == [True, False]


def test_vector_validity(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), ([1.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(V.valid(F.col("v"), 2)).collect()] == [True, False, False, False, False, False]


def test_relevance_and_recommendation(spark):
    df = spark.createDataFrame([(0.9, False), (0.4, True)], "r double, m boolean")
    assert one(df.agg(literature.relevance(F.col("r"), F.col("m")))) == 0.4
    assert one(df.filter("not m").agg(literature.relevance(F.col("r"), F.col("m")))) == 0.45
    assert one(df.filter("false").agg(literature.relevance(F.col("r"), F.col("m")))) == 0.0
    got = df.select(literature.recommendation(F.lit(0.75), F.lit(0.55)), literature.recommendation(F.lit(0.5), F.lit(0.6)), literature.recommendation(F.lit(0.9), F.lit(0.4))).first()
    assert tuple(got) == ("primary", "supporting", "background")


def test_closure_ends_in_cycles_and_counts_least_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1)], "src long, dst long")
    got = graphs.closure(spark.createDataFrame([(1,)], "root long"), edges)
    assert {(r.node, r.depth) for r in got.collect()} == {(1, 0), (2, 1), (3, 1)}


def test_alias_chain(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)], "id long, merged_into long")
    got = {r.id: (r.owner, r.hops) for r in graphs.canonical(chain).collect()}
    assert got == {i: (0, i) for i in range(20)}


def test_markup(spark):
    html = "<html><head><title>x</title><style>p{}</style></head><body><h1>Top</h1><p>One &amp; two</p><script>var a;</script><h3>Low</h3><ul><li>i<li>j</ul></body>"
    assert documents.text_of(html) == "x\nTop\nOne & two\nLow\ni\nj"
    md = documents.text_of(html, True)
    assert md.startswith("# Top\n\nOne & two") and "### Low" in md
    n = documents.read_nodes(md)
    assert [(x["kind"], x["level"]) for x in n if x["kind"] == "heading"] == [("heading", 1), ("heading", 2)]
    assert len({x["id"] for x in n}) == len(n)
    assert all(len(p) <= 400 for p in documents.split_body("A sentence here. " * 200))
    assert "".join(documents.split_body("x" * 1000)) == "x" * 1000


def test_tree_chunks(spark):
    docs = spark.createDataFrame([(1, "before\n\n# A\n\ntext\n\n## B\n\nmore"), (2, None)], "doc_id long, text string")
    got = {r.section_title: r for r in documents.tree_chunks(docs).collect()}
    assert got["B"].heading_chain == ["A", "B"] and got["B"].parent_id and got[""].level == 0


def test_files_frames_and_blobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"one\r\ntwo\rthree")
    got = tables.files(spark, str(tmp_path / "in")).select("sha256", tables.decoded(F.col("content")).alias("t")).first()
    assert got.t == "one\ntwo\nthree" and got.sha256 == hashlib.sha256(b"one\r\ntwo\rthree").hexdigest()
    lines = [json.dumps({"schema_version": 1, "request_id": "r", "command": "health", "params": {}}), "{broken", json.dumps({"request_id": "x", "command": "y" * (1 << 20)})]
    (tmp_path / "f.jsonl").write_text("\n".join(lines))
    assert [r.error for r in tables.frames(spark, str(tmp_path / "f.jsonl")).collect()] == [None, "INVALID_FRAME", "FRAME_TOO_LARGE"]
    blobs = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"a"),)], "content binary")
    for _ in range(2):
        assert tables.publish_blobs(blobs, str(tmp_path / "blobs")).count() == 2


def test_stream_index_runs_once_for_each_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2020-01-01 00:00:00"), (2, "2020-01-01 00:05:00")], "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        events.index_incrementally(events.source(spark, str(tmp_path / "in")), lambda b: b.select("event_id"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.fixture
def uncoalesced(spark):
    """Small data stay in several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_batches_of_one_hot_group_over_many_runs(spark, uncoalesced):
    rng = random.Random(5)
    rows = [("hot" if i % 4 else None if i % 8 else "rare", i, rng.choice([1, 5, 40, 99, 130])) for i in range(3000)]
    texts = spark.createDataFrame(rows, "source string, doc_id long, chars long")
    got = {r.doc_id: r.batch for r in planning.greedy_batches(texts, group="source", order="doc_id", batch_size=4, max_chars=100).collect()}
    state = {}
    for source, i, n in rows:
        batch, used, held = state.get(source, (0, 0, 0))
        if used and (used >= 4 or held + n > 100):
            batch, used, held = batch + 1, 0, 0
        state[source] = (batch, used + 1, held + n)
        assert got[i] == batch
    assert planning.greedy_batches(texts.filter("false"), group="source", order="doc_id", batch_size=4, max_chars=100).count() == 0


def test_exact_ranks_with_ties(spark, uncoalesced):
    rows = [("a", float(i % 7)) for i in range(501)] + [("b", 3.0)] * 9 + [("c", None)]
    data = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r["name"]): r.v for r in statistics.at_ranks(data, "g", "v", {"p95": statistics.quantile(95, 100), "first": lambda n: n * 0 + 1}).collect()}
    a = sorted(v for g, v in rows if g == "a")
    assert got == {("a", "p95"): a[-(-501 * 95 // 100) - 1], ("a", "first"): 0.0, ("b", "p95"): 3.0, ("b", "first"): 3.0}


def test_owner_of_a_long_chain_and_of_a_circle(spark):
    chain = [(i, i - 1 if i else None) for i in range(100)]
    got = {r.id: (r.owner, r.hops) for r in graphs.canonical(spark.createDataFrame(chain, "id long, merged_into long"), max_rounds=9).collect()}
    assert got == {i: (0, i) for i in range(100)}
    with pytest.raises(ValueError, match="circle"):
        graphs.canonical(spark.createDataFrame([(200, 201), (201, 200)], "id long, merged_into long"), max_rounds=4)
    with pytest.raises(ValueError, match="steps"):
        graphs.closure(spark.createDataFrame([(0,)], "root long"), spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long"), max_depth=5)


def test_digests_of_segments_whose_total_passes_64_bits(spark, tmp_path):
    from fernwood.plans import record_queries

    n = 200_000
    rows = spark.range(n).select(F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"), F.lit("MACHINERY").alias("c_mktsegment"))
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    parts = [int(hashlib.sha256(f"{i}|Customer#{i:09d}|MACHINERY".encode()).hexdigest()[:12], 16) for i in range(n)]
    assert sum(parts) > 2**63
    parity = 0
    for p in parts:
        parity ^= p
    got = record_queries.multiset_digest(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("MACHINERY", n, (sum(parts) + 2**63) % 2**64 - 2**63, parity)]
    edges = spark.createDataFrame([(1, 2**63 - 1), (1, 1), (2, -(2**63)), (2, -1), (3, 5), (3, -7), (4, None)], "k long, v long")
    assert dict(edges.groupBy("k").agg(statistics.wrapped_sum(F.col("v"))).collect()) == {1: -(2**63), 2: 2**63 - 1, 3: -2, 4: None}


def test_nodes_are_handed_on_in_parts(monkeypatch):
    """A batch of many long documents leaves a task in parts of bounded size, with every node in order."""
    import pyarrow as pa

    texts = [f"# Title {i}\n\n" + "word " * 50 + "\n\n## Below\n\n- item" for i in range(200)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(documents, "PART_CHARS", 3000)
    parts = list(documents._in_parts(documents.NODES, lambda d, t: documents._node_rows(d, t, True))(iter([batch, batch])))
    assert len(parts) > 50 and max(p.num_rows for p in parts) <= 40
    want = [r for _ in range(2) for i, t in enumerate(texts) for r in documents._node_rows(i, t or "", True)]
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == want
