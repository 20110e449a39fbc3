"""The kept index and the packed vectors: edits, deletions, compaction, pruning, corruption; against scoring everything."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernwood.operators import artefact, index, search
from fernwood.sources import snapshots

PLAIN = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def plain_scores(rows, query, hits):
    """BM25 (and substring hits) of every unit, by reading all texts."""
    units = [(i, re.findall(r"\w+", (t or "").lower().translate(PLAIN)), (t or "").lower()) for i, t in rows]
    n, average = len(units), (sum(len(w) for _, w, _ in units) / len(units) if units else 0) or 1.0
    terms = re.findall(r"\w+", query.lower())
    out, frequency = {}, {t: sum(t in w for _, w, _ in units) for t in terms}
    for key, words, low in units:
        score = float(sum(t in low for t in terms)) if hits else 0.0
        for t in terms:
            df, tf = frequency[t], words.count(t)
            if df:
                score += max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / average))
        if score > 0:
            out[key] = score
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def close(got, want):
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


def check(ix, rows, *queries):
    assert ix.n == len(rows)
    for q in queries:
        close({r.id: r.score for r in index.matches(ix, q).collect()}, plain_scores(rows, q, True))
        full = plain_scores(rows, q, False)
        want = sorted(full, key=lambda k: (-round(full[k], 12), k))[:5]
        assert [r.id for r in index.topk(ix, q, 5).rows.collect()] == want


def test_index_follows_edits_and_deletions(spark, tmp_path):
    at = str(tmp_path / "index")
    rows = {1: "apple tree", 2: "pear tree café", 3: None, 4: "", 5: "apple apple pie", 6: "the grapes"}
    queries = ("grape apple tree apple", "ape cafe")

    def now():
        return index.kept(frame(spark, list(rows.items())), at=at)

    first = now()
    check(first, list(rows.items()), *queries, "nothing", "")
    rows[1] = "grape tree"  # an edit of the same length
    second = now()
    check(second, list(rows.items()), *queries)
    assert [s["n"] for s in second.manifest["segments"]] == [6, 1]  # only the edited row was read into a segment
    del rows[5]
    rows[9] = "apple"
    rows[3] = "late text"
    third = now()
    check(third, list(rows.items()), *queries)
    assert third.manifest["segments"][-1]["n"] == 2 or len(third.manifest["segments"]) == 1
    close({r.id: r.score for r in index.matches(first, "apple").collect()}, plain_scores([(1, "apple tree"), (2, "pear tree café"), (3, None), (4, ""), (5, "apple apple pie"), (6, "the grapes")], "apple", True))  # an open version stays
    assert now().manifest["segments"] == third.manifest["segments"]  # nothing changed, nothing written
    again = index.compacted(third)
    assert len(again.manifest["segments"]) == 1 and again.manifest["lost"] == 0
    check(again, list(rows.items()), *queries)
    assert snapshots.vacuum(spark, at, keep=1) > 0 and index.topk(now(), "apple", 5).rows.count() == 1


def test_index_of_equal_lengths_and_repeated_owners(spark, tmp_path):
    rows = [(1, "same word"), (1, "same word"), (2, "other one"), (None, "no key word")]
    ix = index.kept(frame(spark, rows), at=str(tmp_path / "a"))
    assert ix.n == 4 and sorted(r.id or 0 for r in index.matches(ix, "word").collect()) == [0, 1, 1]
    ix = index.kept(frame(spark, [*rows[1:], (3, "word")]), at=str(tmp_path / "a"))  # one of two equal rows goes
    assert ix.n == 4 and sorted(r.id or 0 for r in index.matches(ix, "word").collect()) == [0, 1, 3]
    other = index.kept(frame(spark, [(1, "drow emas")]), at=str(tmp_path / "b"))
    assert index.matches(other, "word").count() == 0  # a table of equal keys and lengths has its own index
    empty = index.kept(frame(spark, []), at=str(tmp_path / "c"))
    assert empty.n == 0 and index.matches(empty, "word").count() == 0 and index.topk(empty, "word", 3).rows.count() == 0


def test_many_small_changes_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MOST_SEGMENTS", 3)
    rnd = random.Random(3)
    rows = {i: " ".join(rnd.choices("red green blue été ete rouge vert".split(), k=rnd.randint(0, 9))) for i in range(40)}
    for step in range(4):
        for i in rnd.sample(sorted(rows), 3):
            rows[i] = " ".join(rnd.choices("red green noir ete été".split(), k=4))
        rows[100 + step] = "green step"
        ix = index.kept(frame(spark, list(rows.items())), at=str(tmp_path / "many"))
        assert len(ix.manifest["segments"]) <= 3
        check(ix, list(rows.items()), "green ete")


def test_unchanged_files_are_not_read_again(spark, tmp_path):
    frame(spark, [(i, f"alpha{i % 7} beta beta gamma") for i in range(300)]).write.parquet(str(tmp_path / "docs"))

    def docs():
        return spark.read.parquet(str(tmp_path / "docs")).select("doc_id", "text")

    first = index.kept(docs(), name="files")
    assert snapshots.state(docs()) == first.manifest["state"] is not None
    assert index.kept(docs(), name="files").manifest["version"] == first.manifest["version"] == 1
    frame(spark, [(900, "delta")]).write.mode("append").parquet(str(tmp_path / "docs"))
    grown = index.kept(docs(), name="files")
    assert grown.n == 301 and [s["n"] for s in grown.manifest["segments"]] == [300, 1]
    plan = index.topk(first, "alpha3 beta", 5).rows._jdf.queryExecution().toString()
    assert "text" not in plan
    own = first.postings().filter(F.col("term").isin("alpha3", "beta"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in own


def test_blocks_that_cannot_reach_the_best_are_skipped(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(["common", "filler", "other", f"w{i % 50}"], k=rnd.choice([4, 30, 200])) + ["rare"] * (i % 997 == 5))) for i in range(6000)]
    ix = index.kept(frame(spark, rows).repartition(4), at=str(tmp_path / "wide"))
    for query in ("rare common", "w7 filler", "common"):
        found = index.topk(ix, query, 5)
        full = plain_scores(rows, query, False)
        want = sorted(((float(f"{s:.9e}"), -k) for k, s in full.items()), reverse=True)[:5]
        assert [(float(f"{r.score:.9e}"), -r.id) for r in found.rows.collect()] == want
        assert 0 < found.read < 0.7 * found.blocks, query


def test_search_over_the_index_equals_a_scan(spark, tmp_path):
    rnd = random.Random(5)
    docs = frame(spark, [(i, "\n".join(" ".join(rnd.choices("needle filler hay stack".split(), k=6)) for _ in range(i % 9))) for i in range(40)])
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    flags = docs.select(F.col("doc_id").alias("version_id"), (F.col("doc_id") % 2 == 0).alias("formal"), (F.col("doc_id") % 3 == 0).alias("preferred"))
    vectors = spark.createDataFrame([(f"{i}:0", [1.0, i / 40]) for i in range(40)], "chunk_id string, vector array<double>")
    pieces = search.chunks(docs).join(flags.withColumnRenamed("version_id", "doc_id"), "doc_id").select(search.chunk_key("doc_id", "ordinal").alias("chunk_id"), F.col("doc_id").alias("version_id"), "text", "formal", "preferred")
    want = search.hybrid(pieces, vectors, "needle", [1.0, 0.2], budget=30, top_k=6).collect()
    from fernwood.functions import vectors as V

    near = vectors.select("chunk_id", V.cosine(F.col("vector"), V.literal([1.0, 0.2])).alias("score"))
    found = search.lists(search.chunk_index(docs), flags, "needle", near, budget=30)
    got = search.page(found, docs, top_k=6).orderBy("position").collect()
    assert [(r.position, r.chunk_id, r.rrf) for r in got] == [(r.position, r.chunk_id, r.rrf) for r in want] and all("needle" in r.text or r.vector_score for r in got)
    facts = search.diagnostics(found, spark.range(0), top_k=6).first()
    assert facts.eligible == pieces.count() and facts.lexical_list_cut and facts.vector_list_cut and facts.best_discarded >= round(2 / 90, 9)
    assert search.diagnostics(search.lists(search.chunk_index(docs), flags, "absent", None), spark.range(1)).first().status == "processing_incomplete"
    assert search.diagnostics(search.lists(search.chunk_index(docs), flags, "absent", None), spark.range(0)).first().status == "no_matching_results"


# --- packed vectors ----------------------------------------------------------------------------------------------

SHAPE = "vec_id long, embedding array<double>"


def vectors(n=30, dim=4):
    return [(i, [math.sin(i + axis) + 1.1 for axis in range(dim)]) for i in range(n)]


@pytest.fixture
def stored(spark, tmp_path):
    at = str(tmp_path / "vectors")
    spark.createDataFrame(vectors(), SHAPE).write.parquet(at)
    return at


def test_packed_scores_equal_the_source(spark, tmp_path, stored):
    source, folder, query = spark.read.parquet(stored), str(tmp_path / "copy"), [0.3, -0.2, 0.9, 0.1]
    plain, status = artefact.scores(source, folder, query)
    assert status == artefact.UNAVAILABLE and artefact.verify(source, folder) == artefact.UNAVAILABLE
    manifest = artefact.build(source, folder, 4)
    assert (manifest["count"], manifest["bytes"], manifest["refused"]) == (30, 480, 0) and artefact.build(source, folder, 4)["version"] == 1
    got, status = artefact.scores(source, folder, query)
    assert status == artefact.SCAN == artefact.verify(source, folder)
    close({r.key: r.score for r in got.collect()}, {r.key: r.score for r in plain.collect()})
    rows = spark.read.parquet(f"{folder}/{manifest['path']}").collect()
    assert {r.key: list(np.frombuffer(r.packed, "<f4")) for r in rows} == {i: [np.float32(x) for x in v] for i, v in vectors()}
    assert artefact.build(source, folder, 4, force=True)["version"] == 2


def test_stale_corrupt_and_broken_copies_fall_back(spark, tmp_path, stored):
    folder, query = str(tmp_path / "copy"), [1.0, 0.0, 0.0, 0.5]
    path = artefact.build(spark.read.parquet(stored), folder, 4)["path"]
    spark.createDataFrame([(99, [2.0, 0.0, 0.0, 1.0])], SHAPE).write.mode("append").parquet(stored)
    source = spark.read.parquet(stored)
    assert artefact.opened(source, folder).status == artefact.STALE == artefact.verify(source, folder)
    best, status = artefact.best(source, folder, query, 1)
    assert (best.first().key, status) == (99, artefact.STALE)
    path = artefact.build(source, folder, 4)["path"]
    assert artefact.best(source, folder, query, 1)[1] == artefact.SCAN
    part = next((tmp_path / "copy" / path).glob("part-*.parquet"))
    whole = part.read_bytes()
    part.write_bytes(whole + b"x")
    best, status = artefact.best(source, folder, query, 1)
    assert (best.first().key, status) == (99, artefact.CORRUPT) and artefact.verify(source, folder) == artefact.CORRUPT
    for f in (tmp_path / "copy" / path).iterdir():
        f.unlink()
    assert artefact.best(source, folder, query, 1)[1] == artefact.CORRUPT


def test_vectors_that_are_refused(spark, tmp_path):
    odd = [(100, None), (101, [1.0, 2.0]), (102, [0.0] * 4), (103, [math.nan, 1.0, 1.0, 1.0]), (104, [math.inf, 1.0, 1.0, 1.0]), (105, [1e300, 1.0, 1.0, 1.0]), (106, [1e-60] * 4), (107, [None, 1.0, 1.0, 1.0]), (108, [])]
    source = spark.createDataFrame(vectors() + odd, SHAPE)
    assert artefact.build(source, str(tmp_path / "copy"), 4)["refused"] == len(odd)
    a, b = (dict((r.key, r.score) for r in artefact.scores(source, str(tmp_path / x), [1.0, 2.0, 3.0, 4.0])[0].collect()) for x in ("copy", "none"))
    close(a, b)
    for rows in ([], vectors(2) + vectors(1), [(None, [1.0] * 4)]):
        with pytest.raises(ValueError):
            artefact.build(spark.createDataFrame(rows, SHAPE), str(tmp_path / "bad"), 4)
    with pytest.raises(ValueError):
        artefact.scores(source, str(tmp_path / "copy"), [0.0] * 4)


def test_codec_round_trip():
    import pyarrow as pa

    rows = np.array([[1.5, -0.0, 3.4e38], [1e-45, 2, 3]], "<f4")
    assert (artefact.unpacked(pa.array([r.tobytes() for r in rows]), 3) == rows).all()
    for broken in ([b"123"], [None], [rows[0].tobytes() + b"x"], [np.array([np.nan, 0, 0], "<f4").tobytes()], [np.array([np.inf, 0, 0], "<f4").tobytes()]):
        with pytest.raises(ValueError):
            artefact.unpacked(pa.array(broken, pa.binary()), 3)


@pytest.mark.parametrize("most", [1, 1 << 24])
def test_blocks_are_folded_where_their_words_are(most):
    """Spans that run over batches, and those closed before their end, hold each word of each unit with its count and mark."""
    import pyarrow as pa

    rnd = random.Random(8)
    rows = [(u, " ".join(rnd.choices(["a", "b", "été", f"w{u}"], k=rnd.randint(1, 9)))) for u in sorted(rnd.sample(range((3 << 33), (3 << 33) + 600), 300))]
    columns = [[u for u, _ in rows], [x.count(" ") + 1 for _, x in rows], [x for _, x in rows], [1] * len(rows)]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["uid", "n_words", "line", "tf"])
    got, marked = {}, {}
    blocks = [r for b in index._blocks(5.0, most)(whole.slice(i, 70) for i in range(0, 300, 70)) for r in b.to_pylist()]
    for r in blocks:
        assert r["n"] == len(r["places"]) <= 128 and r["top"] == max(t * 2.2 / (t + 1.2 * (0.25 + 0.75 * n / 5.0)) for t, n in zip(r["tfs"], r["lengths"], strict=True))
        assert {p for p in range(128) if ((r["high"] if p > 63 else r["low"]) >> (p & 63)) & 1} == set(r["places"])
        for p, t, n in zip(r["places"], r["tfs"], r["lengths"], strict=True):
            uid = r["span"] * 128 + p
            got[uid, r["word"]] = got.get((uid, r["word"]), 0) + t
            marked[uid] = n
    assert got == {(u, w): x.split().count(w) for u, x in rows for w in x.split()}
    assert marked == {u: x.count(" ") + 1 for u, x in rows}
    assert len({(r["span"], r["word"]) for r in blocks}) == len(blocks) or most == 1


def test_an_index_of_another_format_is_built_anew(spark, tmp_path):
    at = str(tmp_path / "old")
    snapshots.commit(spark, at, {"version": 4, "segments": [{"seg": 1, "path": "segment-gone", "n": 9, "words": 9, "average": 1.0, "dead": 0}], "n": 9, "words": 9, "lost": 0, "state": "x"})
    ix = index.kept(frame(spark, [(1, "apple"), (2, "")]), at=at)
    assert (ix.n, ix.manifest["version"]) == (2, 5) and [r.id for r in index.matches(ix, "apple").collect()] == [1]


@pytest.mark.parametrize("most", [1, 40, 1 << 24])
def test_a_word_is_one_row_of_its_run(most):
    """A task may read files in any order: runs end where units fall or leap, no unit is lost, and rows are in the order of terms."""
    import pyarrow as pa

    rnd = random.Random(9)
    starts = [5 << 33, 2 << 33, (2 << 33) + 64, 7 << 33]  # falls, goes on, leaps
    units = [(s + i, " ".join(rnd.choices(["zoo", "été", "eta", "etf", f"w{i}"], k=rnd.randint(1, 6)))) for s in starts for i in range(64)]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in ([u for u, _ in units], [x.count(" ") + 1 for _, x in units], [x for _, x in units], [1] * len(units))], ["uid", "n_words", "line", "tf"])
    rows = [r for b in index._rows(4.0, most)(whole.slice(i, 50) for i in range(0, len(units), 50)) for r in b.to_pylist()]
    got = [((r["base"] + u, r["word"]), (tf, n)) for r in rows for u, tf, n in zip(r["units"], r["tfs"], r["lengths"], strict=True)]
    assert len(dict(got)) == len(got) and dict(got) == {(u, w): (x.split().count(w), x.count(" ") + 1) for u, x in units for w in x.split()}
    for r in rows:
        assert [(r["base"] >> 7) + s for s in r["spans"]] == sorted({(r["base"] + u) >> 7 for u in r["units"]})
        for s, top in zip(r["spans"], r["tops"], strict=True):
            assert top == max(t * 2.2 / (t + 1.2 * (0.25 + 0.75 * n / 4.0)) for u, t, n in zip(r["units"], r["tfs"], r["lengths"], strict=True) if (r["base"] + u) >> 7 == (r["base"] >> 7) + s)
    bases = {r["base"] for r in rows}
    assert most < 1 << 24 or len(bases) == 3
    for base in bases:
        terms = [r["word"].translate(PLAIN) for r in rows if r["base"] == base]
        assert terms == sorted(terms) and len(terms) == len({r["word"] for r in rows if r["base"] == base})


def test_posting_rows_grow_with_words_and_not_with_spans(spark, tmp_path, monkeypatch):
    """Rows for every word of every span had to be sorted by Spark, which spilled on larger tables."""
    rows = [(i, f"the été of {'ete ' * (i % 3)}thing w{i % 40}") for i in range(1500)]
    queries = ("the ete", "thing w7 été", "w3")
    ix = index.kept(frame(spark, rows).coalesce(1), at=str(tmp_path / "one"))
    stored = spark.read.parquet(f"{ix.folder}/{ix.manifest['segments'][0]['path']}/postings")
    assert stored.count() == 45 < index.Index.blocks(ix).count()  # the words of one run, each in twelve spans
    check(ix, rows, *queries)
    monkeypatch.setattr(index, "MOST_HELD", 2000)  # many runs
    many = index.kept(frame(spark, rows).repartition(3), at=str(tmp_path / "many"))
    check(many, rows, *queries)
    left = [(i, t) for i, t in rows if i % 5]
    less = index.kept(frame(spark, left), at=str(tmp_path / "many"))  # dead units in many runs
    check(less, left, *queries)
    check(index.compacted(less), left, *queries)
