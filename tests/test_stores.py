"""Objects kept once, canonical documents in JSON with their faults, budget-gated indexing, research look-ups."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.errors import AnalysisException

from fernwood.operators import canonical, planning, relations
from fernwood.sources import snapshots, tables


def test_two_writers_hold_an_object_once(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "objects")
    blobs = lambda *xs: spark.createDataFrame([(bytearray(x),) for x in xs], "content binary")
    commit, raced = snapshots.commit, []

    def late(session, folder, manifest):
        if not raced:  # another writer is quicker
            raced.append(1)
            tables.publish_blobs(blobs(b"a", b"c"), at)
        return commit(session, folder, manifest)

    monkeypatch.setattr(snapshots, "commit", late)
    assert tables.publish_blobs(blobs(b"a", b"b", b"a"), at).count() == 3
    held = tables.published(spark, at)
    assert sorted(bytes(r.content) for r in held.collect()) == [b"a", b"b", b"c"] and {r.intact for r in tables.verified(held).collect()} == {True}
    assert tables.publish_blobs(blobs(b"c"), at).count() == 3 and len(snapshots.versions(spark, at)) == 2
    monkeypatch.setattr(snapshots, "commit", lambda *a: (_ for _ in ()).throw(AnalysisException("taken")))
    with pytest.raises(AnalysisException):
        tables.publish_blobs(blobs(b"z"), at)
    assert tables.published(spark, at).count() == 3 and tables.published(spark, str(tmp_path / "none")) is None


def test_files_under_their_hash(spark, tmp_path):
    good, other = (hashlib.sha256(x).hexdigest() for x in (b"good", b"other"))
    for name, content in ((f"{good[:2]}/{good}", b"good"), (f"{other[:2]}/{other}", b"changed"), ("zz/name.txt", b"x"), (f"zz/{good}", b"good")):
        path = tmp_path / "sha256" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    got = sorted((r.path.rsplit("/sha256/", 1)[1], r.fault) for r in tables.objects_checked(spark, str(tmp_path / "sha256")).collect())
    assert got == sorted([(f"{good[:2]}/{good}", None), (f"{other[:2]}/{other}", "OBJECT_CORRUPT"), ("zz/name.txt", "INVALID_NAME"), (f"zz/{good}", "WRONG_FOLDER")])
    (tmp_path / "sha256" / "top").write_bytes(b"x")
    assert [tables.listing(spark, str(tmp_path / "sha256"), depth=d).count() for d in (0, 1, 9, None)] == [1, 5, 5, 5]


def test_documents_in_json_and_their_faults(spark, tmp_path):
    texts = [(1, "# A\n\ntext\n\n![](u.png)"), (2, "- x\n- y"), (3, "|a|\n|--|")]
    whole = canonical.documents_of(canonical.nodes(spark.createDataFrame(texts, "doc_id long, text string")))
    tables.write_canonical(whole, str(tmp_path / "canon"), "doc_id")
    back = tables.read_canonical(spark, str(tmp_path / "canon"), canonical.DOCUMENT.replace(", broken string", ""))
    assert back.count() == 3 and canonical.faults(back).count() == 0
    assert [n.kind for r in back.collect() if r.doc_id in ("1", 1) for n in r.nodes] == ["heading", "paragraph", "figure"]
    lines = ['{"doc_id":"9","schema_version":"0.9","content_hash":"sha256:xy","parser_warnings":[{"level":"error"},{"level":"loud"}],"nodes":[{"node_id":"n","parent_id":"gone","kind":"paragraph","level":0,"ordinal":1,"path":"/1","text":"t"}]}', "{broken", '{"doc_id":"9","schema_version":"1.0","content_hash":"sha256:' + "0" * 64 + '","nodes":[]}']
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("\n".join(lines))
    bad = tables.read_canonical(spark, str(tmp_path / "bad"), canonical.DOCUMENT.replace(", broken string", ""))
    got = sorted((r.doc or "", r.node_id or "", r.rule) for r in canonical.faults(bad).collect())
    assert got == sorted([("", "", "broken_json"), ("9", "", "content_hash"), ("9", "", "error_warning"), ("9", "", "repeated_document"), ("9", "", "schema_version"), ("9", "", "warning_level"), ("9", "n", "dangling_parent")])


def test_vectors_within_a_budget(spark):
    texts = spark.createDataFrame([(i, "x" * i) for i in range(1, 8)], "id long, text string")
    have = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "id long, vector array<double>")
    made = planning.index_vectors(texts, have, lambda some: [[float(len(x)), 1.0] for x in some], key="id", budget=5, dim=2)
    assert sorted((r.id, r.vector) for r in made.collect()) == [(i, [float(i), 1.0]) for i in range(3, 8)]
    with pytest.raises(ValueError, match="budget"):
        planning.index_vectors(texts, have, lambda some: some, key="id", budget=4)
    with pytest.raises(ValueError, match="anew"):
        planning.index_vectors(texts, have, lambda some: some, key="id", forbidden=texts.filter("id = 5"))
    for provider in (lambda some: [[1.0, 2.0]] * (len(some) + 1), lambda some: [[0.0, 0.0]] * len(some), lambda some: [[1.0]] * len(some), lambda some: [[float("nan"), 1.0]] * len(some)):
        with pytest.raises(Exception, match="valid"):
            planning.index_vectors(texts, have, provider, key="id", dim=2).collect()


def test_known_rows_and_research(spark):
    held = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "x")], "id long, p string, q string")
    rows = spark.createDataFrame([("a", None), ("a", "x"), (None, "x"), (None, None)], "p string, q string")
    assert {(r.p, r.q): r.id for r in relations.known(rows, held, ["p", "q"], "id").collect()} == {("a", None): 1, ("a", "x"): None, (None, "x"): 3, (None, None): None}
    revisions = spark.createDataFrame([(1, 10, "Old Finding", "2020"), (2, 10, "new finding", "2021"), (3, 11, "a finding", "2022"), (4, 12, "other", "2023"), (5, 13, "finding too", "2019")], "id long, record_id long, body string, created_at string")
    current = spark.createDataFrame([(10, 2, "claim", "p"), (11, 9, "claim", "q"), (12, 4, "claim", "p"), (13, 5, "note", None)], "record_id long, revision_id long, kind string, project string")
    assert [r.id for r in relations.research(revisions, current, "FINDING").collect()] == [2, 5, 3, 1]
    links = spark.createDataFrame([("p", 13), ("p", 13), ("z", 11)], "context string, target long")
    assert [(r.id, r.ref) for r in relations.research(revisions, current, "finding", context="p", links=links).collect()] == [(2, "ref/10/revision/2"), (5, "ref/13/revision/5"), (1, "ref/10/revision/1")]
    assert relations.research(revisions, current, "finding", context="none").count() == 0 and relations.research(revisions, current, "finding", limit=1).count() == 1
    with pytest.raises(ValueError):
        relations.research(revisions, current, "")
