"""Articles in XML, inverted pairs, identifiers, and functions registered for SQL."""

from __future__ import annotations

import random
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernwood.functions import registered
from fernwood.functions import text as T
from fernwood.operators import jats, rankings


def plain_markdown(xml):
    """By walking the whole tree."""
    root = ElementTree.fromstring(xml)
    for node in root.iter():
        node.tag = node.tag.rsplit("}", 1)[-1]
    text = lambda n: "".join(n.itertext()).strip()

    def section(node, level):
        out = ""
        for child in node:
            if child.tag in ("title", "p") and text(child):
                out += f"\n{'#' * level} {text(child)}\n" if child.tag == "title" else f"\n{text(child)}\n"
            elif child.tag == "sec":
                out += section(child, level + 1)
        return out

    title = next((text(t) for t in root.iter("article-title") if text(t)), "")
    abstract = [text(p) for a in root.iter("abstract") for p in a.iter("p") if text(p)]
    body = "".join(section(s, 2) for b in root.iter("body") for s in b if s.tag == "sec")
    return (f"# {title}\n\n" if title else "") + ("## Abstract\n\n" + "\n\n".join(abstract) + "\n" if abstract else "") + body


def random_article(rnd, depth=0):
    parts = ["<p>Words <i>in</i> &amp; <sup>2</sup> order</p>", "<p>  </p>", "<fig><caption><p>no</p></caption></fig>", "<list><list-item><p>item</p></list-item></list>", "<p>With <list><list-item>inner</list-item></list> list</p>", "<table-wrap><title>T</title></table-wrap>"]
    inner = "".join(random_article(rnd, depth + 1) if rnd.random() < 0.4 and depth < 7 else rnd.choice(parts) for _ in range(rnd.randint(0, 4)))
    return f"<sec>{rnd.choice(['<title>Some <b>title</b></title>', '<title/>', ''])}{inner}</sec>"


def test_articles_equal_walking_the_tree(spark):
    rnd = random.Random(13)
    heads = ["<article-title>A <i>title</i></article-title>", "<article-title/>", ""]
    xmls = [
        f"<article{rnd.choice(['', ' xmlns=%s' % repr('urn:jats')])}><front>{rnd.choice(heads)}<abstract><title>x</title>{'<p>Sum</p><sec><p>Part</p></sec>' * rnd.randint(0, 2)}</abstract></front>"
        f"<body><p>outside</p>{''.join(random_article(rnd) for _ in range(rnd.randint(0, 4)))}</body><back><sec><p>back</p></sec><ref><article-title>Other</article-title></ref></back></article>"
        for _ in range(120)
    ]
    xmls += ["<article/>", "<article><body><sec><p>" + "long " * 100_000 + "</p></sec></body></article>"]
    broken = ["<article><body>", "no xml", "", None, "<a>&undefined;</a>"]
    rows = list(enumerate([*xmls, *broken, xmls[0]]))
    got = {r.doc_id: r for r in jats.read(spark.createDataFrame(rows, "doc_id int, xml string").withColumn("text", F.lit("own"))).collect()}
    for i, x in rows:
        if x in broken:
            assert got[i].broken and got[i].text is None, x
        else:
            assert got[i].text == plain_markdown(x) and not got[i].broken, x[:300]
    assert jats.levels("# a\n## b\n## c\n####### d\n#e") == {1: 1, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0}


def test_inversions_equal_counting_pairs(spark, monkeypatch):
    rnd = random.Random(14)
    rows = [(i, rnd.choice([None, *range(12)]) if i % 9 == 0 else rnd.random(), float(rnd.randint(0, 40))) for i in range(400)]
    rows = [(i, None if a is None else float(a), b) for i, a, b in rows] + [(1000, 0.5, None), (1001, 0.25, 7.0), (1002, 0.25, 7.0), (1003, 0.25, 9.0)]
    valid = [(a, b) for _, a, b in rows if a is not None and b is not None]
    want = sum((x[0] - y[0]) * (x[1] - y[1]) < 0 for i, x in enumerate(valid) for y in valid[:i])
    table = spark.createDataFrame(rows, "id long, a double, b double")
    for least, runs in ((65_536, 1_024), (16, 1_024), (7, 8)):
        monkeypatch.setattr(rankings, "LEAST", least)
        monkeypatch.setattr(rankings, "RUNS", runs)
        r = rankings.inversions(table, "id", "a", "b").first()
        assert (r.pairs, r.inverted) == (len(valid) * (len(valid) - 1) // 2, want), least
    assert tuple(rankings.inversions(table, "id", "a", "a").first())[1] == 0
    assert tuple(rankings.inversions(table.filter("id = 1"), "id", "a", "b").first()) == (0, 0) == tuple(rankings.inversions(table.filter("false"), "id", "a", "b").first())
    back = rankings.inversions(table.withColumn("c", -F.col("id")), "id", "id", "c").first()
    assert back.pairs == back.inverted > 0


def test_falling_pairs_of_sequences():
    rng = np.random.default_rng(15)
    for n in (0, 1, 2, 64, 65, 1000):
        x = rng.integers(0, 50, n)
        assert rankings.count(x)[0] == sum(int((x[i] > x[i + 1 :]).sum()) for i in range(n))


def test_identifiers(spark):
    cases = [
        ("doi", "https://doi.org/10.1234/AbC", "10.1234/abc"), ("doi", "HTTPS://DOI.ORG/10.1234/x", "10.1234/x"), ("doi", "10.123/x", None), ("doi", "10.1234/a b", None), ("doi", " 10.1234/x", None), ("doi", "10.1234/", None),
        ("pmid", "123", "123"), ("pmid", "0123", None), ("pmid", "1234567890123", None), ("pmcid", "PMC12", "PMC12"), ("pmcid", "pmc12", None), ("url", "HTTP://A.b/C?d", "http://a.b/C?d"), ("url", "ftp://a.b", None), ("isbn", "1", None), ("doi", None, None), (None, "1", None), ("pmid", "", None),
    ]
    got = spark.createDataFrame([(i, s, r) for i, (s, r, _) in enumerate(cases)], "i int, scheme string, raw string").select("i", T.identifier(F.col("scheme"), F.col("raw")).alias("key")).collect()
    assert {r.i: r.key for r in got} == {i: k for i, (_, _, k) in enumerate(cases)}


def test_registered_functions(spark):
    assert registered.register(spark) == ["visible_text", "html_markdown", "jats_markdown", "text_pieces"]
    spark.createDataFrame([(1, "<h2>A</h2><script>x</script>b", "ab\n\ncdefg"), (2, None, None)], "id int, html string, text string").createOrReplaceTempView("registered_rows")
    seen = {r.id: r for r in spark.sql("SELECT id, visible_text(html) AS v, html_markdown(html) AS m, jats_markdown(html) AS j FROM registered_rows").collect()}
    assert (seen[1].v, seen[1].m, seen[1].j) == ("\nAb", "## A\n\nb", None) and (seen[2].v, seen[2].m) == ("", "")
    parts = spark.sql("SELECT id, p.* FROM registered_rows, LATERAL text_pieces(text, 3) p ORDER BY ordinal").collect()
    assert [tuple(r) for r in parts] == [(1, 0, 0, "ab"), (1, 1, 4, "cde"), (1, 2, 7, "fg")]
    with pytest.raises(Exception):  # noqa: B017 - the analyser's own
        spark.sql("SELECT text_pieces('x', 3)").collect()
