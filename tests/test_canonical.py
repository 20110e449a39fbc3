"""Canonical documents against a reader of lines one by one; every kind, precedence, and each broken rule."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from fernwood.operators import canonical

LINES = [
    "# Title *one*", "## 2.1 Methods", "#### Deep", "###### Deepest `x`", "#NoSpace", "$$E = mc^2$$", "$x+1$", "![alt text](a.png)", "![](b.png)", "[^1]: A  note.", "Table 1: Caption text", "Fig. 2. More", "figure 3 small",
    "| a | b |", "|---|---|", "| 1 | 2 |", "--- no bar", "- item  one", "2. second", "  * nested", "plain words  here", "more words", "", "", "   ", "```", "```py", "## ",
]


def squeeze(text):
    return re.sub(r"\s+", " ", text).strip()


def title_of(text):
    return squeeze(re.sub(r"[*_`~]", "", text))


def alone(pattern, kind, value, bare=True):
    """A rule of blocks of one line: how many lines it takes from the front, and what it makes of them."""

    def rule(lines):
        m = re.match(pattern, lines[0].strip(" ") if bare else lines[0])
        return (1, kind, 0, value(m)) if m else None

    return rule


def run_of(count, kind, value):
    """A rule of blocks of several lines; ``count`` says how many from the front belong to it."""

    def rule(lines):
        n = count(lines)
        return (n, kind, 0, value(lines[:n])) if n else None

    return rule


def heading_rule(lines):
    m = re.match(canonical.HEADING, lines[0])
    if not m or not title_of(m[2]):
        return None
    n = re.match(canonical.NUMBER, m[2].strip())
    return 1, "heading", len(m[1]), title_of(n[2]) if n and title_of(n[2]) else title_of(m[2])


def leading(test):
    return lambda lines: next((k for k, x in enumerate(lines) if not test(x)), len(lines))


def fence_lines(lines):
    if not re.match(canonical.FENCE, lines[0]):
        return 0
    return next((k + 1 for k, x in enumerate(lines) if k and re.match(canonical.FENCE, x)), len(lines))


def table_lines(lines):
    begins = lines[0].strip().startswith("|") and len(lines) > 1 and re.match(canonical.SEPARATOR, lines[1])
    return leading(lambda x: x.strip().startswith("|"))(lines) if begins else 0


def trimmed(lines):
    return "\n".join(x.rstrip() for x in lines)


#: Rules that also end a paragraph, and those that do not, in the order in which they are tried.
CODE = run_of(fence_lines, "code", trimmed)
FIRM = [heading_rule, alone(canonical.FORMULA, "formula", lambda m: m[1].strip()), alone(canonical.FIGURE, "figure", lambda m: m[1].strip() or "[figure]"), alone(canonical.FOOTNOTE, "footnote", lambda m: squeeze(m[2]), bare=False)]
TABLE = run_of(table_lines, "table", trimmed)
ITEMS = run_of(leading(lambda x: re.match(canonical.ITEM, x)), "list", lambda ls: "\n".join("- " + squeeze(re.match(canonical.ITEM, x)[1]) for x in ls))
LOOSE = [alone(canonical.INLINE_FORMULA, "inline_formula", lambda m: m[1].strip())], [alone(canonical.CAPTION, "caption", lambda m: squeeze(m[0]))]


def plain_blocks(text, fences=True):
    """Takes the first rule that fits what is left of the lines, again and again."""
    code = [CODE] if fences else []
    rules = [*code, *FIRM, *LOOSE[0], TABLE, *LOOSE[1], ITEMS]
    ends = [*code, *FIRM, TABLE, ITEMS]
    left, at, out = text.split("\n"), 0, []
    while left:
        if not left[0].strip(" "):
            took = (1, None, 0, "")
        else:
            took = next(filter(None, (rule(left) for rule in rules)), None)
        if took is None:
            n = next((k for k in range(1, len(left)) if not left[k].strip(" ") or any(rule(left[k:]) for rule in ends)), len(left))
            took = (n, "paragraph", 0, squeeze(" ".join(left[:n])))
        n, kind, level, body = took
        if kind:
            out.append((kind, level, at, body))
        at += sum(len(x) + 1 for x in left[:n])
        left = left[n:]
    return out


def plain_tree(blocks, text):
    """(kind, level, chain, path, char_start, text, id) with a stack of open headings."""
    out, stack, counts, seen = [], [], {}, {}
    content = hashlib.md5(text.encode()).hexdigest()
    for kind, raw, start, body in blocks:
        while raw and stack and stack[-1][0] >= raw:
            stack.pop()
        path, steps = (stack[-1][2], stack[-1][3]) if stack else ("", "")
        counts[path] = counts.get(path, 0) + 1
        occurrence = seen[steps, kind, body] = seen.get((steps, kind, body), -1) + 1
        own, step = f"{path}/{counts[path]}", f"{steps}/{kind}:{hashlib.md5(body.encode()).hexdigest()}:{occurrence}"[0 if steps else 1 :]
        full = hashlib.sha256("\0".join((content, step, kind, body)).encode()).hexdigest()
        out.append((kind, len(stack) + 1 if raw else 0, [s[1] for s in stack], own, start, body, "nd_" + full[:12], stack[-1][4] if stack else None))
        if raw:
            stack.append((raw, body, own, step, "nd_" + full[:12]))
    return out


def got_tree(rows):
    return [(r.kind, r.level, r.heading_chain, r.path, r.char_start, r.text, r.node_id, r.parent_id) for r in sorted(rows, key=lambda r: r.ordinal)]


@pytest.mark.parametrize("fences", [True, False])
def test_markdown_equals_reading_line_by_line(spark, fences):
    rnd = random.Random(11)
    texts = ["\n".join(rnd.choices(LINES, k=rnd.randint(0, 25))) for _ in range(150)] + ["", "```\nnever closed\n# x", "# a\n# a\n\nsame\n\nsame\n# a\n\nsame", "word " * 50_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = canonical.nodes(spark.createDataFrame(rows, "doc_id int, text string").withColumns({"row": F.lit("own"), "kind": F.lit(1), "at": F.lit(2)}), fences=fences).collect()
    for i, t in rows:
        assert got_tree([r for r in found if r.doc_id == i]) == plain_tree(plain_blocks(t, fences), t), t


def test_kinds_and_attributes(spark):
    text = "\n".join(["# 1.2 Big *idea*", "", "Intro words", "Table 9 is inside", "$also$", "", "Table 1. Alone", "$a+b$", "$$c$$", "![](u.png)", "[^n]: note", "|h|", "|--|", "|r|", "- a", "1. b", "", "|not a table|"])
    rows = {r.ordinal: r for r in canonical.nodes(spark.createDataFrame([(1, text), (None, None), (1, text)], "doc_id long, text string").limit(1)).collect()}
    assert [rows[i].kind for i in sorted(rows)] == ["heading", "paragraph", "caption", "inline_formula", "formula", "figure", "footnote", "table", "list", "paragraph"]
    assert rows[1].sec_num == "1.2" and rows[1].text == "Big idea" and rows[2].text == "Intro words Table 9 is inside $also$"
    assert rows[3].attrs == {"label": "Table 1.", "ref": "Table 1."} and rows[5].attrs == {"latex": "c", "display": "true"} and rows[4].attrs["display"] == "false"
    assert rows[6].attrs == {"alt": "", "uri": "u.png"} and rows[6].text == "[figure]" and rows[7].attrs["ref"] == "n" and rows[9].attrs["markdown"] == "- a\n1. b"


def test_plain_text_and_odd_rows(spark):
    text = "Title line\n\nAbstract:\nWords of it\ngo on.\n2.1 Study design of all\nMore\n\n3 too.short\nRESULTS\n"
    rows = [(1, text), (1, text), (None, "only"), (2, None), (3, " \n\t\n")]
    got = canonical.nodes(spark.createDataFrame(rows, "doc_id long, text string"), markdown=False).collect()
    one = [[(r.kind, r.level, r.sec_num, r.text) for r in sorted((x for x in got if x.row == row), key=lambda r: r.ordinal)] for row in {r.row for r in got if r.doc_id == 1}]
    assert one == [[("paragraph", 0, None, "Title line"), ("heading", 1, None, "Abstract"), ("paragraph", 0, None, "Words of it go on."), ("heading", 2, "2.1", "Study design of all"), ("paragraph", 0, None, "More"), ("paragraph", 0, None, "3 too.short"), ("heading", 1, None, "RESULTS")]] * 2
    assert [(r.text, r.path) for r in got if r.doc_id is None] == [("only", "/1")] and not [r for r in got if r.doc_id in (2, 3)]


def test_broken_trees(spark):
    texts = [(i, "# A\n\ntext\n## B\n\n|a|\n|--|\n- x\n$$f$$\n![](u)") for i in range(3)]
    sound = canonical.nodes(spark.createDataFrame(texts, "doc_id long, text string"))
    assert canonical.broken(sound).count() == 0
    shape = "doc_id long, node_id string, parent_id string, kind string, level long, ordinal long, path string, text string, attrs map<string,string>"
    ok = {"markdown": "m"}
    rows = [
        (1, "a", None, "heading", 1, 1, "/1", "A", {}), (1, "b", "a", "paragraph", 0, 2, "/1/1", "t", {}),  # sound
        (2, "a", "gone", "paragraph", 0, 1, "/1", "t", {}),
        (3, "a", "b", "heading", 1, 1, "/1", "A", {}), (3, "b", "a", "heading", 2, 2, "/1/1", "B", {}),  # a circle
        (4, "a", None, "heading", 1, 1, "/1", "A", {}), (4, "a", None, "paragraph", 0, 2, "/2", "t", {}),
        (5, "a", None, "heading", 7, 1, "/1", "A", {}), (5, "b", "a", "paragraph", 2, 2, "/9/1/1", "t", {}),
        (6, "a", None, "table", 0, 1, "/1", "no bars", ok), (6, "b", None, "list", 0, 2, "/1", "- a\nb", {}), (6, "c", None, "verse", 0, 2, "/3", "t", {}),
        (7, "a", None, "formula", 0, 1, "/1", "x", {}), (7, "b", None, "figure", 0, 2, "/2", "x", {"alt": ""}), (7, "c", None, "caption", 0, 3, "/3", "", {}), (7, "d", None, "heading", 1, 4, "/4", "", None), (7, "e", "e", "paragraph", 0, 5, "/4/1", "t", {}),
        (8, "a", "b", "paragraph", 0, 1, "/1/1", "t", {}), (8, "b", None, "heading", 1, 2, "/1", "B", {}),
    ]
    got = {(r.doc, r.node_id, r.rule) for r in canonical.broken(spark.createDataFrame(rows, shape)).collect()}
    assert got == {
        (2, "a", "dangling_parent"), (3, "a", "circle"), (3, "b", "circle"), (3, "a", "parent_after_child"), (3, "a", "path_of_parent"), (4, "a", "repeated_id"), (5, "a", "heading_level"), (5, "b", "block_level"), (5, "b", "path_of_parent"),
        (6, "a", "table_markdown"), (6, "b", "list_lines"), (6, "c", "unknown_kind"), (6, "a", "repeated_path"), (6, "b", "repeated_path"), (6, "b", "repeated_ordinal"), (6, "c", "repeated_ordinal"),
        (7, "a", "formula_attrs"), (7, "b", "figure_attrs"), (7, "c", "empty_note"), (7, "d", "heading_title"), (7, "e", "circle"), (7, "e", "parent_after_child"), (7, "e", "path_of_parent"), (8, "a", "parent_after_child"),
    }


def test_chunks_know_their_relatives(spark):
    text = "before\n\n# A\n\n" + "Sentence one. " * 60 + "\n\n## 1.1 B\n\n## C\n\nshort\n\n- x\n- y\n### D\n\nd\n# A\n"
    found = canonical.chunks(canonical.nodes(spark.createDataFrame([(7, text), (7, "only words"), (8, "")], "doc_id long, text string"))).collect()
    rows = [r for r in found if r.row == max((x.row for x in found if x.section_title), default=0)]
    first = {r.section_title + r.path: r for r in rows if r.part == 1}
    a, b, c, d, last, pre = (first[k] for k in ("A/2", "B/2/2", "C/2/3", "D/2/3/3", "A/3", ""))
    assert pre.text == "before" and pre.level == 0 and pre.parent_id is None and not pre.child_ids and not pre.sibling_ids and pre.chunk_id == "7__preface__p1"
    assert a.child_ids == [b.chunk_id, c.chunk_id] and a.sibling_ids == [last.chunk_id] and last.child_ids == [] and a.chunk_id != last.chunk_id
    assert c.child_ids == [d.chunk_id] and b.sibling_ids == [c.chunk_id] and d.parent_id == c.chunk_id and b.parent_id == a.chunk_id and (b.section_number, b.text, b.char_count) == ("1.1", "", 0)
    assert d.heading_chain == ["A", "C", "D"] and d.level == 3 and c.text == "short\n\n- x\n- y"
    parts = [r for r in sorted(rows, key=lambda r: r.part) if r.path == "/2"]
    assert [r.part for r in parts] == [1, 2, 3] and all(r.char_count == len(r.text) <= 400 for r in parts) and "".join(r.text for r in parts).replace(" ", "") == "Sentenceone." * 60
    assert [(r.text, r.chunk_id) for r in found if r.row not in (pre.row,)] == [("only words", "7__preface__p1")]
    assert len({r.chunk_id for r in rows}) == len(rows)


# --- located chunks ----------------------------------------------------------------------------------------------


def plain_located(text):
    """Line by line: (ordinal, start, end, heading, text)."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out, chain, position, fenced = [], [], 0, False
    for line in text.splitlines(keepends=True):
        fenced ^= line.lstrip().startswith("```")
        head = re.match(r"^(#{1,6})\s+(.+)", line)
        if head and not fenced:
            chain = [*chain[: len(head[1]) - 1], head[2].strip()[:500]]
        for at in range(0, len(line), 800):
            if line[at : at + 800].strip():
                out.append((len(out), position + at, position + at + len(line[at : at + 800]), list(chain), line[at : at + 800]))
        position += len(line)
    return out


def test_located_chunks(spark, monkeypatch):
    rnd = random.Random(12)
    parts = ["### Deep first", "## Then up\t", "# Top", "```", "text", "", "  \t", "x" * 1700, "a\x0bb", "c\x0cd", "e\x1cf", "g\x85h", "i j", "k l", "# in\r", "m\r\nn", "## " + "t" * 600, "é" * 801, "\x1f\x1e"]
    texts = ["\n".join(rnd.choices(parts, k=rnd.randint(1, 14))) for _ in range(120)] + ["one line", "ends\n", "\n\nlate"]
    rows = [(i, t, [(0, 5, 1), (5, 900, 2)]) for i, t in enumerate(texts)]
    table = spark.createDataFrame([*rows, (900, None, None), (901, " \n\x1f", None)], "doc_id long, text string, pages array<struct<start:long,end:long,number:int>>")
    found = canonical.located(table, pages="pages").collect()
    for i, t, _ in rows:
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.ordinal or 0)
        want = plain_located(t)
        if not want:
            assert [r.error for r in own] == ["PARSE_EMPTY"], ascii(t)
            continue
        assert [(r.ordinal, r.char_start, r.char_end, r.heading, r.text) for r in own] == want, ascii(t)
        assert all(r.page == (1 if r.char_start < 5 else 2 if r.char_start < 900 else None) for r in own)
        assert {r.canonical_hash for r in own} == {hashlib.sha256(t.replace("\r\n", "\n").replace("\r", "\n").encode()).hexdigest()}
    assert sorted((r.doc_id, r.error) for r in found if r.doc_id >= 900) == [(900, "PARSE_EMPTY"), (901, "PARSE_EMPTY")]
    monkeypatch.setattr(canonical, "MOST_CHUNKS", 3)
    few = canonical.located(spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc\nd")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.error or r.text.strip()) for r in few) == [(1, "a"), (1, "b"), (1, "c"), (2, "PARSER_LIMIT")]


def test_located_chunks_of_long_texts(spark):
    """Texts of more than 10,000 chunks are cut whole, with their chains of titles: many lines, many headings, one long line."""
    rnd = random.Random(4)
    headed = "\n".join("#" * rnd.randint(1, 6) + f" T{i}" if i % 3 == 0 else "```" if i % 500 == 1 else "words" for i in range(12_000))
    texts = ["x\n" * 10_000, "x\n" * 10_001, headed, "z" * 800 * 10_001]
    found = canonical.located(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert not [r for r in found if r.error]
    for i, t in enumerate(texts):
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.ordinal)
        assert [(r.ordinal, r.char_start, r.char_end, r.heading, r.text) for r in own] == plain_located(t)


def test_located_chunks_read_texts_once(spark):
    """Texts are cut into lines for one written table; chunks, chains of titles and limits all come from it."""
    docs = spark.createDataFrame([(1, "# A\ntext\n"), (2, "plain\n\n" + "y" * 900), (3, "```\n# no\n```\n## B\nz")], "doc_id long, text string")
    found = canonical.located(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f"{f}(whole" in plan for f in ("regexp_extract_all", "split"))
    assert sorted((r.doc_id, r.ordinal, tuple(r.heading), r.char_start, len(r.text)) for r in found.collect()) == [
        (1, 0, ("A",), 0, 4), (1, 1, ("A",), 4, 5), (2, 0, (), 0, 6), (2, 1, (), 7, 800), (2, 2, (), 807, 100), (3, 0, (), 0, 4), (3, 1, (), 4, 5), (3, 2, (), 9, 4), (3, 3, ("B",), 13, 5), (3, 4, ("B",), 18, 1),
    ]


def test_nodes_are_sorted_few_times(spark):
    """Each sort holds a task's lines or nodes at once; runs of lines and short ids need none of their own."""
    docs = spark.createDataFrame([(1, "# A\n| a |\n|---|\n| b |\n\nFigure 1. x\nplain\nTable 2. y")], "doc_id long, text string")
    found = canonical.nodes(docs)
    sorts = found._jdf.queryExecution().executedPlan().toString().count("Sort [")
    assert 0 < sorts <= 8
    assert [(r.kind, r.text) for r in found.orderBy("ordinal").collect()] == [("heading", "A"), ("table", "| a |\n|---|\n| b |"), ("caption", "Figure 1. x"), ("paragraph", "plain Table 2. y")]
