"""Markup and structure of single documents: visible text, markdown, nodes, and heading-tree chunks.

Headings, lists and size limits are read in order, so one document is one unit of work in Arrow batches; documents are
spread over tasks as the source has them and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

CAP = 400  # characters of a tree chunk
PART_CHARS = 1 << 20  # about the characters of rows that a task hands on at once
BREAKS = frozenset(("p", "br", "div", "h1", "h2", "h3", "li"))
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*$")


HIDDEN = frozenset(("script", "style"))
CHROME = HIDDEN | {"head", "nav", "footer"}
PART = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)(?:"[^"]*"|'[^']*'|[^'">])*>?|([^<]+|<)""", re.S | re.I)


def text_of(html: str | None, markdown: bool = False) -> str:
    """Text outside of scripts and styles with a newline before block tags; with ``markdown``, headings, paragraphs and list items of the body."""
    out: list[str] = []
    hidden: list[str] = []  # open tags whose text does not count
    for hit in PART.finditer(html or ""):
        raw, end, name, text = hit.groups()
        if text is not None:
            if not hidden:
                out.append(unescape(text))
            continue
        if name is None or raw:
            continue
        tag = name.lower()
        if markdown and tag in CHROME:
            if not end:
                hidden.append(tag)
            elif tag in hidden:
                del hidden[len(hidden) - 1 - hidden[::-1].index(tag) :]
        elif not end:
            out.append(_opening(tag, markdown))
        elif markdown and tag in ("h1", "h2", "h3", "p", "article"):
            out.append("\n\n")
    whole = "".join(out)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", whole)).strip() if markdown else whole


def _opening(tag: str, markdown: bool) -> str:
    """What stands for an opening tag."""
    if not markdown:
        return "\n" if tag in BREAKS else ""
    if re.fullmatch("h[1-6]", tag):
        return "\n\n" + "#" * int(tag[1]) + " "
    return "\n- " if tag == "li" else "\n\n" if tag in BREAKS else ""


def visible_text(pages: DataFrame) -> DataFrame:
    """page_id, text: all text outside scripts and styles, with newlines before block tags."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"page_id": p.page_id, "text": [text_of(h) for h in p.html]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")


def markdown_of(pages: DataFrame) -> DataFrame:
    """doc_id, text: pages as markdown."""
    fields = "doc_id long, text string"
    return pages.select("page_id", "html").mapInArrow(_in_parts(fields, lambda page, html: [(page, text_of(html, True))]), fields)


FENCE = re.compile(r"\s{0,3}```")
LIST = re.compile(r"\s*([-*+]|\d+\.)\s")
#: Lines that are headings in plain text, beside numbered ones.
SECTIONS = frozenset("abstract introduction background methods materials results discussion conclusion conclusions references acknowledgements acknowledgments".split())
NUMBERED = re.compile(r"^(\d+(?:\.\d+)*)\.?\s+([A-Z].{0,80})$")


def markdown_heading(line: str) -> tuple[int, str] | None:
    head = HEADING.match(line)
    return (len(head[1]), head[2]) if head else None


def plain_heading(line: str) -> tuple[int, str] | None:
    """Level and title of a line of plain text that is a section's name, numbered, or in capitals."""
    line = line.strip()
    number = NUMBERED.match(line)
    if number and line[-1] not in ".,;":
        return number[1].count(".") + 1, line
    if line.lower().rstrip(":") in SECTIONS or (line.isupper() and 4 <= len(line) <= 80 and not line.endswith(".")):
        return 1, line
    return None


def grouped_lines(text: str, heading: Callable[[str], tuple[int, str] | None], markdown: bool) -> Iterator[tuple[str, int, list[str], tuple[int, str] | None]]:
    """(kind, start, lines, heading) of runs of lines of one kind; blank lines end runs but for those of fenced code, headings stand alone."""
    held: tuple | None = None
    fenced, at = False, 0
    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        fence = markdown and FENCE.match(line) is not None
        head = None if fenced or fence else heading(line)
        if fenced or fence:
            kind = "code"
        elif not line.strip():
            kind = ""
        elif head:
            kind = "heading"
        elif markdown and LIST.match(line):
            kind = "list"
        else:
            kind = "table" if markdown and line.startswith("|") else "paragraph"
        opens = fence and not fenced
        if held and (kind != held[0] or kind == "heading" or opens):
            yield held
            held = None
        if kind:
            if held:
                held[2].append(line)
            else:
                held = (kind, start, [line], head)
        if fence:
            fenced = not fenced
    if held:
        yield held


def read_nodes(text: str, *, markdown: bool = True) -> list[dict]:
    """Headings, lists, code, tables and paragraphs in order, with level, parent and path; skipped heading levels close up.

    Ids are hashes of the document's content, path, kind and text, longer where they would repeat.
    """
    out: list[dict] = []
    chain: list[dict] = []
    children: dict[int, int] = {}
    for kind, start, rows, head in grouped_lines(text, markdown_heading if markdown else plain_heading, markdown):
        level, body = 0, "\n".join(rows)
        if head:
            while chain and chain[-1]["depth"] >= head[0]:
                chain.pop()
            level, body = len(chain) + 1, head[1]
        parent = chain[-1] if chain else None
        siblings = children.get(id(parent), 0)
        children[id(parent)] = siblings + 1
        node = {"kind": kind, "level": level, "text": body, "parent": parent, "char_start": start, "ordinal": siblings, "path": f"{parent['path'] if parent else ''}/{siblings + 1}"}
        if head:
            node["depth"] = head[0]
            chain.append(node)
        out.append(node)
    content = hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
    seen: set[str] = set()
    for n in out:
        full = hashlib.sha256("\0".join((content, n["path"], n["kind"], n["text"])).encode("utf-8", "replace")).hexdigest()
        n["id"] = next("nd_" + full[:k] for k in (12, 16, 20, 64) if "nd_" + full[:k] not in seen)
        seen.add(n["id"])
    return out


NODES = "doc_id long, node_id string, kind string, level long, ordinal long, parent_id string, path string, char_start long, text string"


def _node_rows(doc: int, text: str, markdown: bool) -> list[tuple]:
    return [(doc, n["id"], n["kind"], n["level"], n["ordinal"], n["parent"]["id"] if n["parent"] else None, n["path"], n["char_start"], n["text"]) for n in read_nodes(text, markdown=markdown)]


def _in_parts(fields: str, rows_of: Callable[[int, str], list[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of documents (id, text), handed on in parts of about ``PART_CHARS``: a task holds a document's rows and a part, whatever the batch."""
    kinds = [pa.field(n, {"long": pa.int64(), "string": pa.string()}.get(t) or pa.list_(pa.string())) for n, t in (f.split() for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds))

        for batch in batches:
            for i in range(batch.num_rows):
                new = rows_of(batch[0][i].as_py(), batch[1][i].as_py() or "")
                rows += new
                size += sum(len(r[-1]) + 100 for r in new)
                if size >= PART_CHARS:
                    yield part()
                    rows, size = [], 0
        if rows:
            yield part()

    return run


def nodes(docs: DataFrame, *, markdown: bool = True) -> DataFrame:
    """doc_id, node_id, kind, level, ordinal, parent_id, path, char_start, text of markdown or plain documents."""
    return docs.select("doc_id", "text").mapInArrow(_in_parts(NODES, lambda doc, text: _node_rows(doc, text, markdown)), NODES)


def page_nodes(pages: DataFrame) -> DataFrame:
    """The nodes of pages (page_id, html) read as markdown: both steps in one worker, a page at a time."""
    return pages.select("page_id", "html").mapInArrow(_in_parts(NODES, lambda page, html: _node_rows(page, text_of(html, True), True)), NODES)


def split_body(body: str, cap: int = CAP) -> list[str]:
    """Paragraphs packed up to ``cap`` characters; a longer one is cut after a sentence in its second half, else at the cap."""
    out: list[str] = []
    held = ""
    for paragraph in re.split(r"\n\s*\n", body):
        paragraph = paragraph.strip()
        at = 0
        while len(paragraph) - at > cap:
            window = paragraph[at : at + cap]
            ends = [m.end() for m in re.finditer(r"[.!?。！？](?=\s|$)", window) if m.end() >= cap // 2]
            cut = ends[-1] if ends else cap
            if held:
                out.append(held)
                held = ""
            out.append(window[:cut].strip())
            at += cut
            while paragraph[at : at + 1].isspace():
                at += 1
        paragraph = paragraph[at:]
        if held and len(held) + 2 + len(paragraph) > cap:
            out.append(held)
            held = ""
        held = f"{held}\n\n{paragraph}" if held and paragraph else held or paragraph
    return out + [held] if held else out


def tree_chunks(docs: DataFrame, cap: int = CAP, *, markdown: bool = True) -> DataFrame:
    """doc_id, chunk_id, parent_id, level, section_title, heading_chain, part, text: one chunk a section, split to ``cap``; text before the first heading is a preface."""
    fields = "doc_id long, chunk_id string, parent_id string, level long, section_title string, heading_chain array<string>, part long, text string"

    def chunks_of(doc: int, text: str) -> list[tuple]:
        sections: list[tuple] = []
        chain: list[dict] = []
        current = (None, [])
        for n in read_nodes(text, markdown=markdown):
            if n["kind"] == "heading":
                sections.append((*current, list(chain)))
                while chain and chain[-1]["level"] >= n["level"]:
                    chain.pop()
                chain.append(n)
                current = (n, [])
            else:
                current[1].append(n["text"])
        sections.append((*current, list(chain)))
        rows = []
        for head, body, above in sections:
            if head is None and not body:
                continue
            name = head["id"] if head else "preface"
            up = above[-2]["id"] if head and len(above) > 1 else None
            for k, part in enumerate(split_body("\n\n".join(body), cap) or [""]):
                rows.append((doc, f"{doc}__{name}__p{k + 1}", up, head["level"] if head else 0, head["text"] if head else "", [a["text"] for a in above], k + 1, part))
        return rows

    return docs.select("doc_id", "text").mapInArrow(_in_parts(fields, chunks_of), fields)
