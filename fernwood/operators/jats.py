"""Articles in JATS XML as markdown: nested sections become heading levels.

Each document is read by a pull parser, so it is never held as a tree. The title is the first article title; paragraphs of abstracts come under "Abstract"; sections of
the body have the level of their depth, from two on; a section's own title and paragraphs count, lists, tables and figures are left out. Names are taken without their namespace.

Defined cases: a null or empty text, or one that is no XML (cut short, say), has a null markdown and ``broken``; an article without title, abstract or body
lacks that part; sections deeper than six levels keep their number of signs; repeated rows count each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree.ElementTree import ParseError, XMLPullParser

import pandas as pd
from pyspark.sql import DataFrame

PIECE = 1 << 16  # characters fed to the parser at once


def markdown(xml: str) -> str:
    """Raises ParseError where the text is no XML."""
    parser = XMLPullParser(("start", "end"))
    path: list[str] = []
    title, abstract, body = "", [], []
    for at in range(0, len(xml), PIECE):
        parser.feed(xml[at : at + PIECE])
        title = _events(parser, path, title, abstract, body)
    parser.close()
    title = _events(parser, path, title, abstract, body)
    head = f"# {title}\n\n" if title else ""
    summary = "## Abstract\n\n" + "\n\n".join(abstract) + "\n" if abstract else ""
    return head + summary + "".join(body)


def _events(parser: XMLPullParser, path: list[str], title: str, abstract: list[str], body: list[str]) -> str:
    for event, node in parser.read_events():
        tag = node.tag.rsplit("}", 1)[-1]
        if event == "start":
            path.append(tag)
            continue
        path.pop()
        if tag not in ("article-title", "p", "title"):
            if tag == "sec":
                node.clear()  # its parts are written
            continue
        text = "".join(node.itertext()).strip()
        if not text:
            continue
        inside = path[path.index("body") + 1 :] if "body" in path else None
        if tag == "article-title":
            title = title or text
        elif tag == "p" and "abstract" in path:
            abstract.append(text)
        elif inside and set(inside) == {"sec"}:  # directly in nested sections of the body
            body.append(f"\n{'#' * (len(inside) + 1)} {text}\n" if tag == "title" else f"\n{text}\n")
    return title


def read(docs: DataFrame, *, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """key, text (markdown, null where broken), broken."""
    kind = docs.schema[key].dataType.simpleString()

    def one(x: str | None) -> str | None:
        try:
            return markdown(x) if x else None
        except ParseError:
            return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = [one(x) for x in p[xml]]
            yield pd.DataFrame({key: p[key], "text": pd.Series(texts, dtype=object), "broken": [t is None for t in texts]})

    return docs.select(key, xml).mapInPandas(run, f"{key} {kind}, text string, broken boolean")


def levels(text: str) -> dict[int, int]:
    """How many headings of each level a markdown text has."""
    found = [len(m) for m in re.findall(r"(?m)^(#{1,6}) ", text)]
    return {n: found.count(n) for n in range(1, 7)}
