"""The library's own functions by name in SQL: scalar functions over Arrow batches, and a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fernwood.operators import documents, jats

SEGMENT = 800


class Pieces:
    """``text_pieces(text, size)``: ordinal, char_start, text of every line's segments that are not blank."""

    def eval(self, text: str, size: int) -> Iterator[tuple[int, int, str]]:
        ordinal = start = 0
        for line in (text or "").split("\n"):
            for at in range(0, len(line), max(1, size or SEGMENT)):
                part = line[at : at + max(1, size or SEGMENT)]
                if part.strip(" "):
                    yield ordinal, start + at, part
                    ordinal += 1
            start += len(line) + 1


def _visible(html: pd.Series) -> pd.Series:
    return html.map(documents.text_of)


def _markdown(html: pd.Series) -> pd.Series:
    return html.map(lambda h: documents.text_of(h, True))


def _jats(xml: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        try:
            return jats.markdown(x) if x else None
        except jats.ParseError:
            return None

    return xml.map(one)


def register(spark: SparkSession) -> list[str]:
    """Registers visible_text(html), html_markdown(html), jats_markdown(xml) and the table function text_pieces(text, size); their names."""
    for name, f in (("visible_text", _visible), ("html_markdown", _markdown), ("jats_markdown", _jats)):
        spark.udf.register(name, F.pandas_udf(f, "string"))
    spark.udtf.register("text_pieces", F.udtf(Pieces, returnType="ordinal bigint, char_start bigint, piece string"))
    return ["visible_text", "html_markdown", "jats_markdown", "text_pieces"]
