"""Canonical documents as tables: blocks of markdown or plain lines, their tree, their ids, and checks of any node table.

Lines are rows. What a line is follows from patterns on it and the next one, and from running marks over its document, so blocks, parents, levels,
heading chains and paths come from windows that share one sort of the lines by document: there is one shuffle, and no document is held in a Python worker. A
window's partition is one document.

Block grammar, first match first: fenced code (if asked for), heading, formula ($$..$$), figure (![alt](uri)), footnote ([^ref]: ..), inline formula ($..$ alone
on its line), table (a row whose next line is a separator, and the rows after it), caption (Figure 1, Fig. 2, Table 3 ..), list, paragraph. Lists, tables, code
and paragraphs run over lines; a caption or an inline formula inside a paragraph belongs to it.

Defined cases: null and empty texts, and lines of blanks, give no nodes; rows that share a key are documents of their own, told apart by ``row``; null keys are kept;
a fence that never closes holds all that follows; headings without a title are paragraphs; only the columns key and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwood.operators import documents
from fernwood.sources.scratch import written

#: Patterns of markdown lines.
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
FORMULA = r"^\$\$(.+?)\$\$\s*$"
FIGURE = r"^!\[(.*?)\]\(([^)]*)\)\s*$"
FOOTNOTE = r"^\[\^([^\]]+)\]:\s*(.+?)\s*$"
INLINE_FORMULA = r"^\$([^$]+?)\$\s*$"
SEPARATOR = r"^\s*\|?\s*:?-{2,}.*$"
CAPTION = r"(?i)^((?:Figure|Fig\.|Table)\s+\S+)[.:]?\s*.*$"
ITEM = r"^\s*(?:[-*+]|\d+\.)\s+(.+?)\s*$"
NUMBER = r"^(\d+(?:\.\d+)*)\s+(.*)$"
FENCE = r"^\s{0,3}```"
#: Lines of plain text that are headings.
SECTION = r"(?i)^(Abstract|Background|Introduction|Methods?|Materials and Methods|Results|Discussion|Conclusions?|References|Acknowledgements?|Limitations|Funding)\s*[:.]?\s*$"
NUMBERED = r"^(\d+(?:\.\d+){0,2})\.?\s+([A-Z][^.]{2,80})$"
KINDS = ("heading", "paragraph", "list", "table", "formula", "inline_formula", "figure", "caption", "footnote", "code")
LEVELS = 6
CHAIN = 8  # steps to the root at most, in a sound tree: six headings, a block, the document


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _bare(text: Column) -> Column:
    """A heading's title without emphasis."""
    return collapsed(F.regexp_replace(text, r"[*_`~]", ""))


def _classified(lines: DataFrame, fences: bool) -> DataFrame:
    """Lines (row, at, line) with kind ("" for blanks) and starts: whether a block begins."""
    of_row = Window.partitionBy("row").orderBy("at")
    line, bare = F.col("line"), F.col("bare")
    out = lines.withColumn("bare", F.trim("line")).withColumn("next", F.lead("line").over(of_row))
    fence = line.rlike(FENCE) if fences else F.lit(False)
    out = out.withColumn("fence", fence).withColumn("before", F.coalesce(F.sum(F.col("fence").cast("int")).over(of_row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1)
    piped = bare.startswith("|")
    own = (
        F.when(F.col("fence") | F.col("before"), "code").when(bare == "", "").when(line.rlike(HEADING) & (_bare(F.regexp_extract("line", HEADING, 2)) != ""), "heading").when(bare.rlike(FORMULA), "formula").when(bare.rlike(FIGURE), "figure")
        .when(line.rlike(FOOTNOTE), "footnote").when(bare.rlike(INLINE_FORMULA), "inline_formula").when(piped & F.coalesce(F.col("next").rlike(SEPARATOR), F.lit(False)), "table")
        .when(piped, "|").when(bare.rlike(CAPTION), "caption").when(line.rlike(ITEM), "list").otherwise("paragraph")
    )
    out = out.withColumn("own", own).withColumn("last", F.lag("own").over(of_row))

    def since(within: Column, was: Column, what: Column) -> Column:
        """Whether ``what`` was true in the run of lines within a set of kinds that a line belongs to, up to it: by places in the one order, so that nothing is sorted anew."""
        begun, met = (F.max(F.when(c, F.col("at"))).over(of_row) for c in (within & ~F.coalesce(was, F.lit(False)), what))
        return within & F.coalesce(met >= begun, F.lit(False))

    rows, were_rows = F.col("own").isin("table", "|"), F.col("last").isin("table", "|")
    out = out.withColumn("run", since(rows, were_rows, F.col("own") == "table"))
    out = out.withColumn("own", F.when(F.col("run"), "table").when(F.col("own") == "|", "paragraph").otherwise(F.col("own")))
    out = out.withColumn("last", F.lag("own").over(of_row))
    soft = F.col("own").isin("caption", "inline_formula", "paragraph")
    out = out.withColumn("run", since(soft, F.col("last").isin("caption", "inline_formula", "paragraph"), F.col("own") == "paragraph"))
    out = out.withColumn("kind", F.when(F.col("run"), "paragraph").otherwise(F.col("own"))).withColumn("last", F.lag("kind").over(of_row))
    opens = F.col("fence") & ~F.col("before")
    joins = (F.col("kind") == F.col("last")) & F.col("kind").isin("list", "table", "paragraph", "code") & ~opens
    return out.withColumn("starts", (F.col("kind") != "") & ~F.coalesce(joins, F.lit(False)))


def _plain(lines: DataFrame) -> DataFrame:
    of_row = Window.partitionBy("row").orderBy("at")
    bare = F.col("bare")
    kind = F.when(bare == "", "").when(bare.rlike(SECTION) | bare.rlike(NUMBERED), "heading").otherwise("paragraph")
    out = lines.withColumn("bare", F.trim("line")).withColumn("kind", kind).withColumn("last", F.lag("kind").over(of_row))
    return out.withColumn("starts", (F.col("kind") != "") & ~F.coalesce((F.col("kind") == "paragraph") & (F.col("last") == "paragraph"), F.lit(False)))


def blocks(docs: DataFrame, *, key: str = "doc_id", text: str = "text", markdown: bool = True, fences: bool = True) -> DataFrame:
    """row, doc_id, ordinal, kind, raw_level, sec_num, char_start, text, attrs (map) of every block, in order."""
    numbered_rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    source = numbered_rows.select("doc_id", "row", F.md5("text").alias("content"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    of_row = Window.partitionBy("row").orderBy("at")
    lines = (_classified(source, fences) if markdown else _plain(source)).withColumn("char", F.coalesce(F.sum(F.length("line").cast("bigint") + 1).over(of_row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")))
    numbered = lines.withColumn("block", F.sum(F.col("starts").cast("int")).over(of_row)).filter("kind <> ''")
    held = F.sort_array(F.collect_list(F.struct("at", "line", "bare")))
    one = numbered.groupBy("row", "block").agg(F.first("doc_id").alias("doc_id"), F.first("content").alias("content"), F.first("kind").alias("kind"), F.min("char").alias("char_start"), held.alias("held"))
    first, bare = F.col("held")[0]["line"], F.col("held")[0]["bare"]
    kind = F.col("kind")
    whole = F.array_join(F.transform("held", lambda x: F.regexp_replace(x["line"], r"\s+$", "")), "\n")
    prose = collapsed(F.array_join("held.bare", " "))
    title = F.regexp_extract(first, HEADING, 2) if markdown else F.when(bare.rlike(SECTION), F.regexp_extract(bare, SECTION, 1)).otherwise(F.regexp_extract(bare, NUMBERED, 2))
    number = F.nullif(F.regexp_extract(F.trim(title), NUMBER, 1), F.lit("")) if markdown else F.nullif(F.regexp_extract(bare, NUMBERED, 1), F.lit(""))
    level = F.length(F.regexp_extract(first, HEADING, 1)) if markdown else F.when(bare.rlike(SECTION), 1).otherwise(2)
    named = _bare(F.when(number.isNotNull(), F.regexp_extract(F.trim(title), NUMBER, 2)).otherwise(title)) if markdown else _bare(title)
    items = F.transform("held", lambda x: collapsed(F.regexp_extract(x["line"], ITEM, 1)))
    alt = F.trim(F.regexp_extract(bare, FIGURE, 1))
    value = (
        F.when(kind == "heading", F.when(named == "", _bare(title)).otherwise(named)).when(kind.isin("table", "code"), whole).when(kind == "formula", F.trim(F.regexp_extract(bare, FORMULA, 1))).when(kind == "inline_formula", F.trim(F.regexp_extract(bare, INLINE_FORMULA, 1)))
        .when(kind == "figure", F.when(alt == "", "[figure]").otherwise(alt)).when(kind == "footnote", collapsed(F.regexp_extract(first, FOOTNOTE, 2))).when(kind == "list", F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n")).otherwise(prose)
    )

    def pairs(*of: Column | str) -> Column:
        return F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in of))

    shown = F.when(kind == "formula", "true").otherwise("false")
    label = F.regexp_extract(bare, CAPTION, 1)
    attrs = (
        F.when(kind.isin("formula", "inline_formula"), pairs("latex", value, "display", shown)).when(kind == "figure", pairs("alt", alt, "uri", F.trim(F.regexp_extract(bare, FIGURE, 2)))).when(kind == "caption", pairs("label", label, "ref", label))
        .when(kind == "footnote", pairs("ref", F.regexp_extract(first, FOOTNOTE, 1), "markdown", bare)).when(kind.isin("table", "list", "paragraph"), pairs("markdown", whole)).otherwise(F.expr("cast(map() as map<string,string>)"))
    )
    told = one.select("row", "doc_id", "content", F.col("block").cast("bigint").alias("ordinal"), "kind", F.when(kind == "heading", level).otherwise(0).cast("int").alias("raw_level"), F.when(kind == "heading", number).alias("sec_num"), "char_start", value.alias("text"), attrs.alias("attrs"))
    kept = told.filter("text <> ''")
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy("row").orderBy("ordinal")).cast("bigint"))


def _open(value: Column) -> list[Column]:
    """For each heading level the last heading before a row: (ordinal, value)."""
    before = Window.partitionBy("row").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return [F.last(F.when(F.col("raw_level") == k, F.struct(F.col("ordinal").alias("at"), value.alias("value"))), ignorenulls=True).over(before) for k in range(1, LEVELS + 1)]


def _chain(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: for each row the array of (at, value) of the headings above it, outermost first.

    A heading is above a row if no heading of its level or a lower one stands between them, and, where the row is a heading, its level is lower.
    """
    names = [f"open{k}" for k in range(1, LEVELS + 1)]
    out = df.withColumns(dict(zip(names, _open(value), strict=True)))
    valid = []
    for k, c in enumerate(names, 1):
        later = [F.coalesce(F.col(x)["at"], F.lit(-1)) for x in names[: k - 1]]
        stays = F.col(c).isNotNull() & ((F.col("raw_level") == 0) | (F.col("raw_level") > k))
        for x in later:
            stays = stays & (F.col(c)["at"] > x)
        valid.append(F.when(stays, F.col(c)))
    return out.withColumn(name, F.filter(F.array(*valid), lambda x: x.isNotNull())).drop(*names)


def nodes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", markdown: bool = True, fences: bool = True) -> DataFrame:
    """row, doc_id, ordinal, node_id, parent_id, kind, level, sec_num, heading_chain (titles), path, char_start, text, attrs.

    Levels of headings close up where some are skipped. A path holds places among siblings; ids are hashes of the document's content, the way to the node (kind, text and occurrence among siblings of each step), its kind
    and text, as short as they differ within the document: 12, 16, 20 or 64 digits.
    """
    each = _chain(blocks(docs, key=key, text=text, markdown=markdown, fences=fences), F.col("text"), "above")
    each = each.withColumn("parent_at", F.try_element_at("above", F.lit(-1))["at"])
    siblings = Window.partitionBy("row", "parent_at").orderBy("ordinal")
    alike = Window.partitionBy("row", "parent_at", "kind", "text").orderBy("ordinal")
    each = each.withColumn("place", F.row_number().over(siblings)).withColumn("step", F.concat_ws(":", "kind", F.md5("text"), (F.row_number().over(alike) - 1).cast("string")))
    # A heading's own step and place, of which the chain of a node below it is made.
    each = _chain(each, F.struct(F.col("place").cast("string").alias("place"), "step"), "way")
    way = F.transform("way", lambda x: x["value"])
    path = F.concat(F.lit("/"), F.array_join(F.concat(F.transform(way, lambda x: x["place"]), F.array(F.col("place").cast("string"))), "/"))
    steps = F.concat(F.transform(way, lambda x: x["step"]), F.array("step"))
    full = F.sha2(F.concat_ws("\u0000", F.col("content"), F.array_join(steps, "/"), F.col("kind"), F.col("text")), 256)
    named = each.withColumns({"path": path, "full": full})
    named = named.withColumn("near", F.collect_list("full").over(Window.partitionBy("row", F.left("full", F.lit(12)))))  # nearly always one
    alone = lambda n: F.size(F.filter("near", lambda x: F.left(x, F.lit(n)) == F.left("full", F.lit(n)))) == 1
    short = F.when(F.size("near") == 1, F.left("full", F.lit(12))).when(alone(16), F.left("full", F.lit(16))).when(alone(20), F.left("full", F.lit(20))).otherwise(F.col("full"))
    named = named.withColumn("node_id", F.concat(F.lit("nd_"), short))
    named = _chain(named, F.col("node_id"), "ids")
    level = F.when(F.col("kind") == "heading", F.size("above") + 1).otherwise(0).cast("bigint")
    titles = F.transform("above", lambda x: x["value"])
    return named.select("row", "doc_id", "ordinal", "node_id", F.try_element_at("ids", F.lit(-1))["value"].alias("parent_id"), "kind", level.alias("level"), "sec_num", titles.alias("heading_chain"), "path", "char_start", "text", "attrs")


# --- chunks of the tree ------------------------------------------------------------------------------------------

CAP = 400  # characters of a chunk


def chunks(tree: DataFrame, *, cap: int = CAP) -> DataFrame:
    """row, doc_id, chunk_id, parent_id, child_ids, sibling_ids, level, path, section_number, section_title, heading_chain, part, text, char_count of a node table.

    A section is a heading with the blocks below it, or the preface: blocks before the first heading. Its text is packed into parts of ``cap`` characters: whole paragraphs while they fit,
    longer ones cut after a sentence in their second half, else at the cap; tables, code and lists are not cut apart from paragraphs. A section without blocks
    is one empty part. Parent, children and siblings are named by the first parts of their sections. The preface has level 0, no number and no relatives.

    Sections meet their blocks, parents and children by (row, node id): equality joins, and lists no longer than a document's sections.
    """
    held = written(tree.select("row", "doc_id", "ordinal", "node_id", "parent_id", "kind", "level", "sec_num", "heading_chain", "path", "text"), "nodes")
    body = held.filter("kind <> 'heading'").groupBy("row", "doc_id", F.coalesce("parent_id", F.lit("preface")).alias("section")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    heads = held.filter("kind = 'heading'").select("row", "doc_id", "ordinal", F.col("node_id").alias("section"), F.col("parent_id").alias("above"), "level", "path", "sec_num", "text", F.concat("heading_chain", F.array("text")).alias("heading_chain"))
    named = heads.join(body.drop("doc_id"), ["row", "section"], "left")
    preface = body.filter("section = 'preface'").select("row", "doc_id", F.lit(0).cast("long").alias("ordinal"), "section", F.lit(None).cast("string").alias("above"), F.lit(0).cast("long").alias("level"), F.lit("").alias("path"), F.lit(None).cast("string").alias("sec_num"), F.lit("").alias("text"), F.array().cast("array<string>").alias("heading_chain"), "body")
    sections = written(named.select(preface.columns).unionByName(preface).withColumn("body", F.coalesce("body", F.lit(""))), "sections")
    own_id = lambda section: F.concat_ws("__", F.col("doc_id").cast("string"), section, F.lit("p1"))
    families = sections.filter("section <> 'preface'").groupBy("row", "above").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", own_id(F.col("section")).alias("id")))), lambda x: x["id"]).alias("ids"))
    kids = families.select(F.col("row").alias("of_row"), F.col("above").alias("of"), F.col("ids").alias("kids"))
    peers = families.select(F.col("row").alias("peer_row"), F.col("above").alias("under"), F.col("ids").alias("peers"))
    met = sections.join(kids, (F.col("row") == F.col("of_row")) & (F.col("section") == F.col("of")), "left").join(peers, (F.col("row") == F.col("peer_row")) & F.col("above").eqNullSafe(F.col("under")) & (F.col("section") != "preface"), "left")
    split = F.pandas_udf(lambda bodies: bodies.map(lambda b: documents.split_body(b, cap) or [""]), "array<string>")
    none = F.array().cast("array<string>")
    parts = met.withColumn("parts", split("body")).select("*", F.posexplode("parts").alias("at", "piece"))
    return parts.select(
        "row", "doc_id", F.concat_ws("__", F.col("doc_id").cast("string"), "section", F.concat(F.lit("p"), (F.col("at") + 1).cast("string"))).alias("chunk_id"), F.when(F.col("above").isNotNull(), own_id(F.col("above"))).alias("parent_id"),
        F.coalesce("kids", none).alias("child_ids"), F.coalesce(F.filter("peers", lambda x: x != own_id(F.col("section"))), none).alias("sibling_ids"), "level", "path", F.col("sec_num").alias("section_number"), F.col("text").alias("section_title"), "heading_chain",
        (F.col("at") + 1).cast("long").alias("part"), F.col("piece").alias("text"), F.length("piece").cast("long").alias("char_count"),
    )


# --- checks of node tables ---------------------------------------------------------------------------------------


def _rules() -> dict[str, Column]:
    """Rules of single nodes; each is true where it is broken."""
    kind, text = F.col("kind"), F.coalesce("text", F.lit(""))
    has = lambda name: F.coalesce(F.map_contains_key("attrs", F.lit(name)), F.lit(False))
    formula = kind.isin("formula", "inline_formula")
    heading = kind == "heading"
    return {
        "unknown_kind": ~F.coalesce(kind.isin(*KINDS), F.lit(False)),
        "heading_level": heading & ~F.coalesce(F.col("level").between(1, LEVELS), F.lit(False)),
        "heading_title": heading & (text == ""),
        "block_level": ~heading & ~F.coalesce(F.col("level") == 0, F.lit(False)),
        "table_markdown": (kind == "table") & (~has("markdown") | ~F.contains(text, F.lit("|"))),
        "formula_attrs": formula & (~has("latex") | ~has("display") | (text == "")),
        "figure_attrs": (kind == "figure") & (~has("alt") | ~has("uri") | (text == "")),
        "list_lines": (kind == "list") & F.exists(F.split(text, "\n"), lambda x: ~x.startswith("- ")),
        "empty_note": kind.isin("caption", "footnote") & (text == ""),
    }


def broken(tree: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """doc, node_id, rule: every broken rule of a node table (doc, node_id, parent_id, kind, level, ordinal, path, text, attrs).

    Beside the rules of single nodes: ids repeated within a document, parents that are not there, circles (a way up that does not end within ``CHAIN`` steps), ordinals that do not
    increase, gaps (a node whose parent stands after it), paths repeated, and paths that are not the parent's with one more step. Parents are joined by
    (doc, id) and ways up are doubled, so three joins settle every depth.
    """
    at = written(tree.select(F.col(doc).alias("doc"), "node_id", "parent_id", "kind", "level", "ordinal", "path", "text", "attrs"), "tree")
    single = at.select("doc", "node_id", F.explode(F.filter(F.array(*(F.when(bad, rule) for rule, bad in _rules().items())), lambda x: x.isNotNull())).alias("rule"))
    repeated = [at.groupBy("doc", c).agg(F.count("*").alias("n")).filter("n > 1").join(at.select("doc", c, *(["node_id"] if c != "node_id" else [])), ["doc", c]).select("doc", "node_id", F.lit(rule).alias("rule")) for c, rule in (("node_id", "repeated_id"), ("path", "repeated_path"), ("ordinal", "repeated_ordinal"))]
    parents = at.select(F.col("doc").alias("of"), F.col("node_id").alias("up"), F.col("path").alias("up_path"), F.col("ordinal").alias("up_at")).dropDuplicates(["of", "up"])
    met = written(at.join(parents, (F.col("doc") == F.col("of")) & (F.col("parent_id") == F.col("up")), "left"), "met")
    tied = met.filter("parent_id is not null")
    dangling = tied.filter("up is null").select("doc", "node_id", F.lit("dangling_parent").alias("rule"))
    late = tied.filter("up is not null and up_at >= ordinal").select("doc", "node_id", F.lit("parent_after_child").alias("rule"))
    above = F.coalesce("up_path", F.lit(""))
    rest = F.substring("path", F.length(above) + 1, F.length("path"))
    paths = met.filter("parent_id is null or up is not null").filter(~(F.coalesce(F.startswith("path", F.concat(above, F.lit("/"))), F.lit(False)) & (F.length(rest) - F.length(F.replace(rest, F.lit("/"), F.lit(""))) == 1)))
    misplaced = paths.select("doc", "node_id", F.lit("path_of_parent").alias("rule"))
    way = met.filter("up is not null").select("doc", "node_id", F.col("parent_id").alias("up")).distinct()
    for _ in range(CHAIN.bit_length() - 1):
        over = way.select(F.col("doc").alias("of"), F.col("node_id").alias("mid"), F.col("up").alias("top"))
        way = written(way.join(over, (F.col("doc") == F.col("of")) & (F.col("up") == F.col("mid"))).select("doc", "node_id", F.col("top").alias("up")).distinct(), "way")
    circles = way.select("doc", "node_id", F.lit("circle").alias("rule"))
    return reduce(DataFrame.unionByName, [single, *repeated, dangling, late, misplaced, circles])


#: The version of canonical documents, and levels of their warnings.
VERSION = "1.0"
WARNINGS = ("info", "warn", "error")
DOCUMENT = (
    "schema_version string, doc_id string, content_hash string, source_file string, parser string, parser_version string, parser_warnings array<struct<level:string,code:string,msg:string>>, "
    "nodes array<struct<node_id:string,kind:string,level:long,sec_num:string,title:string,text:string,ordinal:long,parent_id:string,path:string,locator:struct<char_start:long,char_end:long>,attrs:map<string,string>>>, broken string"
)


def documents_of(tree: DataFrame, *, source_file: str = "source_file", version: str = VERSION) -> DataFrame:
    """One canonical document for each document of a node table (as ``nodes`` makes them): its nodes in order, in the shape of ``DOCUMENT``."""
    title = F.when(F.col("kind") == "heading", F.col("text")).otherwise("")
    place = F.struct("char_start", F.lit(None).cast("long").alias("char_end")).alias("locator")
    node = F.struct("node_id", "kind", "level", "sec_num", title.alias("title"), "text", "ordinal", "parent_id", "path", place, "attrs")
    in_order = F.array_sort(F.collect_list(node), lambda a, b: (a["ordinal"] - b["ordinal"]).cast("int"))  # nodes of one document
    whole = tree.groupBy("row", F.col("doc_id").cast("string").alias("doc_id")).agg(in_order.alias("nodes"))
    content = F.concat(F.lit("sha256:"), F.sha2(F.array_join("nodes.text", "\n"), 256))
    warnings = F.array().cast("array<struct<level:string,code:string,msg:string>>")
    return whole.select(F.lit(version).alias("schema_version"), "doc_id", content.alias("content_hash"), F.lit(source_file).alias("source_file"), F.lit("lines").alias("parser"), F.lit("1.0").alias("parser_version"), warnings.alias("parser_warnings"), "nodes")


def faults(docs: DataFrame) -> DataFrame:
    """doc, node_id, rule of canonical documents in the shape of ``DOCUMENT``: broken JSON, wrong version or hash, unknown or error-level warnings, repeated documents, and all that ``broken`` finds in their trees."""
    docs = written(docs.withColumn("doc_id", F.col("doc_id").cast("string")), "documents")
    level = F.transform(F.coalesce("parser_warnings", F.array().cast("array<struct<level:string,code:string,msg:string>>")), lambda w: w["level"])
    rules = {
        "broken_json": F.col("broken").isNotNull(),
        "schema_version": F.col("broken").isNull() & ~F.coalesce(F.col("schema_version") == VERSION, F.lit(False)),
        "content_hash": F.col("broken").isNull() & ~F.coalesce(F.col("content_hash").rlike("^sha256:[0-9a-f]{64}$"), F.lit(False)),
        "warning_level": F.exists(level, lambda x: ~F.coalesce(x.isin(*WARNINGS), F.lit(False))),
        "error_warning": F.array_contains(level, "error"),
    }
    heads = docs.select(F.col("doc_id").alias("doc"), F.lit(None).cast("string").alias("node_id"), F.explode(F.filter(F.array(*(F.when(bad, rule) for rule, bad in rules.items())), lambda x: x.isNotNull())).alias("rule"))
    twice = docs.filter("broken is null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("doc"), F.lit(None).cast("string").alias("node_id"), F.lit("repeated_document").alias("rule"))
    tree = docs.select("doc_id", F.inline("nodes"))
    return heads.unionByName(twice).unionByName(broken(tree))


# --- located chunks of source texts ------------------------------------------------------------------------------

#: What ends a line beside \n, once \r\n and \r have become \n.
ENDS = "\n\u000b\u000c\u001c\u001d\u001e\u0085  "
SEGMENT, TITLE = 800, 500
#: Chunks that a text may have; None: any number. The reference has 10,000, as its parser is one process; larger texts are left to "a different approved pipeline".
MOST_CHUNKS: int | None = None


def located(docs: DataFrame, *, key: str = "doc_id", text: str = "text", pages: str | None = None) -> DataFrame:
    """row, doc_id, ordinal, char_start, char_end, page, heading (titles), canonical_hash, text, error: every line, its end included, in segments of ``SEGMENT`` characters.

    Blank segments are left out, offsets count them. A heading outside fences cuts the chain of titles to the levels above it and joins it; titles are cut to ``TITLE`` characters.
    ``pages`` names a column of (start, end, number); a segment has the page in which it starts. Texts without a visible character have one row with PARSE_EMPTY.
    Texts of any length are cut whole; only where ``MOST_CHUNKS`` is set, texts with more have one row with PARSER_LIMIT, and no chunks.
    """
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n")
    rows = docs.select(F.col(key).alias("doc_id"), normal.alias("whole"), (F.col(pages) if pages else F.lit(None).cast("array<struct<start:long,end:long,number:int>>")).alias("pages"), F.monotonically_increasing_id().alias("row"))
    hashed = rows.withColumn("canonical_hash", F.sha2("whole", 256))
    blank = r"(?U)^[\s\x1c-\x1f]*$"
    # What a line alone tells is found before the one shuffle: its segments, fence and heading.
    ended = hashed.select("row", "doc_id", "pages", "canonical_hash", F.posexplode(F.split("whole", f"(?<=[{ENDS}])")).alias("at", "line")).filter("line <> ''")
    size = F.length("line")
    whole_or_cut = F.when(size <= SEGMENT, F.array("line")).otherwise(F.regexp_extract_all("line", F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0)))
    cut = F.filter(F.transform(whole_or_cut, lambda part, i: F.struct((i * SEGMENT).alias("offset"), part.alias("text"))), lambda x: ~x["text"].rlike(blank))
    form = r"(?U)^(#{1,6})\s+(.+)"
    title = F.trim(F.regexp_replace(F.regexp_extract("line", form, 2), r"(?U)^\s+|\s+$", ""))
    headed_line = F.when(F.col("line").rlike(form), F.struct(F.length(F.regexp_extract("line", form, 1)).alias("depth"), F.left(title, F.lit(TITLE)).alias("title")))
    alone = ended.select("row", "doc_id", "pages", "canonical_hash", "at", size.cast("bigint").alias("size"), F.col("line").rlike(r"(?U)^\s*```").cast("int").alias("fence"), headed_line.alias("head"), cut.alias("cut"))
    of_row = Window.partitionBy("row").orderBy("at")
    before = of_row.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    lines = alone.withColumns({"start": F.coalesce(F.sum("size").over(before), zero), "inside": F.sum("fence").over(of_row) % 2 == 1, "first": F.coalesce(F.sum(F.size("cut").cast("bigint")).over(before), zero)})
    lines = lines.withColumn("head", F.when(~F.col("inside"), F.col("head")))
    # A heading of depth d makes the chain one longer, but no longer than d. So the i-th leaves it i + min(0, least d - j of the j-th up to it) long, and a place in it has the last title put there.
    lines = lines.withColumn("heads", F.count("head").over(of_row)).withColumn("least", F.min(F.col("head.depth") - F.col("heads")).over(of_row))
    lines = lines.withColumn("long", (F.col("heads") + F.least(F.lit(0), "least")).cast("int"))
    places = (F.last(F.when(F.col("long") == k, F.col("head.title")), ignorenulls=True).over(of_row) for k in range(1, LEVELS + 1))
    lines = lines.withColumn("heading", F.slice(F.array(*places), F.lit(1), F.col("long")))
    n = F.lit(None).cast("bigint") if MOST_CHUNKS is None else F.sum(F.size("cut").cast("bigint")).over(Window.partitionBy("row"))
    met = lines.withColumn("n", n).select("row", "doc_id", "pages", "canonical_hash", "heading", "start", "first", "n", F.posexplode("cut").alias("k", "x"))
    start = F.col("start") + F.col("x.offset")
    page = F.get(F.filter("pages", lambda p: (p["start"] <= start) & (start < p["end"])), F.lit(0))["number"]
    found = met.select("row", "doc_id", (F.col("first") + F.col("k")).alias("ordinal"), start.alias("char_start"), (start + F.length("x.text")).alias("char_end"), page.alias("page"), "heading", "canonical_hash", F.col("x.text").alias("text"), F.lit(None).cast("string").alias("error"), "n")
    found = written(found, "chunks")
    empty = hashed.filter(F.col("whole").rlike(blank)).select("row", "doc_id", "canonical_hash", F.lit("PARSE_EMPTY").alias("error"))
    if MOST_CHUNKS is not None:
        empty = empty.unionByName(found.filter((F.col("n") > MOST_CHUNKS) & (F.col("ordinal") == 0)).select("row", "doc_id", "canonical_hash", F.lit("PARSER_LIMIT").alias("error")))
        found = found.filter(F.col("n") <= MOST_CHUNKS)
    return found.drop("n").unionByName(empty, allowMissingColumns=True)
