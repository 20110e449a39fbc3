"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

Tokens are opening tags, told apart by their path of enclosing structure (tag, id, class), and runs of text of any length, told
apart by path and wording. Over a host's different pages every token has an occurrence vector (how often it stands in each
page). Tokens with one vector form a class; vectors are compared by count, total and a 64-bit sum that any task can add up
alone. A class is valid if it covers enough pages (two, and 2 % of the host's) and its parent is valid, which is settled from the
root down. The valid classes, nested by parent, are the host's template; what lies between its tokens are slots. Wording belongs
to the template if it is in one class with the tag around it (that tag never holds anything else), or covers 80 % of the pages.

The template then says what its slots hold, by how their contents vary over the host's pages:

* the article lies below the nested class tags that stand once a page and hold most of their parent's text (outside links) on at
  least half of the pages that have them. Going down from the root, each layout of a host may have its own such tags; a page's
  article is below the last of them that it has. Headings directly in a tag around it belong to it, body and html excepted;
* wording of the template goes, but for that inside the article; so do slots that hold little but links (menus) and those that hold little but texts which other
  pages have too (notices; headings are none). Where most of the text of the articles found recurs, its pages are copies of each other, and then
  nothing inside the article goes for recurring; nor on a page of which nothing would be left.

Names of HTML and of structure (``names``) only break ties: below the article they remove asides, forms, adverts, comments and
the like; a tag named so is not gone into for the article; an ``article`` or ``main`` around the article found is taken whole,
and within a page, text in it is preferred. They decide alone for pages of which the template knows no article (a host with one
page). Names on html, body and main, and on what holds an ``article`` or ``main``, do not count, nor do those of layout
(no-sidebar). Blocks keep page order, joined by one newline; white space inside a block becomes one space.

Counting sends partial sums to the shuffle, keyed by host and token; only supported tags and wording, a number bounded by the
structure of a page, meet by host. Templates are small and written out; Spark broadcasts them only below its own threshold,
else pages and templates meet in an equality join whose skewed keys adaptive execution splits.

Defined cases: null or empty html gives an empty text and 0 characters; a null url has no host and no template, so only
names of structure decide; repeated rows and copies of a page stay, but count once in their host's template; truncated markup is
read as far as it goes; html of any length is read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import urls, words
from .shared import dropped, joined_by_id, written

LEAST_PAGES = 2  # of a host with a template, and of a token in it
SUPPORT = 0.8  # share of a host's pages, and three of them at least, that wording covers which is in no class with its tag
OPTIONAL = 0.02  # share of a host's pages that a class covers
LINKED = 0.6  # share of a slot's characters inside links that makes it a menu
RECURRING = 0.6  # share of a slot's characters in texts that other pages have too that makes it a notice
COPIES = 0.5  # share of recurring text in an article from which on a host's pages are copies
ONCE = 1.2  # a tag of the class of once a page stands so often in the mean at most
#: Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
BOILERPLATE_TAGS = frozenset("head title nav footer aside form button select option textarea iframe object svg canvas menu dialog noscript template".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side nav navbar navigation menu breadcrumb breadcrumbs footer foot header masthead topbar "
    "cookie cookies notice consent gdpr alert popup modal newsletter subscribe signup login share sharing social related recommended comment comments reply replies widget toolbar pagination pager copyright legal disclaimer skip".split()
)
MAIN_TAGS = frozenset(("article", "main"))
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|xmp|noframes)\b.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^<>]*+>?)|<[!?][^>]*+>?|(?P<text>[^<]++|<)""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
#: In a class like no-sidebar or with-nav they tell of the layout of what is around, not of what the tag holds.
LAYOUT = frozenset("no non not without with has have hide".split())


@lru_cache(maxsize=50_000)
def token_hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@lru_cache(maxsize=20_000)
def step_of(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """A tag's part of a path, whether it is hidden, whether it holds no article by its kind, and whether by its names."""
    label, hidden, kind, named = tag, False, tag in BOILERPLATE_TAGS and tag != "form", tag == "form"
    for key, value in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            label += f".{value}" if key != "id" else f"#{re.sub('[0-9]+', '0', value)}"
            parts = [set(re.split("[_-]+", name)) for name in value.split()]
            named = named or any(p & BOILERPLATE_NAMES and not p & LAYOUT for p in parts)
        hidden = hidden or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and UNSEEN.search(value) is not None)
    return label, hidden, kind, named and tag not in ("html", "body", "main")


class Frame:
    """A tag of a page. ``named``: by its names it holds no article; one found to hold an ``article`` or ``main`` loses this.

    What depends on the tags around is passed down (or sums up) in one walk over the tags in their order, so depth costs nothing:
    ``unwanted`` (by names, known once the page is read), ``held`` and ``linked`` (characters below, and of them inside links), ``slot`` (innermost tag
    of the template) and ``inside`` (below an end of the way to the article).
    """

    __slots__ = ("tag", "path", "bad", "named", "main", "up", "unwanted", "held", "linked", "slot", "inside")

    def __init__(self, tag: str, path: int, bad: bool, named: bool, main: bool, up: Frame | None) -> None:
        self.tag, self.path, self.bad, self.named, self.main, self.up = tag, path, bad, named, main, up
        self.unwanted = self.inside = False
        self.held = self.linked = self.slot = 0


def read(html: str, names: bool = True) -> tuple[list[Frame], list[tuple[Frame, str, int]]]:
    """Opened tags, and blocks as (enclosing tag, text, characters inside links). Without ``names`` no tag counts as article or not by them."""
    stack: list[Frame] = [Frame("", 0, False, False, False, None)]
    places: dict[str, list[int]] = {}  # open tags by name, as places in the stack
    holders: set[int] = {0}  # places in the stack of tags known to hold an article
    opened: list[Frame] = []
    blocks: list[tuple[Frame, str, int]] = []
    run: list[str] = []
    linked = in_link = 0

    def close_block() -> None:
        nonlocal linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                blocks.append((stack[-1], text, linked))
            run.clear()
        linked = 0

    def leave(depth: int) -> None:
        """Closes the tags from this place on."""
        while len(stack) > depth:
            places[stack.pop().tag].pop()
            holders.discard(len(stack))

    for m in TOKEN.finditer(html):
        kind = m.lastgroup
        text = m["text"]
        if text is not None:
            run.append(text)
            if in_link:
                linked += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            if kind == "raw" and m["raw"].lower() in ("xmp", "noframes"):
                close_block()
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m["close"] else 1
            elif tag == "br":
                run.append(" ")
            continue
        close_block()
        in_link = 0
        if m["close"]:
            if places.get(tag):
                leave(places[tag][-1])
            continue
        if tag in VOID:
            continue
        if stack[-1].tag == "p" or (stack[-1].tag == tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option")):
            leave(len(stack) - 1)
        top = stack[-1]
        if top.tag == "head" and tag in ("body", "article", "div", "main", "p"):
            leave(len(stack) - 1)
            top = stack[-1]
        label, hidden, kind, named = step_of(tag, m["attrs"])
        main = top.main or (names and tag in MAIN_TAGS)
        if names and tag in MAIN_TAGS and not top.main and not named:
            at = len(stack) - 1
            while at not in holders:  # tags around one that holds an article are known to hold one
                stack[at].named = False
                holders.add(at)
                at -= 1
        places.setdefault(tag, []).append(len(stack))
        stack.append(Frame(tag, token_hash(str(top.path), label), top.bad or hidden or (names and (kind or (tag == "header" and not top.main))), names and named, main, top))
        opened.append(stack[-1])
    close_block()
    for f in opened:
        f.unwanted = f.bad or f.named or f.up.unwanted
    return opened, blocks


def _different(pages: DataFrame) -> DataFrame:
    """site, digest, html: one row for each different page of a host. Only copied pages are shuffled, and of them only the rows with the smallest key."""
    marked = pages.filter("host <> ''").select(F.xxhash64("host").alias("site"), "page", "html", F.xxhash64("host", "html").alias("digest"))
    copied = written(marked.groupBy("digest").agg(F.count("*").alias("n"), F.min("page").alias("least")).filter("n > 1").drop("n"), "copied")
    if copied.isEmpty():
        return marked.drop("page")
    one = joined_by_id(marked, copied, "digest", "inner").filter("page <=> least").dropDuplicates(["digest"])
    return joined_by_id(marked, copied.select("digest"), "digest", "left_anti").drop("page").unionByName(one.select("site", "html", "digest"))


SUMS = ("pages", "total", "vector", "wins", "chars", "linked", "named")


def tally(html: str, digest: int, names: bool) -> Iterator[tuple[int, int, bool, list[int]]]:
    """token, parent, wording and SUMS of one page; chars and linked of a tag are those below it, wins tells that it holds most of its parent's text outside links."""
    opened, blocks = read(html, names)
    tags: dict[int, list] = {0: [1, None, False, 0, 0]}
    for f in opened:
        tags.setdefault(f.path, [0, f.up.path, f.unwanted, 0, 0])[0] += 1
    texts: dict[tuple[int, str], list[int]] = {}
    for frame, text, linked in blocks:
        linked = min(linked, len(text))
        texts.setdefault((frame.path, text), [0, 0])
        texts[frame.path, text][0] += 1
        texts[frame.path, text][1] += linked
        frame.held += len(text)
        frame.linked += linked
        if not frame.path:
            tags[0][3] += len(text)
            tags[0][4] += linked
    for f in reversed(opened):  # inner tags come after those around them
        tags[f.path][3] += f.held
        tags[f.path][4] += f.linked
        if f.up.path:
            f.up.held += f.held
            f.up.linked += f.linked
        else:
            tags[0][3] += f.held
            tags[0][4] += f.linked
    for path, (n, up, named, chars, linked) in tags.items():
        over = tags[up] if up is not None else None
        wins = over is not None and 2 * (chars - linked) > over[3] - over[4]
        yield path, up or 0, False, [1, n, token_hash("vector", str(digest), str(n)), int(wins), chars, linked, int(named)]
    for (path, text), (n, linked) in texts.items():
        yield token_hash(str(path), text), path, True, [1, n, token_hash("vector", str(digest), str(n)), 0, n * len(text), linked, 0]


def _tallies(pages: DataFrame, names: bool) -> DataFrame:
    """site, token, parent, wording, SUMS over the pages that a task reads."""
    schema = pa.schema([("site", pa.int64()), ("token", pa.int64()), ("parent", pa.int64()), ("wording", pa.bool_()), *((c, pa.int64()) for c in SUMS)])

    def rows(sums: dict[tuple, list[int]]) -> pa.RecordBatch:
        whole = [(*k, *v[:2], (v[2] + 2**63) % 2**64 - 2**63, *v[3:]) for k, v in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in whole], f.type) for j, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[int]] = {}
        for batch in batches:
            for site, digest, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for token, parent, wording, of_page in tally(html or "", digest, names):
                    s = sums.get((site, token, parent, wording))
                    sums[site, token, parent, wording] = of_page if s is None else [x + y for x, y in zip(s, of_page, strict=True)]
                if len(sums) > 100_000:
                    yield rows(sums)
        yield rows(sums)

    return pages.select("site", "digest", "html").mapInArrow(run, "site long, token long, parent long, wording boolean, " + ", ".join(f"{c} long" for c in SUMS))


TEMPLATE = "wording array<long>, slots array<long>, route array<long>, menus array<long>, notices array<long>, copies boolean"


def nested(tokens: pd.DataFrame) -> pd.DataFrame:
    """The template of one host from its supported tokens: valid classes from the root on, the way to the article, and what slots hold."""
    children: dict[int, list] = {}
    for t in tokens[(tokens.token != 0) & ~tokens.wording].itertuples():
        children.setdefault(t.parent, []).append(t)
    held = {t.token: t for t in tokens[~tokens.wording].itertuples()}
    slots, menus, notices, own, recurring, todo = {0}, [], [], {}, {}, [0]
    while todo:
        tag = todo.pop()
        chars, linked = held[tag].chars, held[tag].linked
        for t in children.get(tag, []):
            chars, linked = chars - t.chars, linked - t.linked
            if t.token not in slots:
                slots.add(t.token)
                todo.append(t.token)
        own[tag], recurring[tag] = chars, min(held[tag].recurring, chars)
        if chars > 0 and linked >= LINKED * chars:
            menus.append(tag)
        if chars > 0 and recurring[tag] >= RECURRING * chars and held[tag].pages > LEAST_PAGES:
            notices.append(tag)
    route, ends, todo = [], [], [0]
    while todo:
        tag = todo.pop()
        # A class of tags once a page, with tags of its own (a paragraph is no article), that holds most of the text around it.
        inner = [t for t in children.get(tag, []) if t.total <= ONCE * t.pages and 2 * t.wins >= t.pages and not t.named and children.get(t.token)]
        route += [t.token for t in inner]
        todo += [t.token for t in inner]
        if not inner:
            ends.append(tag)
    below, todo = set(), list(ends)
    while todo:
        tag = todo.pop()
        if tag not in below:
            below.add(tag)
            todo += [t.token for t in children.get(tag, [])]
    inside = sum(own[t] for t in below)
    copies = inside < held[0].chars and sum(recurring[t] for t in below) > COPIES * inside
    wording = [t.token for t in tokens[tokens.wording].itertuples() if t.parent in slots]
    return pd.DataFrame({"site": [tokens.site.iloc[0]], "wording": [wording], "slots": [sorted(slots)], "route": [sorted(route)], "menus": [menus], "notices": [notices], "copies": [copies]})


def templates(pages: DataFrame, *, names: bool = True) -> DataFrame:
    """site (hash of the host), wording, slots, route, menus, notices, copies: each host's template."""
    sums = [F.sum(c).alias(c) for c in SUMS if c != "vector"] + [F.sum(F.col("vector").cast("decimal(38,0)")).cast("string").alias("vector")]
    tokens = written(_tallies(_different(pages), names).groupBy("site", "token", "wording").agg(F.max("parent").alias("parent"), *sums).filter(f"pages >= {LEAST_PAGES}"), "tokens")
    size = tokens.filter("token = 0 and not wording").select("site", F.col("pages").alias("n"))
    tokens_of = joined_by_id(tokens, size, "site", "inner")
    words_of = tokens_of.filter("wording")
    recurring = words_of.groupBy("site", F.col("parent").alias("token")).agg(F.sum("chars").alias("recurring"))
    tags = written(tokens_of.filter(f"not wording and pages >= {OPTIONAL} * n").join(recurring, ["site", "token"], "left").fillna(0, ["recurring"]), "tags")
    around = tags.select("site", F.col("token").alias("parent"), F.struct("pages", "total", "vector").alias("around"))
    same = words_of.join(around, ["site", "parent"]).filter(f"(pages = around.pages and total = around.total and vector = around.vector) or (pages > {LEAST_PAGES} and pages >= {SUPPORT} * n)")
    columns = ["site", "token", "parent", "wording", "pages", "total", "wins", "chars", "linked"]
    supported = written(tags.select(*columns, (F.col("named") >= F.col("pages")).alias("named"), "recurring").unionByName(same.select(*columns).withColumns({"named": F.lit(False), "recurring": F.lit(0).cast("long")})), "supported")
    out = written(supported.groupBy("site").applyInPandas(nested, f"site long, {TEMPLATE}"), "templates")
    for table in (tokens, tags, supported):
        dropped(table)
    return out


class Template:
    """A host's template as sets; ``known`` if the host has one."""

    def __init__(self, wording: list = (), slots: list = (), route: list = (), menus: list = (), notices: list = (), copies: bool = False) -> None:
        self.wording, self.slots, self.route, self.menus, self.notices = map(frozenset, (wording, [*slots, 0], route, menus, notices))
        self.copies = copies


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def main_text(html: str, template: Template, names: bool = True) -> str:
    """The article's blocks, joined by newlines."""
    opened, blocks = read(html, names)
    on_way = {f.path: f for f in opened if f.path in template.route}
    passed = {f.up.path for f in on_way.values()}
    ends = {path: f for path, f in on_way.items() if path not in passed}
    around: set[int] = set()  # paths of tags around an end
    for f in ends.values():
        up = f.up
        while up and up.path not in around:
            around.add(up.path)
            up = up.up
    bare = {f.path for f in opened if f.tag in ("html", "body")} | {0}
    whole = names and any(f.main for f in ends.values())
    for f in opened:
        f.slot = f.path if f.path in template.slots else f.up.slot
        f.inside = f.up.inside or f.path in ends or (f.tag in HEADINGS and f.up.path in around and f.up.path not in bare)

    def inside(frame: Frame) -> bool:
        return not ends or frame.inside or (whole and frame.main)

    def varies(frame: Frame, text: str) -> bool:
        return not (token_hash(str(frame.path), text) in template.wording or (frame.slot in template.notices and frame.tag not in HEADINGS))

    def of_article(frame: Frame) -> bool:
        """Inside the article wording stays, on however many pages it stands; where no tag says that it is one, slots of notices go, unless pages are copies."""
        return frame.main or (frame.inside and (template.copies or frame.tag in HEADINGS or frame.slot not in template.notices))

    kept = [(f, t) for f, t, linked in blocks if inside(f) and not f.bad and not (names and f.unwanted) and not (linked >= LINKED * len(t) and f.slot in template.menus and not f.main)]
    if names and any(f.main for f, _ in kept):
        kept = [(f, t) for f, t in kept if f.main]
    if template.wording or template.notices:
        kept = [(f, t) for f, t in kept if varies(f, t) or of_article(f)] or kept
    return "\n".join(t for _, t in kept)


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", names: bool = True) -> DataFrame:
    """key, url, text, n_chars of every page; ``names``: whether names of structure break ties."""
    source = pages.select(pages[key].cast("long").alias("page"), pages[url].cast("string").alias("url"), urls.host(pages[url]).alias("host"), F.coalesce(pages[html].cast("string"), F.lit("")).alias("html"))
    template = templates(source, names=names)
    schema = pa.schema([(key, pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Template] = {}
        for batch in batches:
            for part in words.slices(batch, name="html"):
                texts = []
                for i, (site, html) in enumerate(zip(part.column(3).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    if site not in known:
                        if len(known) == 100:
                            known.clear()
                        of_host = [part.column(j)[i].as_py() for j in range(4, 10)]
                        known[site] = Template() if of_host[1] is None else Template(*of_host)
                    texts.append(main_text(html, known[site], names))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    met = source.withColumn("site", F.when(F.col("host") != "", F.xxhash64("host"))).join(template, "site", "left").select("page", "url", "html", "site", *template.columns[1:])
    return met.mapInArrow(run, f"{key} long, url string, text string, n_chars long")
