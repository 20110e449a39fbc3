"""URL rules: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

A rule is a host and a path, like ``example.com/en/``. It fits a URL whose host is the rule's or a subdomain of it and
whose path starts with the rule's; the longest fitting rule wins. A URL's canonical forms are its host's suffixes at
label borders joined with its path's prefixes at slashes; a rule is listed under its path up to the last slash, so a
fitting rule's canonical form is always among the URL's. The filter has blocks of 256 bits; a form sets or tests one
bit in each 64-bit word of one block, so a test reads one row of the filter's table. Forms that pass meet the rules in
an equality join, which drops false positives, and the rest of the rule's path is compared as text. Forms with more labels
or slashes than any rule has are not made, so a URL of any length costs its own length.

Up to ``BROADCAST_RULES`` rules, which are counted, and their filter go to all executors; more, and then the filter has as many
blocks as to spread the URLs, meet them in shuffles. URLs without a host take no part in the joins.

Defined cases: a null URL or one without ``://`` has empty host and path, no rule and the default verdict; equal URLs
get equal verdicts, whatever their rows; rules that are null or have no slash are ignored, of equal rules the one with
verdict allow counts; an empty table gives no rows; other columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "(?s)://([^/?#]*)([^?#]*)"
WORDS = 4  # 64-bit words of a block
BITS_A_KEY = 16
BROADCAST_RULES = 200_000  # counted rules up to which they and their filter are sent to all executors


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """The canonical forms of a URL with up to so many labels of the host and slashes of the path: host suffixes x path prefixes."""
    last = F.split(F.substring_index(host, ".", -labels), "\\.")
    pieces = F.split(path, "/", slashes + 1)
    hosts = F.transform(last, lambda x, i: F.array_join(F.slice(last, i + 1, F.size(last)), "."))
    paths = F.transform(pieces, lambda x, i: F.concat(F.array_join(F.slice(pieces, F.lit(1), i), "/"), F.when(i > 0, "/").otherwise("")))
    both = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    return F.array_distinct(both)


def _block(form: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(form), F.lit(blocks))


def _bit(form: Column, word: int) -> Column:
    return F.pmod(F.xxhash64(form, F.lit(word)), F.lit(64)).cast("int")


def bloom(forms: DataFrame, form: str, blocks: int) -> DataFrame:
    """block, w0..w3: the filter of a column of forms."""
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col(form), k))).alias(f"w{k}") for k in range(WORDS)]
    return forms.groupBy(_block(F.col(form), blocks).alias("block")).agg(*words)


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", carry: list[str] | None = None, default: str = "allow") -> DataFrame:
    """``carry`` columns of ``pages`` with host, path, rule, verdict; ``rules`` has rule (like ``net/es/``) and verdict (allow or block)."""
    listed = (
        rules.filter("rule like '%/%'")
        .groupBy("rule").agg(F.min("verdict").alias("verdict"))
        .select("rule", "verdict", F.regexp_replace("rule", "[^/]*$", "").alias("form"), F.regexp_extract("rule", "(?s)^[^/]*(/.*)$", 1).alias("start"))
    )
    # No rule is longer than these, so no longer form of a URL can be listed.
    form_host, form_slashes = F.substring_index("form", "/", 1), F.length("form") - F.length(F.translate("form", "/", ""))
    n, labels, slashes = listed.agg(F.count("*"), F.coalesce(F.max(F.size(F.split(form_host, "\\."))), F.lit(1)), F.coalesce(F.max(form_slashes), F.lit(1))).first()
    blocks = 1 << max(0, math.ceil(math.log2(max(1, n) * BITS_A_KEY / (64 * WORDS))))
    filter_rows = bloom(listed, "form", blocks)
    if n <= BROADCAST_RULES:
        filter_rows, listed = F.broadcast(filter_rows), F.broadcast(listed)
    keep = [c for c in (pages.columns if carry is None else carry) if c not in ("host", "path", "rule", "verdict")]
    base = pages.select(host(pages[url]).alias("host"), path(pages[url]).alias("path"), F.struct(*(pages[c] for c in keep)).alias("kept"))
    distinct = base.select("host", "path").filter("host <> ''").distinct()
    forms = distinct.select("host", "path", F.explode(canonical(F.col("host"), F.col("path"), labels, slashes)).alias("form")).withColumn("block", _block(F.col("form"), blocks))
    passes = " and ".join(f"getbit(w{k}, _b{k}) = 1" for k in range(WORDS))
    possible = forms.withColumns({f"_b{k}": _bit(F.col("form"), k) for k in range(WORDS)}).join(filter_rows, "block").filter(passes).select("host", "path", "form")
    hits = possible.join(listed, "form").filter(F.startswith("path", "start"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best"))
    judged = base.filter("host <> ''").join(best, ["host", "path"], "left")
    whole = judged.unionByName(base.filter("host = ''").withColumn("best", F.lit(None).cast(best.schema["best"].dataType)))
    return whole.select(*(F.col("kept")[c].alias(c) for c in keep), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
