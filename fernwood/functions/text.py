"""Text expressions, all on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"(?U)\W+"
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Signs stripped from both ends of a token.
EDGE_SIGNS = ".,;:()[]{}'\""
#: Article kinds and the phrases that tell them, first match first.
ARTICLE_KINDS = [
    ("meta_analysis", "meta-analysis|meta analysis"), ("systematic_review", "systematic review"), ("rct", "randomized|randomised"), ("case_control", "case-control|case control"), ("cohort", "cohort"),
    ("case_report", "case report"), ("editorial", "editorial"), ("letter", "letter to|letter:"), ("guideline", "guideline|consensus"), ("preprint", "preprint|biorxiv|medrxiv"),
]
#: Words that say nothing about a title.


def tokens(text: Column) -> Column:
    """Lower-case words with repeats, as written."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")  # what stands between other signs; no match object a word


def folded(text: Column) -> Column:
    """Lower case without accents, as the lexical index has it."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def substring_hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms (repeats count) stand anywhere in the text."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(t)).cast("bigint") for t in terms), F.lit(0).cast("bigint"))


def singular(token: Column) -> Column:
    n = F.length(token)
    return (
        F.when(token.endswith("ies") & (n > 4), F.concat(token.substr(F.lit(1), n - 3), F.lit("y")))
        .when(token.endswith("es") & (n > 3) & ~token.endswith("oes"), token.substr(F.lit(1), n - 2))
        .when(token.endswith("s") & (n > 3) & ~(token.endswith("es") & ~token.endswith("oes")), token.substr(F.lit(1), n - 1))
        .otherwise(token)
    )


def normal_tokens(words: Column) -> Column:
    """Distinct tokens in lower case, without signs at their ends, in the singular; single letters go."""
    bare = F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(EDGE_SIGNS)))
    return F.array_distinct(F.transform(F.filter(bare, lambda w: F.length(w) > 1), singular))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def article_kind(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(low.rlike(ARTICLE_KINDS[0][1]), ARTICLE_KINDS[0][0])
    for kind, phrases in ARTICLE_KINDS[1:]:
        out = out.when(low.rlike(phrases), kind)
    return out.otherwise("unknown")


def token_estimate(text: Column) -> Column:
    """ceil((3 * ASCII characters + 8 * others) / 12)."""
    n = F.length(text).cast("bigint")
    ascii_n = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")).cast("bigint")
    return F.floor((3 * ascii_n + 8 * (n - ascii_n) + 11) / 12).cast("bigint")


def web_identifier(url: Column) -> Column:
    """A URL with scheme and host in lower case and at least a slash for a path; null if it is none."""
    parts = r"^([A-Za-z]+)://([^/?#@\s]+)([^?#\s]*)([^\s]*)$"
    scheme, host, path, rest = (F.regexp_extract(url, parts, i) for i in range(1, 5))
    ok = F.lower(scheme).isin("http", "https")
    return F.when(ok, F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(path == "", "/").otherwise(path), rest))


#: The forms of identifiers.
IDENTIFIERS = {"doi": r"^(?:(?i)https://doi\.org/)?(10\.[0-9]{4,9}/\S+)$", "pmid": r"^([1-9][0-9]{0,11})$", "pmcid": r"^(PMC[1-9][0-9]{0,11})$"}


def identifier(scheme: Column, raw: Column) -> Column:
    """The key under which an identifier (doi, pmid, pmcid or url) is looked up; null if it has not the form of its scheme. DOIs lose their resolver and are lower case."""
    ok = (raw == F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")) & F.length(raw).between(1, 4096)
    out = F.when(scheme == "url", web_identifier(raw))
    for name, form in IDENTIFIERS.items():
        key = F.nullif(F.regexp_extract(raw, form, 1), F.lit(""))
        out = out.when(scheme == name, F.lower(key) if name == "doi" else key)
    return F.when(ok, out)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def snippet(text: Column, keywords: list[str], target: int = 50) -> Column:
    """(snippet, source): the first sentence if its length suits, else a window around the first keyword, else the head up to a word's end.

    A sentence ends at a mark before white space, or at a line's end, not among the first ten characters; the last end
    up to ten characters beyond ``target`` counts. Cuts fall on an end or a blank near ``target``.
    """
    end = r"(?:[.!?](?=[ \n\t]|\z)|\n(?=.))"
    cap, most, low, high = target + 10, target + 15, target - 10, target + 10
    none = F.lit("")
    near = F.regexp_extract(text, rf"(?s)\A(.{{10,{cap - 1}}}{end})", 1)
    later = F.regexp_extract(text, rf"(?s)\A(.{{{cap},{2 * most}}}?{end})", 1)
    endless = ~F.rlike(text, F.lit(rf"(?s)\A.{{10}}.*?{end}"))
    first = stripped(F.when(near != none, near).when(endless, text).otherwise(later))

    def tidy(x: Column) -> Column:
        return stripped(F.regexp_replace(x, "[,;:-]+$", ""))

    def trimmed(x: Column) -> Column:
        at_mark, at_line, at_blank = (F.regexp_extract(x, p, 1) for p in (rf"(?s)\A(.{{{target},{high - 1}}}?[.!?]) ", rf"(?s)\A(.{{{low + 1},{target - 1}}})\n", rf"(?s)\A(.{{{low},{high - 1}}}) "))
        hard = F.concat(tidy(x.substr(F.lit(1), F.lit(target))), F.lit("..."))
        cut = F.when(F.length(x) <= target + 5, x).when(at_mark != none, stripped(at_mark)).when(at_line != none, stripped(at_line)).when(at_blank != none, tidy(at_blank)).otherwise(hard)
        return F.when(F.length(x).between(20, most), cut)

    def shortened(size: int) -> Callable[[Column], Column]:
        return lambda at: around(at, F.greatest(at - half, F.lit(0)), F.least(at + size + half, F.length(text)))

    def around(at: Column, start: Column, stop: Column) -> Column:
        def tail(window: Column) -> Column:
            last = F.length(window) - F.instr(F.reverse(window), " ")
            some = (F.instr(window, " ") > 0) & (last > 0) & (last < F.length(window) - 3)
            return F.when((stop < F.length(text)) & some, F.concat(window.substr(F.lit(1), last), F.lit("..."))).otherwise(window)

        def begun(window: Column) -> Column:
            blank = F.instr(window, " ") - 1
            return F.when((start > 0) & (blank > 0) & (blank < F.length(window) - 5), F.concat(F.lit("..."), window.substr(blank + 2, F.length(window)))).otherwise(window)

        return F.when(at >= 0, bound(bound(stripped(text.substr(start + 1, stop - start)), begun), tail))

    lower, half = F.lower(text), target // 2
    windows = [bound(F.instr(lower, F.lit(k.lower())) - 1, shortened(len(k))) for k in keywords if k]
    window = F.coalesce(*windows) if windows else F.lit(None).cast("string")
    head = F.regexp_extract(text, rf"(?s)\A(.{{{low},{target + 4}}}) ", 1)
    fallback = F.when(F.length(text) <= target, text).otherwise(F.concat(tidy(F.when(head != none, head).otherwise(text.substr(F.lit(1), F.lit(target)))), F.lit("...")))
    empty = F.coalesce(text, none) == none

    def chosen(sentence: Column) -> Column:
        def told(x: Column) -> Column:
            source = F.when(empty, "fallback_short").when(sentence.isNotNull(), "first_sentence").when(x.isNotNull(), "keyword_window").otherwise("fallback_short")
            return F.struct(F.when(empty, none).otherwise(F.coalesce(sentence, x, fallback)).alias("snippet"), source.alias("source"))

        return bound(F.when(sentence.isNull(), window), told)

    return bound(bound(first, trimmed), chosen)
