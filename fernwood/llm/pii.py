"""Personal data by regular expressions, checksum validators and context words, in DataFrame functions only.

Expressions propose spans; validators (Luhn, mod 97, octet range, digit counts, number plan rules) confirm them; words
near a span raise its score. Four kinds (email, ip, card, phone) are always reported once valid. The kinds that the
method adds (iban, ssn) need a score of ``THRESHOLD``: an IBAN's checksum is enough, a social security number needs a
context word within ``NEAR`` characters.

Positions: the text between matches (``split``) and the matches (``regexp_extract_all``) alternate, so running sums of
their lengths give starts and ends in code points. The expressions are written so that a scan is linear: an attempt
may start only where a run starts or the last match ended, quantifiers are possessive, and lengths that a validator
would refuse anyway are refused by a look-ahead over the maximal run, so that long runs of digits are no match.

Defined cases: a null or empty text has no spans; spans of one kind don't overlap, those of different kinds may; equal
rows get equal answers; null keys stay; an empty table gives no rows; other columns stay untouched (``with_spans``
replaces a column named ``spans``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTED = ("email", "ip", "card", "phone", "iban", "ssn")  # order of kinds that start together
RUN = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{RUN})|\G){RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheap test that a text must pass before positions are worked out.
HINTS = {"email": "@", "phone": "+"}
CONTEXT = {
    "email": "e-?mail|contact|mailto|courriel|correo",
    "ip": "\\bip\\b|address|server|host|adresse",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|handy|móvil",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id|national id",
}
BASE_SCORE = {"email": 0.8, "ip": 0.7, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT_BONUS = 0.2
THRESHOLD = 0.5
NEAR = 40
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double,value:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    row = F.transform(F.split(F.reverse(digits(value)), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2).cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(row, F.lit(0), lambda acc, d: acc + F.coalesce(d.cast("int"), F.lit(0))) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether ``value``, without spaces, passes the ISO 7064 mod 97-10 check of an IBAN."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        n = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(c == "", acc).otherwise((acc * F.when(n > 9, 100).otherwise(10) + n) % 97).cast("int")

    return (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1) & F.length(plain).between(15, 34)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: F.coalesce(F.ltrim(p, F.lit("0")).try_cast("long"), F.length(F.ltrim(p, F.lit("0"))).cast("long") * 256) <= 255)
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "ssn":
        return ~value.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def found(text: Column, kind: str) -> Column:
    """The valid spans of one kind in ``text``."""
    pattern = PATTERNS[kind]
    none = F.array().cast(SPAN)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("gap"), matches.alias("value"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        return F.struct(end.cast("bigint").alias("at"), F.array_append(acc["out"], F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"), x["value"].alias("value"))).alias("out"))

    located = F.filter(F.aggregate(both, start, step, lambda acc: acc["out"]), lambda s: valid(kind, s["value"]))

    def scored(s: Column) -> Column:
        begin = F.greatest(s["start"] - NEAR, F.lit(0))
        around = F.concat(text.substr((begin + 1).cast("int"), (s["start"] - begin).cast("int")), F.lit(" "), text.substr((s["end"] + 1).cast("int"), F.lit(NEAR)))
        score = F.lit(BASE_SCORE[kind]) + F.when(F.lower(around).rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"), s["value"].alias("value"))

    spans = F.transform(located, scored)
    if kind in ("iban", "ssn"):
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    maybe = text.rlike(pattern)
    if kind in HINTS:
        maybe = F.contains(text, F.lit(HINTS[kind])) & maybe
    return F.coalesce(F.when(maybe, spans), none)


def ordered(spans: Column) -> Column:
    """Spans by start, then by kind as listed."""
    key = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, LISTED)), s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score"), s["value"].alias("value")))
    return F.transform(F.array_sort(key), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["value"].alias("value")))


def with_spans(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with a column ``spans``: array of (kind, start, end, score, value), by start, then kind as listed."""
    kinds = {f"_pii_{k}": found(F.coalesce(docs[text].cast("string"), F.lit("")), k) for k in LISTED}
    out = docs.withColumns(kinds)
    return out.withColumn("spans", ordered(F.concat(*kinds))).drop(*kinds)


def named(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span (ordered, overlaps merged) replaced by its kind in angle brackets."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def digest(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts by kind and n_spans of all, base_sha256, spans (as text) and their scores of every document."""
    got = with_spans(docs.select(docs[key].alias(key), docs[text].alias("text"))).select(key, "spans")
    base = F.filter("spans", lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    counts = [F.size(F.filter("spans", of_kind(k))).cast("bigint").alias(f"n_{k}") for k in LISTED]
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores")
    return got.select(F.col(key), *counts, F.size("spans").cast("bigint").alias("n_spans"), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), scores)
