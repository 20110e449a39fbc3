"""How far the sources of a language differ in their words: an audit over duplicate-collapsed texts.

1. Collapse. Every task sends a text's bytes once, and for each batch how often each source holds it, to the partition of its
   (lang, digest). There the copies from all tasks lie together in sorted order, so each distinct text of a language is tokenized once.
2. Tally. A distinct text's term counts are multiplied by the copies of each source: weighted document frequencies and counts.
   Tasks keep at most ``FLUSH`` sums before they pass them on to a common aggregation.
3. Rates. A language keeps the terms in at least ``least`` of its documents. A group is a (lang, source); its rate of a kept term
   is p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in exact arithmetic; a term that it does not hold has its base rate (count 0).
4. Sparse pairs. The sum of abs(p - q) over all V terms is V times the difference of base rates plus corrections at the terms that
   one of the two holds. Kept terms are dealt to blocks; a block is a matrix of sources and terms of at most ``CELLS`` entries, in which each source
   is compared with all others at its own terms only. Blocks return one row for each pair of sources, which are added up.

Nothing grows with a text's copies, a source's share or a term's frequency but sums: a hot text makes one row a batch and source,
a hot term at most one row a source.

Defined cases: null text, lang and source are ''; empty texts hold no term but make their (lang, source) a group; rows repeated
count each; a language without kept terms has pairs of value 0 and no terms; a language of one source has no pairs; no rows give
none; columns but text, lang and source are ignored, whatever their names. Ranks break ties by item in UTF-8 order.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, written
from .words import slices

LEAST = 30  # documents of the language that hold a kept term
SHOWN = 50  # terms of a group in the report
FLUSH = 500_000  # sums that a task holds
CELLS = 2_000_000  # entries of one block's matrix
MOST_TERMS = 8_192  # of a block
SMALL_GROUPS = 100_000  # (lang, source) rows that may go to all executors, under 10 MB; they are counted

#: Term characters are ASCII letters, of which capitals become small ones, and all bytes of other code points; the rest parts terms.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in bytes(range(256)).lower())


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def _collapsed(docs: DataFrame) -> DataFrame:
    """lang, source, digest, n, body: for every batch of a task the copies of each text by source; the body comes with the first row that a task has of it."""
    source = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kinds = (("lang", pa.string()), ("source", pa.string()), ("digest", pa.binary()), ("n", pa.int64()), ("body", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[str, bytes]] = set()
        for batch in batches:
            for part in slices(batch):
                bodies = part.column(0).cast(pa.binary() if part.column(0).type == pa.string() else pa.large_binary()).to_pylist()
                copies: Counter = Counter()
                first: dict[tuple[str, bytes], bytes] = {}
                for body, lang, name in zip(bodies, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    digest = hashlib.blake2b(body, digest_size=16).digest()
                    copies[lang, name, digest] += 1
                    if (lang, digest) not in sent:
                        sent.add((lang, digest))
                        first[lang, digest] = body
                rows = [(lang, name, digest, n, first.pop((lang, digest), None)) for (lang, name, digest), n in copies.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, (_, kind) in enumerate(kinds)], names=[k for k, _ in kinds])

    return source.mapInArrow(run, "lang string, source string, digest binary, n long, body binary")


def _tallied(collapsed: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: sums over the distinct texts of a partition; every group also has a row without a term."""
    names = ("lang", "source", "term", "count", "docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}
        held = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for group, own in counts.items():
                found = sorted(own)  # neighbours share beginnings, which packs well
                columns = [*(pa.array([g] * len(found), pa.string()) for g in group), pa.array([t.decode("utf-8", "replace") for t in found], pa.string()),
                           pa.array([own[t] for t in found], pa.int64()), pa.array([docs[group][t] for t in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            counts.clear()
            docs.clear()

        def tally(lang: str, body: bytes, copies: Counter) -> int:
            words = terms(body)
            of_text = Counter(words)
            for name, n in copies.items():
                own, df = counts.setdefault((lang, name), Counter()), docs.setdefault((lang, name), Counter())
                if n == 1:
                    own.update(of_text)
                    df.update(of_text.keys())
                else:
                    for t, c in of_text.items():
                        own[t] += n * c
                        df[t] += n
            return len(of_text) * len(copies)

        groups: set[tuple[str, str]] = set()
        key, body, copies = None, b"", Counter()
        for batch in batches:
            for lang, name, digest, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, digest) != key:
                    if key is not None:
                        held += tally(key[0], body, copies)
                        if held > FLUSH:
                            yield from flushed()
                            held = 0
                    key, body, copies = (lang, digest), text, Counter()
                copies[name] += n
                groups.add((lang, name))
        if key is not None:
            tally(key[0], body, copies)
        yield from flushed()
        yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in groups], pa.string()) for j in (0, 1)] + [pa.nulls(len(groups), t) for t in (pa.string(), pa.int64(), pa.int64())], names=names)

    return collapsed.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs of all terms, each distinct text of a language tokenized once; with them a row without a term for every (lang, source)."""
    near = _collapsed(docs).repartition("lang", "digest").sortWithinPartitions("lang", "digest", F.col("body").isNull())
    # Dealt by term, so what follows by source and then by term needs no other shuffle; tasks have added up before, and a hot term is a row for each task and source.
    return _tallied(near).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _rate(count: str) -> str:
    return f"1 + (1000000000BD * cast({count} + 5 as decimal(20,0))) div cast(N + 5 * V as decimal(20,0))"


def _pair_sums(spread: DataFrame, sources: DataFrame) -> DataFrame:
    """lang, a, b, part: what the terms of one block add to the pair of sources numbered a < b, beside the difference of base rates at all of them."""

    def block(_: tuple, members: pa.Table, cells: pa.Table) -> pa.Table:
        size = members.num_rows
        lang = members.column("of_lang")[0].as_py() if size else ""
        sids = np.array(members.column("sid").to_pylist(), np.int64)
        base = np.array(members.column("base").to_pylist(), np.int64)
        order = np.argsort(sids)
        sids, base = sids[order], base[order]
        held = cells.column("held").combine_chunks()
        held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
        of_term = np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()))
        who = np.searchsorted(sids, held.flatten().field("sid").to_numpy())
        rate = np.tile(base[:, None], (1, len(held)))
        mine = np.zeros((size, len(held)), bool)
        rate[who, of_term] = held.flatten().field("p").to_numpy()
        mine[who, of_term] = True
        part = np.zeros((size, size), np.int64)
        for g in range(size):
            at = np.flatnonzero(mine[g])
            off = np.abs(rate[:, at] - rate[g, at]) - np.abs(base - base[g])[:, None]
            part[g] += off.sum(axis=1)  # terms that g holds; those that both hold are met from both sides
            part[g, :g] -= np.where(mine[:g, at], off[:g], 0).sum(axis=1)
        both = part + part.T
        a, b = np.triu_indices(size, 1)
        return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(sids[a]), pa.array(sids[b]), pa.array(both[a, b])], names=["lang", "a", "b", "part"])

    blocks = spread.select("lang", "block").distinct().join(sources, "lang").select(F.col("lang").alias("of_lang"), F.col("block").alias("of_block"), "sid", "base")
    return blocks.groupBy("of_lang", "of_block").cogroup(spread.groupBy("lang", "block")).applyInArrow(block, "lang string, a long, b long, part long")


def audit(docs: DataFrame, *, least: int = LEAST, shown: int = SHOWN) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language by its distance (``pair``), and the first ``shown`` terms that a source uses more than its language (``term``)."""
    held = F.collect_list(F.struct("source", "count")).alias("held")  # one entry a source
    per_term = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("count").alias("all"), held)
    tallies = written(per_term.filter(F.col("term").isNull() | (F.col("df") >= least)), "tallies")
    kept = tallies.filter("term is not null")
    cells = kept.select("lang", "term", "all", F.explode("held").alias("h")).select("lang", "term", "all", "h.source", F.col("h.count").alias("count"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("V"), F.sum("all").alias("L"))
    own = cells.groupBy("lang", "source").agg(F.sum("count").alias("N"))
    names = tallies.filter("term is null").select("lang", F.explode("held.source").alias("source")).join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["N", "V", "L"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long").alias("sid")  # one row a source
    groups = written(names.select("*", number).withColumn("base", F.expr(f"if(V > 0, {_rate('0')}, 0)")), "groups")
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    small = groups.count() <= SMALL_GROUPS
    beside = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    rated = cells.join(beside(groups.drop("base")), ["lang", "source"]).withColumn("p", F.expr(_rate("count")))

    whole = F.expr(_rate("all").replace("N +", "L +"))
    over = rated.withColumn("q", whole).filter("count > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = over.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= shown)

    per_block = max(1, min(MOST_TERMS, CELLS // widest))
    numbered = rated.select("lang", "term", F.struct("sid", "p").alias("x"), "V").groupBy("lang", "term", "V").agg(F.collect_list("x").alias("held"))
    spread = numbered.select("lang", F.pmod(F.xxhash64("term"), F.ceil(F.col("V") / (0.9 * per_block))).alias("block"), "held")
    sums = _pair_sums(written(spread, "spread"), groups.filter("V > 0").select("lang", "sid", "base")).groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    sums = written(sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("sid"), F.col("b").alias("other")), F.struct(F.col("b").alias("sid"), F.col("a").alias("other")))).alias("s"), "part").select("lang", "s.*", "part"), "sums")
    left = groups.select("lang", "source", "sid", "base", "V")
    right = groups.select("lang", F.col("source").alias("item"), F.col("sid").alias("other"), F.col("base").alias("their"))
    both = left.join(right, "lang").filter("sid <> other").join(sums, ["lang", "sid", "other"], "left")  # the result's own rows
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("V") * F.abs(F.col("base") - F.col("their")) + F.coalesce("part", F.lit(0))).alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(first))
    return ranked.unionByName(top).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
