"""A kept lexical index that follows its table: postings in segments, tombstones, compaction, and block maxima for top-k.

``kept`` brings an index up to date. Where the table's files are those of the last time, nothing is read. Else the texts' hashes are
compared with the ledger of (owner, hash), and only new and edited owners are tokenized, into a segment of their own; owners that were edited or
deleted put the units of older segments on a list of the dead. More than ``MOST_SEGMENTS`` segments, or as many dead as a quarter of the
units, are merged from the postings alone. Every change is one commit (``snapshots``): readers keep the version that they opened.

A unit is what is found: a document, or a piece of one. Units of a segment are numbered by length within each task and 128 of them in turn are a span. A
block is the units of one span that hold one word, with the most that the word can add to a score. A task takes its units in runs of ``MOST_HELD`` bytes of words; a posting row
holds a word's blocks and units in one run. A span lies in one task, so rows are made where their words are: nothing is shuffled, and Spark sorts none of it. The rows of a run are
in the order of terms, so a query reads the pages of its terms in every run. A block may be split in two: sums, marks and bounds hold for that too.

``topk`` adds the blocks' maxima up for each span, scores the best spans, and scores the units of other spans only where their sum can
still reach the k-th score: the result is that of scoring everything. ``matches`` scores all units with a hit.

Defined cases: null texts have no words, null owners are owners; owners in several rows are one owner with all their units; an empty table has an
empty index; queries without a word find nothing; repeated query words count again.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwood.functions import text as T
from fernwood.sources import scratch, snapshots
from fernwood.sources.scratch import dropped, written

K1, B = 1.2, 0.75
FORMAT = 3  # of segments; an index of another one is built anew
SPAN_BITS = 7  # a span is 2^7 units
SPAN = 1 << SPAN_BITS
MOST_HELD = 1 << 24  # bytes of words after which a task closes a run, be the span at its end or not
WIDEST = 1 << 31  # numbers of a run's units lie closer than that
SENT = 1 << 14  # posting rows that a task hands over at once
GROUP_BITS = 12  # a merge deals out 2^12 units together
MOST_SEGMENTS = 8
DEAD_SHARE = 4  # compaction at a dead unit in four
FIRST_SPANS = 32  # scored before the others are judged


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    folder: str
    manifest: dict

    @property
    def n(self) -> int:
        return self.manifest["n"]

    @property
    def average(self) -> float:
        return self.manifest["words"] / self.n if self.n and self.manifest["words"] else 1.0

    def _read(self, kind: str) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.folder}/{s['path']}/{kind}").withColumn("seg", F.lit(s["seg"]).cast("long")) for s in self.manifest["segments"]]
        return reduce(DataFrame.unionByName, parts)

    def _live(self, df: DataFrame, on: list[str], dead: str) -> DataFrame:
        """Rows that no later segment has put away."""
        lists = [self.spark.read.parquet(f"{self.folder}/{s['path']}/{dead}") for s in self.manifest["segments"] if s["dead"]]
        return df.join(reduce(DataFrame.unionByName, lists), on, "left_anti") if lists else df

    def blocks(self) -> DataFrame:
        """seg, term, word, span, top: blocks, those of dead units included. Units are not read."""
        each = self._read("postings").select("seg", "term", "word", "base", F.inline(F.arrays_zip("spans", "tops")))
        return each.select("seg", "term", "word", (F.shiftright("base", SPAN_BITS) + F.col("spans")).alias("span"), F.col("tops").alias("top"))

    def postings(self) -> DataFrame:
        """seg, term, word, uid, tf, n_words: every word of every unit, those of dead units included."""
        return _each(self._read("postings"), ["term", "word"])

    def units(self) -> DataFrame:
        """seg, uid, owner, id, n_words of all live units."""
        return self._live(self._read("units"), ["seg", "uid"], "dead")

    def ledger(self) -> DataFrame:
        """owner, digest, seg of all live owners."""
        return self._live(self._read("ledger"), ["seg", "row"], "closed")

    def live(self, each: DataFrame) -> DataFrame:
        return self._live(each, ["seg", "uid"], "dead")


def _each(rows: DataFrame, keep: list[str]) -> DataFrame:
    """seg, ``keep``, uid, tf, n_words of the units of posting rows."""
    each = rows.select("seg", *keep, "base", F.inline(F.arrays_zip("units", "tfs", "lengths")))
    return each.select("seg", *keep, (F.col("base") + F.col("units")).alias("uid"), F.col("tfs").cast("long").alias("tf"), F.col("lengths").cast("long").alias("n_words"))


def fingerprint(df: DataFrame, key: str) -> DataFrame:
    """n, last, digest: what tells states of a table apart that only grows."""
    counts = df.agg(F.count("*").alias("n"), F.max(key).alias("last"))
    return counts.withColumn("digest", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.coalesce("last", F.lit(-1)).cast("string")), 256))


def runs(held: DataFrame, keep: list[str], words: str, name: str) -> DataFrame:
    """``keep``, ``name``, tf of every different word of the sorted array ``words``, counted within each row: nothing is shuffled."""
    begins = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (i == 1) | (F.element_at(words, i) != F.element_at(words, F.greatest(i - 1, F.lit(1)))))
    marked = held.filter(F.size(words) > 0).select(*keep, words, F.explode(F.array(begins)).alias("begins"))
    each = F.transform("begins", lambda b, k: F.struct(F.element_at(words, b).alias(name), (F.coalesce(F.try_element_at("begins", k + 2), F.size(words) + 1) - b).cast("bigint").alias("tf")))
    return marked.select(*keep, F.inline(each))


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, n_words, term, tf of every document's words."""
    held = docs.select(F.col(key).alias("id"), F.explode(F.array(F.sort_array(T.tokens(T.folded(F.col(text)))))).alias("words"))
    return runs(held.withColumn("n_words", F.size("words").cast("bigint")), ["id", "n_words"], "words", "term")


def _gain_of(tf, n_words, average: float):
    """What a word adds to a score per unit of its rarity; of numbers, arrays or columns."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_words / average))


def _gain(tf: Column, n_words: Column, average: float) -> Column:
    return _gain_of(tf.cast("double"), n_words, average)


def rarity(n: int, df: int) -> float:
    return max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) if n else 0.0


def query_terms(query: str) -> list[str]:
    return re.findall(r"\w+", query.lower())


# --- building ----------------------------------------------------------------------------------------------------


def _hashes(docs: DataFrame, text: str) -> DataFrame:
    """owner, digest: an owner's texts as a bag, 128 bits."""
    one = docs.select("owner", F.xxhash64(text).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b"))
    return one.groupBy("owner").agg(F.concat_ws(":", F.count("*"), F.sum("a"), F.bit_xor("b")).alias("digest"))


ROW = "word string, base long, spans array<int>, tops array<double>, units array<int>, tfs array<int>, lengths array<int>"
_SORTED_AS = str.maketrans(T.ACCENTED, T.PLAIN)


def _lists(bounds: np.ndarray, values: np.ndarray, kind: type) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(kind)))


def _runs(average: float, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, np.ndarray | pa.Array]]]:
    """From (uid, n_words, line, tf): the words of each run by term, their blocks, and the blocks' units. Each word of a line, set apart by blanks, counts ``tf``.

    A task may read several files, so a run also ends where uid falls or leaps. ``blocks`` and ``units`` say where those of a word begin and end, ``inside`` where the units of a block do.
    """

    def fold(rows: pa.Table) -> dict[str, np.ndarray | pa.Array]:
        split = pc.split_pattern(rows["line"], " ").combine_chunks()
        names = split.flatten().dictionary_encode()
        order = pc.sort_indices(pa.array([w if w.isascii() else w.translate(_SORTED_AS) for w in names.dictionary.to_pylist()], pa.string())).to_numpy()
        by_term = np.empty(len(order), np.int64)
        by_term[order] = np.arange(len(order))
        uid, repeats = rows["uid"].to_numpy(), pc.list_value_length(split).to_numpy()
        width = int(uid[-1] - uid[0]) + 1
        cells = by_term[names.indices.to_numpy()] * width + np.repeat(uid - uid[0], repeats)
        if (rows["tf"].to_numpy() == 1).all():
            cells, tf = np.unique(cells, return_counts=True)
        else:
            cells, which = np.unique(cells, return_inverse=True)
            tf = np.bincount(which, weights=np.repeat(rows["tf"].to_numpy(), repeats)).astype(np.int64)
        word, unit = np.divmod(cells, width)
        length = rows["n_words"].to_numpy()[np.searchsorted(uid, unit + uid[0])]
        span = (unit + uid[0]) >> SPAN_BITS
        begins = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(span, prepend=-1) != 0))
        ranks = np.arange(len(order) + 1)
        return {
            "words": names.dictionary.take(pa.array(order)), "base": uid[0], "blocks": np.searchsorted(word[begins], ranks), "units": np.searchsorted(word, ranks), "inside": np.append(begins, len(cells)),
            "span": span[begins], "top": np.maximum.reduceat(_gain_of(tf, length, average), begins), "unit": unit, "tf": tf, "length": length,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray | pa.Array]]:
        waiting: list[pa.RecordBatch] = []
        held, last = 0, -1
        for batch in batches:
            uid = batch["uid"].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(uid >> SPAN_BITS) != 0) | (np.diff(uid) < 0)) + 1).tolist(), len(uid)]
            sizes = pc.binary_length(batch["line"]).to_numpy()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if waiting and (held >= most or uid[a] < last or uid[b - 1] - waiting[0]["uid"][0].as_py() >= WIDEST):
                    yield fold(pa.Table.from_batches(waiting))
                    waiting, held = [], 0
                waiting.append(batch.slice(a, b - a))
                held += int(sizes[a:b].sum())
                last = uid[b - 1]
        if waiting:
            yield fold(pa.Table.from_batches(waiting))

    return run


def _blocks(average: float, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """word, span, n, top, low, high (marks of the span's units), places, tfs, lengths of each block: what ``_rows`` packs, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _runs(average, most)(batches):
            words = x["words"].take(pa.array(np.repeat(np.arange(len(x["words"])), np.diff(x["blocks"]))))
            place = (x["unit"] + x["base"]) & SPAN - 1
            bit = np.left_shift(np.int64(1), place & 63)
            marks = [np.bitwise_or.reduceat(np.where(place >> 6 == half, bit, 0), x["inside"][:-1]) for half in (0, 1)]
            lists = [_lists(x["inside"], v, kind) for v, kind in ((place, np.int8), (x["tf"], np.int32), (x["length"], np.int32))]
            columns = [words, *map(pa.array, (x["span"], np.diff(x["inside"]), x["top"], *marks)), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["word", "span", "n", "top", "low", "high", "places", "tfs", "lengths"])

    return run


def _rows(average: float, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Posting rows without their term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _runs(average, most)(batches):
            of_blocks = ((x["span"] - (x["base"] >> SPAN_BITS), np.int32), (x["top"], np.float64))
            of_units = ((x["unit"], np.int32), (x["tf"], np.int32), (x["length"], np.int32))
            lists = [_lists(bounds, v, kind) for bounds, some in ((x["blocks"], of_blocks), (x["units"], of_units)) for v, kind in some]
            whole = pa.RecordBatch.from_arrays([x["words"], pa.array(np.full(len(x["words"]), x["base"])), *lists], [f.split()[0] for f in ROW.split(", ")])
            for i in range(0, len(whole), SENT):
                yield whole.slice(i, SENT)

    return run


def _segment(spark: SparkSession, folder: str, seg: int, units: DataFrame, tokens: DataFrame, ledger: DataFrame) -> dict:
    """Writes units (uid, owner, id, n_words), postings of tokens (uid, n_words, line, tf) that come span after span, and the ledger (owner, digest); the segment's entry."""
    path = snapshots.fresh(folder, "segment")
    units.write.parquet(f"{path}/units")
    n, words = spark.read.parquet(f"{path}/units").agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    average = words / n if n and words else 1.0
    rows = tokens.select("uid", "n_words", "line", "tf").mapInArrow(_rows(average, MOST_HELD), ROW)
    rows.select(T.folded(F.col("word")).alias("term"), "*").write.parquet(f"{path}/postings")
    ledger.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{path}/ledger")
    return {"seg": seg, "path": path.rsplit("/", 1)[1], "n": n, "words": words, "average": average, "dead": 0}


def kept(docs: DataFrame, *, owner: str = "doc_id", text: str = "text", name: str = "lexical", cut: Callable[[DataFrame], DataFrame] | None = None, at: str | None = None) -> Index:
    """The index ``name`` of ``docs`` as they are now.

    ``cut`` makes units of documents: from (owner, text) to (owner, id, text); without it a document is a unit. ``at`` is the index's folder; without it, one below the
    shared folder that belongs to ``name`` and the folder of the table's files.
    """
    spark = docs.sparkSession
    if at is None:
        at = f"{scratch.base(spark)}/index-{name}-{snapshots.home(docs)}"
    now = snapshots.state(docs)
    last, blank = snapshots.latest(spark, at), {"version": 1, "format": FORMAT, "segments": [], "n": 0, "words": 0, "lost": 0}
    if last and last.get("format") != FORMAT:
        blank["version"], last = last["version"] + 1, None
    if last and now and last["state"] == now:
        return Index(spark, at, last)
    source = docs.select(F.col(owner).alias("owner"), F.col(text).alias("text"))
    hashes = _hashes(source, "text")
    if last is None:
        manifest, fresh, chosen, closed = blank, hashes, source, None
    else:
        old = Index(spark, at, last)
        known = old.ledger().select(F.col("owner").alias("had"), F.col("digest").alias("was"), "row", "seg")
        both = hashes.join(known, F.col("owner").eqNullSafe(F.col("had")), "full_outer")
        changes = written(both.filter(~F.col("digest").eqNullSafe(F.col("was"))), "changes")
        fresh = changes.filter("digest is not null").select("owner", "digest")
        closed = changes.filter("was is not null").select("had", "seg", "row")
        manifest = last | {"version": last["version"] + 1}
        if changes.isEmpty():
            return Index(spark, at, snapshots.commit(spark, at, manifest | {"state": now}) if now else last)
        named = fresh.select(F.col("owner").alias("wanted"))
        chosen = source.join(named, F.col("owner").eqNullSafe(F.col("wanted")), "left_semi")
    seg = 1 + max((s["seg"] for s in manifest["segments"]), default=0)
    pieces = cut(chosen) if cut else chosen.withColumn("id", F.col("owner"))
    tokenized = pieces.select("owner", "id", F.explode(F.array(F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")))).alias("words"))
    lines = tokenized.select("owner", "id", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("line"))
    staged = written(lines.sortWithinPartitions("n_words").withColumn("uid", F.monotonically_increasing_id()), "staged")
    tokens = staged.filter("n_words > 0").withColumn("tf", F.lit(1).cast("long"))  # rows as written: a span's stand together
    entry = _segment(spark, at, seg, staged.select("uid", "owner", "id", "n_words"), tokens, fresh)
    lost_n = lost_words = 0
    if closed is not None:
        at_owner = old.units().join(closed.select("had", F.col("seg").alias("of")).distinct(), F.col("owner").eqNullSafe(F.col("had")) & (F.col("seg") == F.col("of")))
        at_owner.select("seg", "uid", "n_words").write.parquet(f"{at}/{entry['path']}/dead")
        closed.select("seg", "row").write.parquet(f"{at}/{entry['path']}/closed")
        lost_n, lost_words = spark.read.parquet(f"{at}/{entry['path']}/dead").agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
        entry["dead"] = 1
        dropped(changes)
    dropped(staged)
    segments = [*manifest["segments"], entry]
    manifest = manifest | {"state": now, "segments": segments, "n": manifest["n"] + entry["n"] - lost_n, "words": manifest["words"] + entry["words"] - lost_words, "lost": manifest["lost"] + lost_n}
    index = Index(spark, at, snapshots.commit(spark, at, manifest))
    return compacted(index) if len(segments) > MOST_SEGMENTS or manifest["lost"] * DEAD_SHARE > manifest["n"] else index


def compacted(index: Index) -> Index:
    """The index as one segment without dead units, made of its postings: no text is read."""
    spark = index.spark
    renumbered = written(index.units().sortWithinPartitions("n_words").withColumn("new", F.monotonically_increasing_id()), "renumbered")
    tokens = index.postings().join(renumbered.select("seg", "uid", "new"), ["seg", "uid"]).select(F.col("new").alias("uid"), F.col("word").alias("line"), "tf", "n_words")
    together = tokens.repartition(F.shiftright("uid", GROUP_BITS)).sortWithinPartitions("uid")
    units = renumbered.select(F.col("new").alias("uid"), "owner", "id", "n_words")
    entry = _segment(spark, index.folder, 1, units, together, index.ledger().select("owner", "digest"))
    manifest = index.manifest | {"version": index.manifest["version"] + 1, "segments": [entry], "n": entry["n"], "words": entry["words"], "lost": 0}
    dropped(renumbered)
    return Index(spark, index.folder, snapshots.commit(spark, index.folder, manifest))


# --- searching ---------------------------------------------------------------------------------------------------


def frequencies(index: Index, terms: list[str]) -> dict[str, int]:
    """In how many live units each term stands. A term's words overlap, so units are marked in a bit map for each span; where some are dead, they are told apart themselves."""
    own = index.postings().filter(F.col("term").isin(terms))
    if index.manifest["lost"]:  # a row a term in either case
        return dict(index.live(own.select("seg", "term", "uid").distinct()).groupBy("term").agg(F.count("*")).collect())
    place = (F.col("uid") % SPAN).cast("int")
    bits = [F.bit_or(F.when(F.shiftright(place, 6) == half, F.expr(f"shiftleft(1L, cast(uid % {SPAN // 2} AS int))")).otherwise(0)).alias(name) for half, name in ((0, "low"), (1, "high"))]
    marks = own.groupBy("seg", "term", F.shiftright("uid", SPAN_BITS)).agg(*bits)
    return dict(marks.groupBy("term").agg(F.sum(F.bit_count("low") + F.bit_count("high"))).collect())


def _scored(index: Index, each: DataFrame, terms: list[str], weights: dict[str, float], hits: list[str] | None = None) -> DataFrame:
    """seg, uid, score of the live units among the postings ``each`` (seg, term, uid, tf, n_words, and ``hits``: 1 where the word holds a term); terms are added in the query's order."""
    names = list(dict.fromkeys(terms))
    tf = [F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(names)]
    inside = [F.max(h).alias(h) for h in hits or []]
    rows = index.live(each.groupBy("seg", "uid").agg(F.first("n_words").alias("n_words"), *tf, *inside))
    score = F.lit(0.0)
    for t in terms:
        score = score + weights.get(t, 0.0) * _gain(F.col(f"tf{names.index(t)}"), F.col("n_words"), index.average)
    if hits:
        score = sum((F.col(hits[names.index(t)]) for t in terms), F.lit(0)) + score
    return rows.select("seg", "uid", score.alias("score"))


@dataclass(frozen=True)
class Found:
    rows: DataFrame  # id, score
    blocks: int  # of the query's terms
    read: int  # of them whose units were scored


def topk(index: Index, query: str, k: int) -> Found:
    """The ``k`` units with the highest BM25 score above 0, ties by id, and how many blocks that took."""
    terms = query_terms(query)
    spark = index.spark
    if not terms or not index.manifest["segments"] or not index.n:
        return Found(spark.createDataFrame([], "id long, score double"), 0, 0)
    df = frequencies(index, list(dict.fromkeys(terms)))
    weights = {t: rarity(index.n, n) for t, n in df.items()}
    of_query = F.col("term").isin(list(dict.fromkeys(terms)))
    own = index.blocks().filter(of_query)
    weight, growth = F.lit(0.0), F.lit(1.0)
    for t, w in weights.items():
        weight = F.when(F.col("term") == t, terms.count(t) * w).otherwise(weight)
    for s in index.manifest["segments"]:  # gains were measured at the segment's own mean length
        growth = F.when(F.col("seg") == s["seg"], max(1.0, index.average / s["average"])).otherwise(growth)
    spans = written(own.groupBy("seg", "span").agg((F.sum(weight * F.col("top") * growth) * (1 + 1e-9)).alias("most"), F.count("*").alias("blocks")), "spans")

    def scored(chosen: DataFrame) -> DataFrame:
        each = index.postings().filter(of_query).withColumn("span", F.shiftright("uid", SPAN_BITS))
        return _scored(index, each.join(chosen.select("seg", "span"), ["seg", "span"], "left_semi"), terms, weights).filter("score > 0")

    def least(scores: DataFrame) -> float:
        worst, n = scores.orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count("*")).first()
        return worst if n == k else -math.inf

    floor = least(scored(spans.orderBy(F.desc("most"), "seg", "span").limit(max(FIRST_SPANS, 2 * k >> SPAN_BITS))))
    every, read = spans.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("most") >= floor, F.col("blocks"))), F.lit(0))).first()
    scores = written(scored(spans.filter(F.col("most") >= floor)), "scores")
    best = scores.filter(F.col("score") >= least(scores)).join(index.units().select("seg", "uid", "id"), ["seg", "uid"])
    dropped(spans)
    return Found(best.select("id", "score").orderBy(F.desc("score"), "id").limit(k), every, read)


def matches(index: Index, query: str) -> DataFrame:
    """owner, id, score of every unit that holds a term of the query as a substring: the number of terms found so, plus BM25.

    A term is a run of word characters, so it stands inside one word: only the words that contain a term are read.
    """
    terms = query_terms(query)
    if not terms or not index.manifest["segments"]:
        return index.spark.createDataFrame([], "owner long, id long, score double")
    names = list(dict.fromkeys(terms))
    hits = [f"in{i}" for i in range(len(names))]
    weights = {t: rarity(index.n, n) for t, n in frequencies(index, names).items()}
    marked = index._read("postings").withColumns({h: F.contains("word", F.lit(t)).cast("long") for h, t in zip(hits, names, strict=True)})
    own = marked.filter(F.col("term").isin(names) | (F.greatest(*hits, F.lit(0)) > 0))  # told by a word once for all its units
    return _scored(index, _each(own, ["term", *hits]), terms, weights, hits).filter("score > 0").join(index.units(), ["seg", "uid"]).select("owner", "id", "score")
