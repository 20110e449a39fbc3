"""Similarity join of documents on word n-grams by PartEnum signatures, and the components of its links.

A document's set holds the distinct hashes of its word n-grams. Two sets with Jaccard similarity of at least
``percent``/100 = t differ in at most ``floor(min size * (1 - t) / t)`` elements (union less intersection). So:

* sizes fall into geometric bands; a set signs for its band, and for the one below if a smaller partner may lie there;
* a band with at most k differences splits the feature domain by a hash into n1 = k // 2 + 1 parts. In some part
  at most one element differs. Each part splits again into three; one of the three pairs of thirds is then free
  of differences. The hash of (band, part, pair, its elements) is a signature: 3 * n1 for each set, and similar sets
  share at least one;
* two thirds may be empty in many documents, which would share that signature by chance. So there are j spare parts, and empty
  signatures are left out, up to 2j of them: of n1 + j parts with at most k differences, similar sets
  agree in at least 2 (n1 + j) - k > 2j signatures (the first difference of a part costs two, the next one), so if either
  of them has no more than 2j empty ones, an agreeing one has elements. A set with more of them also gives the signatures of
  an independent split, by the same rule; the last of ``LEVELS`` splits gives all. So two such sets agree there, and no
  similar pair is left to chance but for collisions of the 64-bit hashes;
* pairs that share a signature are verified on their whole sets.

Copies: documents with equal sets form a class (a digest of the sorted set); only representatives are compared. In a
bucket of one signature, members meet its smallest member first. Members that this leaves in different components
then meet all others of their bucket in other components; exact bounds by size and by a
parity sketch go before the sets are compared. Pairs inside one component are never listed, so a bucket of thousands of near copies
costs a row each. In a bucket of thousands of unlike members (``WIDE``), as one frequent passage may make it, members must share a signature
of a second, independent split as well, as similar sets do; so dissimilar ones are never paired. No cap is set anywhere.
Signers are put together by signature within each slice of texts first, so that no signature brings more rows to one task than
there are slices; buckets with many members are joined in a way that adaptive execution splits.

Defined cases: a null text or one without words has an empty set, links with nothing and is its own component; a text
of fewer than n words has one shingle, its whole sequence; equal rows share a component, whose id is the smallest key;
rows with a null key, or several under one key, are documents of their own, and a component without a key has a null id; other
columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .components import components
from .shared import BROADCAST_IDS, dropped, joined_by_id, written

LANES = 8  # 64-bit words of a parity sketch
BAND = 1.25  # ratio of a band's bounds
SLICE = 4 << 20  # bytes of text whose signers are put together
REMEMBERED = 200_000  # set digests a task knows it has signed already
WIDE = 4_096  # members of other components in a bucket, in the mean of its members, from which on they meet by a second signature too
LEVELS = 4  # independent splits of a set with many empty signatures
SEEDS = np.arange(1, 9, dtype=np.uint64) * np.uint64(0x51ED270B3A4F9C17)


def sets_of(part: pa.RecordBatch, n: int, text: str) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; A-Z count as a-z."""
    raw, at = words.text_bytes(part.column(part.schema.get_field_index(text)))
    raw = words.LOWER[raw]
    starts, ends, first = words.word_spans(raw, at)
    hashes = words.word_hashes(raw, starts, ends)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(words.shingles(hashes[a:b], n))


def bands(percent: int, largest: int) -> list[int]:
    """Lower bounds of the size bands; the first band is that of sets too small to differ at all."""
    out = [math.ceil(percent / (100 - percent)) if percent < 100 else largest + 1]
    ratio = max(BAND, 100 / percent)  # so that a partner lies in the next band at most
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return out


def most_different(smaller: int, percent: int) -> int:
    """Elements in which two linked sets differ at most, if the smaller one has so many."""
    return smaller * (100 - percent) // percent


def plan_of(size: int, percent: int) -> tuple[int, int]:
    """For a band up to ``size``: parts, and spare ones among them: about as many as make up for the usual number of empty signatures."""
    parts = most_different(size, percent) // 2 + 1
    spare = parts // 50 + math.isqrt(parts) // 6 + (parts >= 8)
    return parts + spare, spare


def _cells(elements: np.ndarray, tag: int, parts: int, prefix: np.uint64, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each third that may be left out: the signatures of all parts under one split, and which of them are empty."""
    mixed = words.mix(elements ^ SEEDS[seed])
    cell = ((mixed >> np.uint64(32)) * np.uint64(3 * parts) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(3 * parts, np.uint64)
    np.add.at(sums, cell, words.mix(elements))
    thirds, filled = sums.reshape(parts, 3), np.bincount(cell, minlength=3 * parts).reshape(parts, 3)
    number = np.arange(parts, dtype=np.uint64) * np.uint64(4) + (np.uint64(tag) << np.uint64(40))
    for left_out in range(3):
        b, c = (left_out + 1) % 3, (left_out + 2) % 3
        yield words.mix(words.mix(thirds[:, b] + (number + np.uint64(left_out)) * words.MULT[0]) ^ thirds[:, c] ^ prefix), filled[:, b] + filled[:, c] == 0


def _under(elements: np.ndarray, tag: int, parts: int, spare: int, split: int) -> list[np.ndarray]:
    """Signatures that are not empty; while more than 2 * ``spare`` are, also those of the next independent split (see the module's notes)."""
    out = []
    for level in range(LEVELS):
        found, empty = (np.concatenate(x) for x in zip(*_cells(elements, tag, parts, np.uint64(level), split + level), strict=True))
        if level == LEVELS - 1 or not empty.any():
            return [*out, found]
        out.append(found[~empty])
        if np.count_nonzero(empty) <= 2 * spare:
            break
    return out


def signatures(elements: np.ndarray, percent: int, low: list[int], split: int = 0) -> np.ndarray:
    """All signatures of one set under one of two independent splits (0 or 4); sets too small to differ have none (equal sets are found by their digest)."""
    size = len(elements)
    band = int(np.searchsorted(low, size, side="right")) - 1
    if band < 0:
        return np.zeros(0, np.uint64)
    # A pair is signed under the band of its smaller set: each set signs for its own band, and for the one below if a partner may lie there.
    tags = [(band, low[band + 1] - 1)] + ([(band - 1, low[band] - 1)] if band and size * percent <= 100 * (low[band] - 1) else [])
    out: list[np.ndarray] = []
    for tag, top in tags:
        out += _under(elements, tag, *plan_of(top, percent), split)
    return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|; both are sorted and distinct."""
    if not len(a) or not len(b):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _digests(docs: DataFrame, n: int) -> DataFrame:
    """id, n_shingles, digest (null for an empty set)."""
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                size, digest = [], []
                for s in sets_of(part, n, "text"):
                    size.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "id long, n_shingles long, digest binary")


def gathered(sigs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signers of one slice put together by signature: signature, smallest signer and group of each signature; group and member of each group.

    A group is named by its members (a hash), so signatures with the same signers share it; of one signer it is 0 and not listed.
    """
    order = np.lexsort((ids, sigs))
    s, d = sigs[order], ids[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])))
    s, d = s[new], d[new]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    size = np.diff(np.append(first, len(s)))
    name = words.mix(np.bitwise_xor.reduceat(words.mix(d.view(np.uint64) ^ words.MULT[2]), first)).view(np.int64)
    name[size == 1] = 0
    of = np.repeat(name, size)
    listed = np.flatnonzero(of)
    listed = listed[np.lexsort((d[listed], of[listed]))]
    once = np.concatenate(([True], (of[listed][1:] != of[listed][:-1]) | (d[listed][1:] != d[listed][:-1]))) if len(listed) else np.zeros(0, bool)
    return s[first].view(np.int64), d[first], name, of[listed][once], d[listed][once]


def _signed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """sig, id, inner, member: each signature once a slice of texts, with its smallest signer and the group of its signers there (null: it alone), and the members of such groups (sig: the group)."""
    schema = pa.schema([("sig", pa.int64()), ("id", pa.int64()), ("inner", pa.int64()), ("member", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        low = bands(percent, 1 << 40)
        for batch in batches:
            for part in words.slices(batch, SLICE):
                sigs, ids = [], []
                for i, s in zip(part.column(0).to_pylist(), sets_of(part, n, "text"), strict=True):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if digest in known:
                        continue
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known.add(digest)
                    found = signatures(s, percent, low)
                    if len(found):
                        sigs.append(found)
                        ids.append(np.full(len(found), i, np.int64))
                if sigs:
                    sig, hub, group, of, inside = gathered(np.concatenate(sigs), np.concatenate(ids))
                    columns = (np.concatenate((sig, of)), np.concatenate((hub, inside)), np.concatenate((group, np.zeros_like(of))), np.concatenate((np.zeros(len(sig), bool), np.ones(len(of), bool))))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], mask=columns[2] == 0), pa.array(columns[3])], schema=schema)

    return docs.mapInArrow(run, "sig long, id long, inner long, member boolean")


def parities(elements: np.ndarray) -> np.ndarray:
    """A sketch of 64 * LANES bits, each the parity of the elements that hash to it: two sketches differ in no more bits than the sets in elements."""
    counts = np.bincount((words.mix(elements ^ words.MULT[1]) >> np.uint64(64 - (64 * LANES).bit_length() + 1)).astype(np.int64), minlength=64 * LANES)
    return np.packbits((counts & 1).astype(bool)).view(np.int64)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """id, size, elements (packed 64-bit hashes), p0.. (parity sketch)."""
    lanes = [f"p{k}" for k in range(LANES)]
    schema = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("elements", pa.binary()), *((x, pa.int64()) for x in lanes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                found = list(sets_of(part, n, "text"))
                sketch = np.array([parities(s) for s in found]).reshape(-1, LANES).T
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()), *(pa.array(np.ascontiguousarray(x)) for x in sketch)], schema=schema)

    return docs.mapInArrow(run, "id long, size long, elements binary, " + ", ".join(f"{x} long" for x in lanes))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _second(sets: DataFrame, percent: int) -> DataFrame:
    """id, second: the signatures of every set under the second split."""
    schema = pa.schema([("id", pa.int64()), ("second", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = bands(percent, 1 << 40)
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = signatures(np.frombuffer(packed, np.uint64), percent, low, 4).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i, np.int64)), pa.array(found)], schema=schema)

    return sets.select("id", "elements").mapInArrow(run, "id long, second long")


def _crossing(buckets: DataFrame, sets: DataFrame, found: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket in different components, not in ``tested``, whose sketches allow a link. The bounds stand in the join's condition, so pairs that they refute are never rows."""
    placed = buckets.select("sig", "id").join(found, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("component"))

    def split(members: DataFrame) -> DataFrame:
        """sig, partners: how many members of other components a member has in the mean."""
        sizes = members.groupBy("sig", "component").agg(F.count("*").cast("double").alias("n"))
        return sizes.groupBy("sig").agg((F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("partners")).filter("partners > 0")

    placed = written(placed.join(split(placed), "sig"), "placed")
    wide, narrow = placed.filter(F.col("partners") > WIDE), placed.filter(F.col("partners") <= WIDE)
    if not wide.isEmpty():
        of_wide = _second(sets.join(wide.select("id").distinct(), "id", "left_semi"), percent)
        both = written(wide.join(of_wide, "id").select(F.xxhash64("sig", "second").alias("sig"), "id", "component"), "both")
        narrow = narrow.unionByName(both.join(split(both), "sig").select("sig", "id", "component", "partners"))
    members = narrow.drop("partners").join(sets.drop("elements"), "id")
    one, two = (members.select("sig", *(F.col(c).alias(f"{c}_{side}") for c in members.columns if c != "sig")) for side in "ab")
    apart = " + ".join(f"bit_count(p{k}_a ^ p{k}_b)" for k in range(LANES))
    near = f"id_a < id_b and component_a <> component_b and {100 + percent} * ({apart}) <= {100 - percent} * (size_a + size_b) and 100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"
    one, two = one.alias("one"), two.alias("two")
    pairs = one.join(two, F.expr(f"one.sig = two.sig and {near}"))
    out = written(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "rest")
    dropped(placed)
    return out


def join(docs: DataFrame, *, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, class_id (smallest key with the same set), component_id (smallest key reachable by links)."""
    docs = docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    if docs.groupBy("id").count().filter("count > 1 or id is null").isEmpty():
        return _joined(docs, n, percent).withColumnRenamed("id", key)
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    linked = _joined(rows.select(F.col("row").alias("id"), "text"), n, percent).withColumnRenamed("id", "row").join(rows.select("row", "id"), "row")
    for c in ("class_id", "component_id"):
        linked = linked.join(linked.groupBy(F.col(c).alias(f"of_{c}")).agg(F.min("id").alias(f"key_{c}")), F.col(c) == F.col(f"of_{c}"))
    return linked.select(F.col("id").alias(key), "n_shingles", F.col("key_class_id").alias("class_id"), F.col("key_component_id").alias("component_id"))


def _joined(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """id, n_shingles, class_id, component_id of (id, text) with ids that differ."""
    shape = written(_digests(docs, n), "shape")
    # Written tables can be sent out whole if they are small, and else be split where a key has many rows.
    classes = written(shape.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("class"), F.count("*").alias("n")).filter("n > 1").drop("n"), "digests")
    of = written(joined_by_id(shape, classes, "digest", "left").select("id", "n_shingles", F.coalesce("class", "id").alias("class")), "classes")
    dropped(shape)
    dropped(classes)
    # Only representatives sign. Beyond the bound copies may sign too, which changes nothing as signers stand for their class.
    copies = of.filter("id <> class").select("id")
    signing = docs.join(F.broadcast(copies), "id", "left_anti") if copies.count() <= BROADCAST_IDS else docs
    # A signature comes once from a slice of texts, so a window holds no more rows than there are slices, however many texts
    # sign it; members of a slice's groups pass by. Signatures with the same signers make the same pairs, so a bucket is named
    # by its signers and kept once.
    whole = Window.partitionBy("sig", F.when(F.col("member"), F.pmod("id", F.lit(1_024)) + 1).otherwise(0))
    marked = {"low": F.min("id").over(whole), "high": F.max("id").over(whole), "bucket": F.bit_xor(F.xxhash64("id", "inner")).over(whole)}
    kept = _signed(signing, n, percent).withColumns(marked).filter("member or low < high")
    raw = written(kept.select(F.when(F.col("member"), F.col("sig")).otherwise(F.col("bucket")).alias("sig"), "id", "inner", "member").distinct(), "raw")
    groups, across = raw.filter("member").select("sig", "id"), raw.filter("not member")
    inside = across.filter("inner is not null").select("sig", "inner").distinct().join(groups.withColumnRenamed("sig", "inner"), "inner").select("sig", "id")
    signers = groups.unionByName(across.select("sig", "id")).unionByName(inside)
    # Buckets with at least two classes.
    named = written(signers.join(of, "id").select("sig", F.col("class").alias("id")).distinct(), "named")
    dropped(raw)
    hubs = written(named.groupBy("sig").agg(F.min("id").alias("hub"), F.max("id").alias("high")).filter("hub < high").select("sig", "hub"), "hubs")
    buckets = written(joined_by_id(named, hubs, "sig", "inner"), "buckets")
    dropped(named)
    dropped(hubs)
    # Only members of such buckets can have links: their texts are read again for their sets.
    sets = written(_sets(joined_by_id(docs, buckets.select("id").distinct(), "id", "left_semi"), n), "sets")
    # Each member meets its smallest hub first, which joins most groups; then what is still apart meets.
    first = written(buckets.filter("id > hub").groupBy(F.col("id").alias("b")).agg(F.min("hub").alias("a")).select("a", "b"), "first")
    edges = written(_verified(first, sets, percent), "edges")
    found = written(components(edges), "found")
    rest = _crossing(buckets, sets, found, first, percent)
    more = written(_verified(rest, sets, percent), "more")
    if not more.isEmpty():
        before, found = found, written(components(edges.unionByName(more)), "found")
        dropped(before)
    for table in (buckets, sets, first, rest, edges, more):
        dropped(table)
    top = found.withColumnRenamed("id", "class")
    return of.join(top, "class", "left").select("id", "n_shingles", F.col("class").alias("class_id"), F.coalesce("component", "class").alias("component_id"))
