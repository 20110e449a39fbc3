"""Hard negatives by inner product: anchors of a cluster share lists of candidates sorted once by an angular upper bound.

Anchors are clustered by direction around centres fitted on a bounded sample. No candidate x scores more with a member a
than |a| |x| cos(max(0, angle(x, centre) - radius)), where the radius is the widest angle of a member: |a| times a bound that belongs to x and the cluster.
So a cluster sorts the candidates by that bound once, and each member walks the list until its k-th find reaches what the bound
still allows. Then no row further down can change its result: the result is exact, whatever the clusters are like. Where vectors have
no structure the bounds exclude little and the walk is a blocked comparison with all rows.

The sorted list is distributed: an exact histogram of bounds cuts it into bands, a band fuller than ``BAND`` rows (many equal
vectors, say) is dealt to parts by hash. Bands are visited in rounds, the first one first; members whose finds certify
them before a band's upper edge do not visit it, and rows of bands that no member visits are not sent. A (cluster, band, part) is one
group of at most ``MEMBERS`` anchors and about ``BAND`` rows, sorted once; all members walk it in strides.

Two walks follow one another: positives are the best rows of the anchor's label; negatives are, for each positive, the best rows
of other labels whose score lies in a window below the positive's. A member's second walk ends at the worst score that any of its windows can still take.

Scores are inner products of integers floor(scale x), exact in doubles below 2^53 and else in 64-bit integers.

Defined cases: rows with a null key, label or vector, with null or non-finite components, with another vector length than the most common one (of
equally common ones, the longer) or with an integer norm of 2^31 or more (scores past 64 bits) take no part; zero vectors do; an anchor's own key is no candidate;
equal rows count once; ties go to the smaller key; fewer rows than asked for give fewer; no rows or no anchors give none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .shared import dropped, written

CLUSTERS = 8  # at least, if there are as many anchors
MEMBERS = 16_384  # anchors of a cluster; more are halved further by hash
SAMPLE = 8_192  # anchors that centres are fitted on
STEPS = 8
BINS = 512  # of the histogram of bounds of a cluster
BAND = 32_768  # rows of one group
STRIDE = 2_048
CHUNK = 256  # members that walk together
ROUNDS = ((0, 1), (1, 4), (4, BINS))
EXACT = 2.0**53
LOWEST = -(1 << 62)  # below any score
SEED = 11
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _rows(vectors: DataFrame, key: str, label: Column, vector: str, scale: int) -> DataFrame:
    """id, label, v (64-bit components), norm of the rows that take part."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("v", pa.binary()), ("norm", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, bytes, float]] = []
            for i, of, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i is None or of is None or not row or None in row:
                    continue
                v = np.floor(np.array(row, np.float64) * scale)
                if np.isfinite(v).all() and float(v @ v) < 2.0**62:
                    out.append((i, of, v.astype("<i8").tobytes(), math.sqrt(float(v @ v))))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(schema)], schema=schema)

    return vectors.select(F.col(key).cast("long"), label.cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, "id long, label long, v binary, norm double").distinct()


def _best() -> WindowSpec:
    return Window.partitionBy("number", "window").orderBy(F.desc("score"), "key")


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), -1)


def _norms(m: np.ndarray) -> np.ndarray:
    d = m.astype(np.float64)
    return np.sqrt((d * d).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two integer matrices, exactly."""
    if len(a) and len(b) and _norms(a).max() * _norms(b).max() < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def unit(m: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Directions; a zero vector has the first axis."""
    out = m / np.where(norms > 0, norms, 1.0)[:, None]
    out[norms == 0, 0] = 1.0
    return out


def fitted(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres of directions by spherical k-means from spread-out starts."""
    rng = np.random.default_rng(SEED)
    centres = sample[:1]
    near = sample @ centres[0]
    while len(centres) < n:
        chance = np.maximum(0.0, 1 - near)
        if not chance.sum() > 0:
            break
        centres = np.vstack((centres, sample[rng.choice(len(sample), p=chance / chance.sum())]))
        near = np.maximum(near, sample @ centres[-1])
    for _ in range(STEPS):
        of = (sample @ centres.T).argmax(axis=1)
        sums = np.array([sample[of == c].sum(axis=0) if (of == c).any() else centres[c] for c in range(len(centres))])
        size = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where((size > 0)[:, None], sums / np.where(size > 0, size, 1)[:, None], centres)
    return centres


def bounds(m: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each row and cluster the most that a member of norm 1 can score with the row, rounded up."""
    norms = _norms(m)
    angle = np.arccos(np.clip(unit(m.astype(np.float64), norms) @ centres.T, -1, 1))
    return norms[:, None] * np.cos(np.maximum(0.0, angle - radius[None] - 1e-7)) + norms[:, None] * 1e-9 + 1e-6


class Finds:
    """The k best (score, smaller key first) finds of one member in the window low..high of scores, of which those below ``known`` are not needed."""

    def __init__(self, k: int, low: int, high: int, known: int) -> None:
        self.k, self.high, self.least = k, high, max(low, known)  # a row below ``least`` changes nothing
        self.scores, self.keys = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, keys: np.ndarray) -> None:
        fit = (scores >= self.least) & (scores <= self.high)
        if fit.any():
            s, i = np.concatenate((self.scores, scores[fit])), np.concatenate((self.keys, keys[fit]))
            order = np.lexsort((i, -s))[: self.k]
            self.scores, self.keys = s[order], i[order]
            if len(order) == self.k:
                self.least = max(self.least, int(self.scores[-1]))


def reaches(norm: float, limit: float, least: int) -> bool:
    """Whether a row with this bound can score ``least`` with a member of this norm; never wrongly no."""
    most = norm * limit
    return most + abs(most) * 1e-9 + 1 >= least


def walk(keys: np.ndarray, labels: np.ndarray, m: np.ndarray, limit: np.ndarray, members: list[tuple[int, int, np.ndarray, list[Finds]]], same: bool) -> int:
    """Members (key, label, vector, windows) walk the rows, which are sorted by falling ``limit``, until certified; returns how many scores were computed."""
    done = 0
    for start in range(0, len(members), CHUNK):
        chunk = members[start : start + CHUNK]
        active = list(zip(chunk, _norms(np.array([a[2] for a in chunk])).tolist(), strict=True))
        for at in range(0, len(keys), STRIDE):
            active = [(a, norm) for a, norm in active if reaches(norm, float(limit[at]), min(w.least for w in a[3]))]
            if not active:
                break
            part = slice(at, at + STRIDE)
            scores = products(np.array([a[2] for a, _ in active]), m[part])
            done += scores.size
            for ((key, label, _, windows), _), row in zip(active, scores, strict=True):
                fit = ((labels[part] == label) == same) & (keys[part] != key) & (row >= min(w.least for w in windows))
                if fit.any():
                    for w in windows:
                        w.offer(row[fit], keys[part][fit])
    return done


@dataclass(frozen=True)
class Lists:
    """The sorted lists of all clusters: centres and radii, and for each cluster the band of every bin of bounds (0 is the highest) and the parts of every band."""

    centres: np.ndarray
    radius: np.ndarray
    low: float
    width: float
    bands: list[np.ndarray]
    parts: list[np.ndarray]

    def bins(self, limit: np.ndarray) -> np.ndarray:
        return np.clip(((limit - self.low) / self.width).astype(np.int64), 0, BINS - 1)

    def edges(self) -> list[tuple[int, int, int, float]]:
        """(cluster, band, parts, upper edge) of all bands."""
        return [(c, b, int(n), self.low + (int(np.flatnonzero(self.bands[c] == b)[-1]) + 1.001) * self.width) for c, parts in enumerate(self.parts) for b, n in enumerate(parts)]


def cut(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands from the highest bin down, the first of an eighth of ``BAND`` rows at least, the others of ``BAND``; and the parts of each."""
    band, sizes = np.zeros(len(counts), np.int64), [0]
    for i in range(len(counts) - 1, -1, -1):
        if sizes[-1] >= (BAND if len(sizes) > 1 else BAND // 8):
            sizes.append(0)
        band[i] = len(sizes) - 1
        sizes[-1] += int(counts[i])
    return band, np.array([max(1, math.ceil(n / BAND)) for n in sizes])


def _lists(rows: DataFrame, centres: np.ndarray, radius: np.ndarray) -> Lists:
    reach = (rows.agg(F.max("norm")).first()[0] or 0.0) * (1 + 1e-8) + 1e-3
    empty = Lists(centres, radius, -reach, 2 * reach / BINS, [], [])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), BINS), np.int64)
        for batch in batches:
            if batch.num_rows:
                at = empty.bins(bounds(_matrix(batch.column(0).to_pylist()), centres, radius))
                for c in range(len(centres)):
                    total[c] += np.bincount(at[:, c], minlength=BINS)
        c, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(b), pa.array(total[c, b])], names=["cluster", "bin", "n"])

    totals = np.zeros((len(centres), BINS), np.int64)
    for c, b, n in rows.select("v").mapInArrow(counted, "cluster long, bin long, n long").groupBy("cluster", "bin").agg(F.sum("n")).collect():
        totals[c, b] = n
    cuts = [cut(t) for t in totals]
    return replace(empty, bands=[x[0] for x in cuts], parts=[x[1] for x in cuts])


def _walked(rows: DataFrame, asked: DataFrame, lists: Lists, k: int, same: bool) -> DataFrame:
    """number, window, score, key of finds, and rows with ``walked`` alone. ``asked``: number, cluster, id, label, v, norm and windows (low, high)."""
    spark = asked.sparkSession
    schema = pa.schema([("number", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("key", pa.int64()), ("walked", pa.int64())])
    fields = "number long, window int, score long, key long, walked long"
    lists_df = spark.createDataFrame(lists.edges(), "to_cluster long, to_band long, parts long, edge double")  # clusters times bands
    deepest = max(len(p) for p in lists.parts)
    found = spark.createDataFrame([], fields)

    def sent(needs: dict[int, float], first: int, last: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The rows of a round's bands, for each cluster with a member that may need them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(0).to_numpy()
                limit = bounds(_matrix(batch.column(2).to_pylist()), lists.centres, lists.radius)
                for c, least in needs.items():
                    band = lists.bands[c][lists.bins(limit[:, c])]
                    at = np.flatnonzero((band >= first) & (band < last) & (limit[:, c] >= least))
                    if len(at):
                        part = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % lists.parts[c][band[at]]
                        took = [batch.column(j).take(pa.array(at)) for j in range(3)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c)), pa.array(band[at]), pa.array(part), *took, pa.array(limit[at, c])], names=["cluster", "band", "part", "key", "label", "v", "limit"])

        return run

    def group(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        done = 0
        if left.num_rows and right.num_rows:
            limit = right.column("limit").to_numpy()
            order = np.argsort(-limit, kind="stable")
            keys, labels = (right.column(c).to_numpy()[order] for c in ("key", "label"))
            asks = left.to_pylist()
            members = [(a["id"], a["own"], np.frombuffer(a["vector"], "<i8"), [Finds(k, w["low"], w["high"], w["known"]) for w in a["windows"]]) for a in asks]
            done = walk(keys, labels, _matrix(right.column("v").to_pylist())[order], limit[order], members, same)
            out = [(a["number"], j, int(s), int(i), 0) for a, member in zip(asks, members, strict=True) for j, w in enumerate(member[3]) for s, i in zip(w.scores, w.keys, strict=True)]
        out.append((None, None, None, None, done))
        return pa.table([pa.array([r[j] for r in out], f.type) for j, f in enumerate(schema)], schema=schema)

    for first, last in ROUNDS:
        if first >= deepest:
            break
        ranked = found.filter("key is not null").withColumn("r", F.row_number().over(_best())).filter(F.col("r") == k)
        kth = ranked.groupBy("number").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
        known = F.transform("windows", lambda w, j: F.struct(w["low"].alias("low"), w["high"].alias("high"), F.coalesce(F.try_element_at("kth", j), F.lit(LOWEST)).alias("known")))
        now = asked.join(kth, "number", "left").select("number", "cluster", "id", F.col("label").alias("own"), F.col("v").alias("vector"), "norm", known.alias("windows"))
        state = written(now.withColumn("need", F.array_min(F.transform("windows", lambda w: F.greatest(w["low"], w["known"])))), "members")
        # For each cluster the least bound that a member may still have to see: reaches() turned round, with room for rounding.
        least = F.min((F.col("need") - 1 - F.abs(F.col("need")) * 1e-8) / F.col("norm"))
        needs = dict(state.filter("norm > 0").groupBy("cluster").agg(least).collect()) | dict.fromkeys((r[0] for r in state.filter("norm = 0 and need <= 1").select("cluster").distinct().collect()), -math.inf)
        reach = F.col("norm") * F.col("edge")
        visits = state.join(lists_df.filter(F.col("to_band").between(first, last - 1)), F.col("cluster") == F.col("to_cluster")).filter(reach + F.abs(reach) * 1e-8 + 1 >= F.col("need"))
        going = visits.select("to_cluster", "to_band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("to_part"), "number", "id", "own", "vector", "windows")
        data = rows.select("id", "label", "v").mapInArrow(sent(needs, first, last), "cluster long, band long, part long, key long, label long, v binary, limit double")
        pairs = going.groupBy("to_cluster", "to_band", "to_part").cogroup(data.groupBy("cluster", "band", "part"))
        found = found.unionByName(written(pairs.applyInArrow(group, fields), "finds"))
        dropped(state)
    return found


def mined(vectors: DataFrame, *, anchor: Column, key: str = "vec_id", label: Column | str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95)) -> tuple[DataFrame, DataFrame]:
    """The rows of ``hard_negatives``, and a table whose column ``walked`` sums to the number of scores that were computed."""
    spark = vectors.sparkSession
    parsed = written(_rows(vectors, key, F.col(label) if isinstance(label, str) else label, vector, scale), "vectors")
    lengths = parsed.groupBy(F.length("v")).count().orderBy(F.desc("count"), F.desc("length(v)")).limit(1).collect()
    rows = parsed.filter(F.length("v") == (lengths[0][0] if lengths else 0))
    asked = written(rows.filter(anchor).withColumn("number", F.monotonically_increasing_id()), "anchors")
    n = asked.count()
    if not n:
        return spark.createDataFrame([], RESULT), spark.createDataFrame([], "walked long")
    sample = _matrix([r["v"] for r in asked.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).collect()])
    centres = fitted(unit(sample.astype(np.float64), _norms(sample)), min(n, max(CLUSTERS, math.ceil(n / MEMBERS))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(1).to_pylist())
                close = unit(m.astype(np.float64), _norms(m)) @ centres.T
                of = close.argmax(axis=1)
                angle = np.arccos(np.clip(close[np.arange(len(of)), of], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of), pa.array(angle)], names=["number", "centre", "angle"])

    placed = written(asked.select("number", "v").mapInArrow(place, "number long, centre long, angle double"), "placed")
    splits = {c: math.ceil(m / MEMBERS) for c, m in placed.groupBy("centre").count().collect()}
    centre_of = [c for c in sorted(splits) for _ in range(splits[c])]  # a cluster of too many members is several clusters around one centre
    begins = F.create_map(*(F.lit(x) for c in sorted(splits) for x in (c, centre_of.index(c))))
    ways = F.create_map(*(F.lit(x) for c in sorted(splits) for x in (c, splits[c])))
    numbered = placed.select("number", "angle", (F.element_at(begins, F.col("centre")) + F.pmod(F.xxhash64("number"), F.element_at(ways, F.col("centre")))).alias("cluster"))
    members = written(asked.join(numbered, "number"), "clustered")
    radius = np.zeros(len(centre_of))
    for c, widest in members.groupBy("cluster").agg(F.max("angle")).collect():
        radius[c] = widest
    lists = _lists(rows, centres[centre_of], radius)

    any_score = F.array(F.struct(F.lit(LOWEST).alias("low"), F.lit(-LOWEST).alias("high")))
    first = _walked(rows, members.withColumn("windows", any_score), lists, positives, True)
    best = first.filter("key is not null").withColumn("place", F.row_number().over(_best())).filter(F.col("place") <= positives)
    of_anchor = best.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("place", "key", "score"))).alias("positives"))  # ``positives`` entries at most

    def share(p: int, score: Column) -> Column:
        """floor(p score / 100) without leaving 64 bits."""
        rest = F.pmod(score, F.lit(100))
        return F.call_function("div", score - rest, F.lit(100)) * p + F.call_function("div", rest * p, F.lit(100))

    window = F.transform("positives", lambda x: F.struct((-share(percent[0], -x["score"])).alias("low"), share(percent[1], x["score"]).alias("high")))
    again = written(members.join(of_anchor, "number").withColumn("windows", window), "positives")
    second = _walked(rows, again.drop("positives"), lists, negatives, False)
    chosen = second.filter("key is not null").withColumn("rank", F.row_number().over(_best())).filter(F.col("rank") <= negatives)
    told = again.select("number", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("window", "p")).select("number", "window", "anchor_id", F.col("p.key").alias("positive_id"), F.col("p.score").alias("positive_score"))
    result = told.join(chosen, ["number", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return result, first.unionByName(second).filter("key is null").select("walked")


def hard_negatives(vectors: DataFrame, *, anchor: Column, **options: object) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every row for which ``anchor`` (of column ``id``) holds and each of its
    ``positives`` best rows of the same label the ``negatives`` best rows of other labels that score ``percent`` of the positive's score."""
    return mined(vectors, anchor=anchor, **options)[0]
