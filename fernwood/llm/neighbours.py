"""Approximate nearest neighbours by cosine: low-dimensional stable projections in kd-trees with a chi-square stop.

Unit vectors are projected onto ``DIMS`` Gaussian directions (2-stable: a projected squared distance is the true one
times a chi-square variable). A tree fitted on a bounded sample of projections cuts the space into cells, whose number grows
with the table; a cell's rows are dealt by hash to shards of bounded size, so a vector that fills a third of the table only
makes more shards. Every row is indexed. A shard's search walks the leaves of its own kd-tree by projected distance and
verifies the true similarity of rows within reach until the test holds: once the next leaf's projected squared distance exceeds
the ``CONFIDENCE`` quantile times the k-th best squared distance found so far, a row beyond it is nearer with probability
1 - ``CONFIDENCE`` at most. So a true neighbour is missed with that chance, whatever the number of rows; recall is
measured in the tests, as is the share of rows verified.

A query visits cells in the order of their projected distance, in rounds: first the nearest cell, then the next few, then
the rest, each time only those that the test with the bound found so far does not exclude. Queries of a cell come in blocks;
a (shard, block of queries) is one group of bounded size.

Defined cases: null, empty and zero vectors, vectors with null or non-finite components and null keys take no part, nor do
vectors of another length than the most common one (of equally common ones, the longer); a query sees neither itself nor rows
with its own key; ties go to the smaller key; fewer candidates than k give fewer rows; equal rows (key and vector) count
once, as queries and as candidates; rows of one key with different vectors are queries of their own and candidates each; no
rows give none; other columns are ignored. Scores are of the original components in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, written

DIMS = 32
CONFIDENCE = 0.88
LEAST, SHARD = 1_024, 65_536  # rows of a cell, at least and at most; in between, a 64th of the table
LEAF = 32
SAMPLE = 16_384  # projections that the cells are fitted on
CELLS = 4_096  # at most; fuller cells have more shards
QUERY_BLOCK = 16_384
STRIDE = 8  # leaves verified between two tests
ROUNDS = ((0, 1), (1, 8), (8, CELLS))  # cells by projected distance that a round visits
SEED = 7


def chi_square_quantile(p: float, dims: int) -> float:
    """Quantile for an even number of degrees of freedom, by bisection of the closed form."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(dims // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def directions(length: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((length, DIMS))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


class Tree:
    """A kd-tree of bounded leaves over points; leaves are index ranges of ``order`` with bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.order = np.arange(len(points))
        spans, done = [(0, len(points))], []
        while spans:
            a, b = spans.pop()
            part = points[self.order[a:b]]
            wide = part.max(axis=0) - part.min(axis=0)
            if b - a <= leaf or not wide.max() > 0:
                done += [(i, min(i + leaf, b)) for i in range(a, b, leaf)]
                continue
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, int(wide.argmax())], mid)]
            spans += [(a, a + mid), (a + mid, b)]
        self.leaves = np.array(sorted(done)).reshape(-1, 2)
        self.low = np.array([points[self.order[a:b]].min(axis=0) for a, b in self.leaves]).reshape(-1, points.shape[1])
        self.high = np.array([points[self.order[a:b]].max(axis=0) for a, b in self.leaves]).reshape(-1, points.shape[1])

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance from a point to every leaf's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1)


class Cells:
    """Splits of projected space, fitted on a sample; cell numbers are paths in the tree."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.axis = np.zeros(1 << depth, np.int64)
        self.at = np.zeros(1 << depth)
        parts = {1: sample}
        for node in range(1, 1 << depth):
            part = parts.pop(node)
            axis = int((part.max(axis=0) - part.min(axis=0)).argmax()) if len(part) else 0
            self.axis[node], self.at[node] = axis, np.median(part[:, axis]) if len(part) else 0.0
            right = part[:, axis] > self.at[node] if len(part) else np.zeros(0, bool)
            parts[2 * node], parts[2 * node + 1] = part[~right], part[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node


def search(keys: np.ndarray, vectors: np.ndarray, queries: list[tuple[int, int, np.ndarray, float]], k: int) -> tuple[list[tuple[int, int, int, float]], int]:
    """(query number, query key, key, score) of the k nearest of every (number, key, vector, score known so far) in one shard, and how many rows were verified."""
    quantile = chi_square_quantile(CONFIDENCE, DIMS)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    units = vectors / norms[:, None]
    turn = directions(vectors.shape[1])
    points = units @ turn
    tree = Tree(points, LEAF)
    units, points, keys, vectors, norms = (x[tree.order] for x in (units, points, keys, vectors, norms))
    out, verified = [], 0
    for number, query, v, known in queries:
        size = math.sqrt(float((v * v).sum()))
        u = v / size
        p = u @ turn
        box = tree.distances(p)
        by_distance = np.argsort(box, kind="stable")
        best = np.full(k, known)
        picked: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        for i in range(0, len(by_distance), STRIDE):
            reach = quantile * max(0.0, 2 - 2 * best[-1]) + 1e-9
            if box[by_distance[i]] > reach:
                break
            rows = np.concatenate([np.arange(a, b) for a, b in tree.leaves[by_distance[i : i + STRIDE]]])
            gap = points[rows] - p
            rows = rows[((gap * gap).sum(axis=1) <= reach) & (keys[rows] != query)]
            verified += len(rows)
            got = units[rows] @ u
            near = got >= best[-1] - 1e-9
            if near.any():
                picked.append(rows[near])
                scores.append(got[near])
                best = np.sort(np.concatenate((best, got[near])))[::-1][:k]
        if picked:
            rows, got = np.concatenate(picked), np.concatenate(scores)
            rows = rows[got >= best[-1] - 1e-9]
            exact = (vectors[rows] * v).sum(axis=1) / (norms[rows] * size)  # the same sum for equal vectors, so ties are ties
            for j in np.lexsort((keys[rows], -exact))[:k]:
                out.append((number, query, int(keys[rows[j]]), float(exact[j])))
    return out, verified


def _packed(batch: pa.RecordBatch, at: int, kind: str) -> np.ndarray:
    """A binary column of equally long vectors as a matrix of doubles."""
    rows = batch.column(at).to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


def _rows(vectors: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """id, v (bytes of the components) of the different vectors that can take part: copies of a row go here, before anything is sampled, counted or dealt out."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not row or None in row:
                    continue
                v = np.array(row, kind)
                if np.isfinite(v).all() and v.any():
                    ids.append(i)
                    out.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], schema=schema)

    return vectors.select(F.col(key).cast("long"), F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>")).mapInArrow(run, "id long, v binary").distinct()


def nearest(vectors: DataFrame, *, k: int = 5, query: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of every row for which ``query`` (of column ``id``) holds."""
    return searched(vectors, k=k, query=query, key=key, vector=vector)[0]


def searched(vectors: DataFrame, *, k: int, query: Column, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The rows of ``nearest``, and a table whose column ``verified`` sums to the number of (query, row) pairs verified."""
    kind = "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    parsed = written(_rows(vectors, key, vector, kind), "vectors")
    spark = parsed.sparkSession
    lengths = parsed.groupBy(F.length("v").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), spark.createDataFrame([], "verified long")
    size, n = lengths[0]
    rows = parsed.filter(F.length("v") == size)
    turn = directions(size // int(kind[2]))
    full = min(max(LEAST, n // 64), SHARD)
    depth = max(0, math.ceil(math.log2(min(CELLS, n / full))))
    sample = np.array([np.frombuffer(r["v"], kind) for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()], np.float64)
    cells = Cells(unit(sample) @ turn, depth)
    names = [f"c{j}" for j in range(DIMS)]
    doubles = ", ".join(f"{c} double" for c in names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = unit(_packed(batch, 1, kind)) @ turn
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells.of(points)), *(pa.array(np.ascontiguousarray(c)) for c in points.T)], names=["id", "v", "cell", *names])

    placed = written(rows.mapInArrow(place, f"id long, v binary, cell long, {doubles}"), "placed")
    dropped(parsed)
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{side}") for c in names for f, side in ((F.min, "low"), (F.max, "high")))).collect()  # at most CELLS rows
    salts = {r["cell"]: math.ceil(r["n"] / (2 * full)) for r in boxes}
    low, high = (np.array([[r[f"{c}{side}"] for c in names] for r in boxes]) for side in ("low", "high"))
    ids = np.array([r["cell"] for r in boxes])
    salt_of = F.create_map(*(F.lit(x) for r in salts.items() for x in r))
    data = placed.select("id", "v", "cell", F.pmod(F.xxhash64("id", "v"), F.element_at(salt_of, F.col("cell"))).cast("int").alias("salt"))
    asked = written(placed.filter(query).withColumn("number", F.monotonically_increasing_id()), "asked")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    asked_in = asked.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int"))
    quantile = chi_square_quantile(CONFIDENCE, DIMS)
    plan = "number long, id long, v binary, bound double, block int, cell long, salt int"
    answer = pa.schema([("number", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("verified", pa.int64())])

    def routes(ranks: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """One row for every shard that a query visits in a round: of the cells with these ranks by projected distance, those that its bound leaves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for number, i, v, bound, block, cell, *point in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    gap = np.maximum(np.maximum(low - point, point - high), 0)
                    far = (gap * gap).sum(axis=1)
                    order = np.lexsort((ids, ids != cell, far))[ranks[0] : ranks[1]]
                    near = order[far[order] <= quantile * max(0.0, 2 - 2 * bound) + 1e-9]
                    out += [(number, i, v, bound, block, c, s) for c in ids[near].tolist() for s in range(salts[c])]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=["number", "id", "v", "bound", "block", "cell", "salt"])

        return run

    def in_shard(group: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        verified = 0
        if left.num_rows and right.num_rows:
            q, d = left.combine_chunks().to_batches()[0], right.combine_chunks().to_batches()[0]
            at = [q.schema.get_field_index(c) for c in ("number", "id", "v", "bound")]
            asks = list(zip(q.column(at[0]).to_pylist(), q.column(at[1]).to_pylist(), _packed(q, at[2], kind), q.column(at[3]).to_pylist(), strict=True))
            rows = list(zip(d.column("id").to_pylist(), d.column("v").to_pylist(), strict=True))
            matrix = np.frombuffer(b"".join(v for _, v in rows), kind).reshape(len(rows), -1).astype(np.float64)
            found, verified = search(np.array([i for i, _ in rows]), matrix, asks, k)
        found.append((None, None, None, None, verified))
        return pa.table([pa.array([(r[j] if j < len(r) else None) for r in found], f.type) for j, f in enumerate(answer)], schema=answer)

    best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    found = spark.createDataFrame([], "number long, query_id long, vec_id long, score double, verified long")
    for ranks in ROUNDS:
        if ranks[0] >= len(boxes):
            break
        kth = found.filter("score is not null").withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("number", F.col("score").alias("kth"))
        queries = asked_in.join(kth, "number", "left").select("number", "id", "v", F.coalesce("kth", F.lit(-1.0)).alias("bound"), "block", "cell", *names)
        todo = written(queries.mapInArrow(routes(ranks), plan), "visits")
        shards = data.join(todo.select("cell", "salt", F.col("block").alias("for_block")).distinct(), ["cell", "salt"])
        pairs = todo.groupBy("cell", "salt", "block").cogroup(shards.groupBy("cell", "salt", "for_block"))
        more = written(pairs.applyInArrow(in_shard, "number long, query_id long, vec_id long, score double, verified long"), "found")
        dropped(todo)
        found = found.unionByName(more)
    dropped(placed)
    dropped(asked)
    ranked = found.filter("score is not null").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), found.filter("score is null").select("verified")
