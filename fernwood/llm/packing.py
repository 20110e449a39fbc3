"""Packing tokenised documents into windows by Karmarkar-Karp multiway differencing.

Every task packs the documents it reads, in bounded batches, so nothing is shuffled and no group meets in one place:

* a document's full windows are sequences of their own (nothing is left to balance there); the rest is cut into pieces of at most ``piece`` tokens;
* a batch of pieces is dealt to k windows. Each piece starts as a partial partition (its size and k - 1 zeros). The
  two partial partitions with the largest spreads are merged again and again, the largest window of one on the
  smallest of the other, so that imbalances cancel. If the fullest window exceeds the capacity, k rises and the
  batch is dealt again;
* what a batch holds beyond k windows (less than one window plus the slack) is cut into sequences of a power of two,
  which need no padding, down to one token. A task's last batch is small, so its pieces are cut to a quarter. A task that
  has less than one window of such rests has no window to balance: all of it goes this way. At 1,000 documents about a third
  of the tokens are in full windows.

A row is a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset. sequence_id joins the number of the
task's partition and a running number; a task that runs again gives the same ids.

Defined cases: null and empty texts have one token (the end token); repeated rows are packed as often as they occur;
an empty table gives no rows; other columns are ignored; texts of any length are packed whole.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
OUT = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window (0..k-1) of every size, by merging the partial partitions with the largest spreads."""
    n = len(sizes)
    lane = np.zeros(n, np.int64)
    if k == 1 or n <= 1:
        return lane
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}

    def partial(i: int) -> np.ndarray:
        if i >= n:
            return sums.pop(i)
        alone = np.zeros(k, np.int64)
        alone[0] = sizes[i]
        return alone

    merges = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        joined = partial(a) + partial(b)[::-1]
        order = np.argsort(-joined, kind="stable")
        joined = joined[order]
        node = n + len(merges)
        merges.append((a, b, order))
        sums[node] = joined - joined[-1]
        heapq.heappush(heap, (-int(joined[0] - joined[-1]), node))
    windows = {n + len(merges) - 1: np.arange(k)}
    for t in range(len(merges) - 1, -1, -1):
        a, b, order = merges[t]
        at = np.empty(k, np.int64)
        at[order] = windows.pop(n + t)
        for child, its in ((a, at), (b, at[::-1])):
            if child < n:
                lane[child] = its[0]
            else:
                windows[child] = its
    return lane


class Packer:
    """Packs one partition's documents; ``rows`` are finished pieces in columns."""

    def __init__(self, first_id: int, capacity: int, piece: int, batch: int, slack: int) -> None:
        self.next_id, self.capacity, self.piece, self.batch, self.slack = first_id, capacity, piece, batch, slack
        self.pieces: list[tuple[int, int, bytes, int]] = []
        self.rows: list[tuple[int, int, int, int, int, int, int]] = []

    def write(self, sequence: int, offset: int, doc: int, start: int, ids: bytes, total: int) -> None:
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))

    def sequence(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, doc: int, ids: bytes) -> None:
        total, step = len(ids) // 4, self.capacity
        full = total - total % step
        for start in range(0, full, step):
            self.write(self.sequence(), 0, doc, start, ids[4 * start : 4 * (start + step)], total)
        for start in range(full, total, self.piece):
            self.pieces.append((doc, start, ids[4 * start : 4 * min(total, start + self.piece)], total))
        if len(self.pieces) >= self.batch:
            self.flush()

    def flush(self) -> None:
        pieces, self.pieces = self.pieces, []
        total = sum(len(p[2]) for p in pieces) // 4
        k = total // self.capacity
        if len(pieces) < self.batch:  # few windows come out uneven; smaller pieces even them
            fine = max(1, self.piece // 4)
            pieces = [(doc, start + at, ids[4 * at : 4 * (at + fine)], of) for doc, start, ids, of in pieces for at in range(0, len(ids) // 4, fine)]
        self.powers_of_two(pieces, total - k * (self.capacity - self.slack))
        sizes = [len(p[2]) // 4 for p in pieces]
        while sizes:
            lane = differencing(sizes, k)
            if np.bincount(lane, weights=sizes, minlength=k).max() <= self.capacity:
                break
            k += 1
        if sizes:
            filled = [0] * k
            first = self.next_id
            self.next_id += k
            for (doc, start, ids, of), window in zip(pieces, lane.tolist(), strict=True):
                self.write(first + window, filled[window], doc, start, ids, of)
                filled[window] += len(ids) // 4

    def powers_of_two(self, pieces: list[tuple[int, int, bytes, int]], rest: int) -> None:
        """Takes ``rest`` tokens off the pieces, cutting where needed, into sequences that need no padding."""
        while rest:
            room = min(self.capacity, 1 << (rest.bit_length() - 1))
            rest -= room
            sequence, offset = self.sequence(), 0
            while room:
                doc, start, ids, of = pieces.pop()
                if len(ids) // 4 > room:  # its head stays for another window
                    keep = len(ids) - 4 * room
                    pieces.append((doc, start, ids[:keep], of))
                    start, ids = start + keep // 4, ids[keep:]
                self.write(sequence, offset, doc, start, ids, of)
                offset += len(ids) // 4
                room -= len(ids) // 4

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=OUT)


def pack(docs: DataFrame, path: str, *, end_id: int = 1, capacity: int = 2048, piece: int = 512, batch: int = 2048, slack: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens; ``slack`` is the room left in a window for differencing to be uneven."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, piece, batch, slack)
        for part, found in bpe.encode_batches(batches, bpe.merge_encoder(path).encode, text):
            for doc, ids in zip(part.column(0).to_pylist(), found, strict=True):
                packer.add(doc, ids + end)
            if len(packer.rows) > 20_000:
                yield packer.take()
        if packer.pieces:
            packer.flush()
        if packer.rows:
            yield packer.take()

    return docs.select(docs[key].cast("long").alias(key), docs[text].cast("string").alias(text)).mapInArrow(run, SCHEMA.replace("doc_id", key, 1))
