"""Words of whole texts as numpy arrays, read straight from Arrow's string buffers.

A word is a maximal run of bytes other than space and TAB..CR (``[^\\x20\\x09-\\x0D]+``). UTF-8 keeps those
bytes out of longer sequences, so byte offsets and code points agree on where a word starts and ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
TYPES = {"long": LongType(), "boolean": BooleanType(), "double": DoubleType(), "string": StringType()}
LONG_WORD = 256  # bytes; longer words are hashed one by one
MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * MULT[2]
    x = x ^ (x >> np.uint64(29))
    x = x * MULT[1]
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; null texts are empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[at[0] : at[-1]]
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (n+1 values)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    solid = ~SPACE[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[at] = True
    starts = np.flatnonzero(solid & (first[:-1] | np.concatenate(([True], ~solid[:-1]))))
    ends = np.flatnonzero(solid & (first[1:] | np.concatenate((~solid[1:], [True])))) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: equal words agree; words of up to 8 bytes and one length never collide."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * MULT[0])
    if not len(starts):
        return out
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    live, k = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        left = np.minimum(size[live] - k, 8)
        out[live] = mix((out[live] ^ (eight[starts[live] + k] & MASKS[left])) * MULT[0])
        k += 8
        live = live[size[live] > k]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def slices(batch: pa.RecordBatch, limit: int = 4 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in row ranges of about ``limit`` bytes of text (a longer text alone), so work memory stays bounded."""
    column = batch.column(batch.schema.get_field_index(name))
    _, at = text_bytes(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n words, in order; a shorter sequence of words gives one hash of all of it."""
    if not len(words):
        return words
    m = min(n, len(words))
    out = np.full(len(words) - m + 1, m, dtype=np.uint64)
    for k in range(m):
        out = mix((out * MULT[0]) ^ words[k : len(words) - m + 1 + k])
    return out


def appended(docs: DataFrame, fields: dict[str, str], make: Callable[[], Callable[[pa.Array], list[pa.Array]]], *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with columns computed from its texts, batch by batch and without a shuffle.

    ``fields``: name -> long, boolean, double or string. ``make`` runs once a task and gives the function from a slice of texts to the new columns.
    ``carry``: the columns that stay (all of them if None); one named like a new column gives way to it.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c not in fields]
    own = "_text"
    while own in keep:
        own += "_"
    source = docs.select(*(docs[c] for c in keep), docs[text].cast("string").alias(own))
    schema = StructType([*source.schema.fields[:-1], *(StructField(k, TYPES[v]) for k, v in fields.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch, name=own):
                columns = [part.column(i) for i in range(len(keep))] + compute(part.column(len(keep)))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *fields])

    return source.mapInArrow(run, schema)
