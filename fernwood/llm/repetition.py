"""Quality rules from a suffix array of each document's words.

The suffix array comes from prefix doubling over word ids; the ranks of every doubling step are kept, so the longest
common prefix of neighbouring suffixes follows by comparing ranks from the largest step down. Every position's longest
repeat is the larger of its two neighbouring prefixes; these are the maximal repeated substrings, the spans of the
prefix intervals. The union of the spans of at least ``window`` words is the covered part. A document is rejected if
the covered part exceeds a percentage of its words, or if its longest repeat is too long, in words and as a share.

Words are ``[^\\x20\\x09-\\x0D]+``, compared by 64-bit hashes. Work memory is about 8 bytes a word and doubling step of
one document (steps: log2 of its longest repeat), and one document is never split.

Defined cases: a null, empty or blank text has no words, all counts 0, fails the base rule and is not kept; repeated
rows are judged each for themselves; null keys stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))
WINDOW = 8  # words of a repeat that counts
MIN_WORDS = 20
MAX_COVERED_PERCENT = 30
LONGEST_WORDS, LONGEST_PERCENT = 40, 15  # a repeat longer than both is rejected


def suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a sequence and the longest common prefixes of neighbours (lcp[k]: of suffixes k - 1 and k; lcp[0] = 0)."""
    n = len(ids)
    if n < 2:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    levels, step = [rank], 1
    while True:
        after = np.zeros(n, np.int64)
        if step < n:
            after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        if new[-1] == n - 1:
            break
        rank = np.empty(n, np.int64)
        rank[order] = new
        levels.append(rank)
        step *= 2
    left, right = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level, size = levels[k], 1 << k
        inside = (left + size <= n) & (right + size <= n)
        same = np.flatnonzero(inside)
        same = same[level[left[same]] == level[right[same]]] if len(same) else same
        # Ranks of a step also tell short tails apart, so equal ranks inside the text mean equal words.
        left[same] += size
        right[same] += size
        lcp[same] += size
    return order, np.concatenate(([0], lcp))


def repeats(ids: np.ndarray, window: int = WINDOW) -> tuple[int, int]:
    """Words covered by repeated substrings of at least ``window`` words, and the words of the longest repeat."""
    order, lcp = suffixes(ids)
    if not len(lcp) or lcp.max() < window:
        return 0, int(lcp.max()) if len(lcp) else 0
    longest = np.maximum(lcp, np.append(lcp[1:], 0))
    at = np.flatnonzero(longest >= window)
    open_close = np.zeros(len(ids) + 1, np.int64)
    np.add.at(open_close, order[at], 1)
    np.add.at(open_close, order[at] + longest[at], -1)
    return int(np.count_nonzero(np.cumsum(open_close[:-1]) > 0)), int(lcp.max())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    count = 0
    for line in text.split("\n"):
        if line in seen:
            count += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    return count


FIELDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "longest_repeat": "long", "base_failed": "boolean", "kept": "boolean"}


def judge(docs: DataFrame, *, text: str = "text", carry: list[str] | None = None, max_covered_percent: int = MAX_COVERED_PERCENT, longest_words: int = LONGEST_WORDS, longest_percent: int = LONGEST_PERCENT) -> DataFrame:
    """``docs`` (or its columns ``carry``) with the counts of FIELDS, base_failed and kept for every row."""

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        def compute(column: pa.Array) -> list[pa.Array]:
            raw, at = words.text_bytes(column)
            starts, ends, first = words.word_spans(raw, at)
            hashes = words.word_hashes(raw, starts, ends)
            solid = np.concatenate(([0], np.cumsum(~words.SPACE[raw] & ((raw & 0xC0) != 0x80))))
            symbols = np.concatenate(([0], np.cumsum(IS_SYMBOL[raw])))
            n = np.diff(first)
            lines = np.array([duplicate_lines(t) if t else 0 for t in column.to_pylist()], np.int64)
            found = np.array([repeats(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], np.int64).reshape(-1, 2)
            covered, longest = found[:, 0].copy(), found[:, 1].copy()
            failed = (n < MIN_WORDS) | (100 * covered > 30 * n)
            bad = (100 * covered > max_covered_percent * n) | ((longest > longest_words) & (100 * longest > longest_percent * n))
            return [pa.array(x) for x in (n, solid[at[1:]] - solid[at[:-1]], symbols[at[1:]] - symbols[at[:-1]], lines, covered, longest, failed, ~failed & ~bad)]

        return compute

    return words.appended(docs, FIELDS, make, text=text, carry=carry)
