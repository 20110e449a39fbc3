"""Byte-level BPE: exact merges by backtracking over Aho-Corasick matches, and decoding by an offset table.

Encoding a pre-token: the automaton finds, in one scan, the longest vocabulary entry that starts at every byte. The
encoder takes these longest matches from left to right and keeps a token only if the pair-compatibility table says
that the merges would leave it and its left neighbour apart; else it takes the longest shorter prefix of the match,
and if none is left it gives up the position for good and goes back one token. Every position is given up at most
once, so the work is linear in the pre-token. The result equals applying the merges in rank order.

Decoding: the bytes of all tokens lie in one buffer; ``offsets[i]`` and ``offsets[i + 1]`` bound token i.

Defined cases: a null text is empty and has no tokens; special tokens standing in the text become their own id, as
the tokenizers library does; unknown ids raise IndexError in decoding. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from . import words

CACHE_WORDS = 400_000  # pre-tokens a worker remembers; the memory is emptied when full
WHITE = "\t-\r \x85\xa0  -     　"
LATIN_LETTERS, LATIN_NUMBERS, LATIN_WHITE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"


def _pattern(letters: str, numbers: str, white: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{white}{letters}{numbers}]+|[{white}]+(?![^{white}])|[{white}]+"


#: The same pre-tokens; the first is faster and right for texts within Latin-1.
SPLIT_LATIN = re.compile(_pattern(LATIN_LETTERS, LATIN_NUMBERS, LATIN_WHITE))
SPLIT_ANY = regex.compile(_pattern(r"\p{L}", r"\p{N}", WHITE))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, by the public rule: printable Latin-1 bytes stand for themselves, the others follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Memory(dict):
    """Pre-token -> its ids as little-endian 32-bit integers; bounded."""

    def __init__(self, codec: "Codec") -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = array("I", self.codec.encode_word(word.encode("utf-8", "surrogatepass"))).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Codec:
    """A vocabulary file of the tokenizers library (BPE model, ByteLevel pre-tokenizer without prefix space)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["model"]["type"] != "BPE" or spec["pre_tokenizer"].get("add_prefix_space") or spec["model"].get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        to_byte = byte_alphabet()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        self.special = special
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        # Work in ranks: bytes first, then merges in order; ids are looked up at the end.
        names = [c for c in to_byte] + [a + b for a, b in map(self._pair, spec["model"]["merges"])]
        rank = {name: r for r, name in reversed(list(enumerate(names)))}
        self.id_of = [vocab[name] for name in names]
        self.length = [len(self.bytes_of[i]) for i in self.id_of]
        self.pair: dict[tuple[int, int], int] = {}
        self.split = [(r, r) for r in range(256)] + [(-1, -1)] * (len(names) - 256)
        for a, b in map(self._pair, spec["model"]["merges"]):
            r = rank[a + b]
            if self.split[r] == (-1, -1):
                self.split[r] = (rank[a], rank[b])
            self.pair.setdefault((rank[a], rank[b]), r)
        self.matcher = ahocorasick.Automaton()
        latin = [self.bytes_of[i].decode("latin-1") for i in self.id_of]
        for r in reversed(range(len(names))):
            self.matcher.add_word(latin[r], (r, len(latin[r])))
        self.matcher.make_automaton()
        whole = {name: r for r, name in reversed(list(enumerate(latin)))}
        self.shorter = [next((whole[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in whole), -1) for name in latin]
        self.fits: dict[tuple[int, int], bool] = {}
        self.words = Memory(self)
        self.offsets = np.concatenate(([0], np.cumsum([len(b) for b in self.bytes_of]))).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    @staticmethod
    def _pair(merge: str | list[str]) -> tuple[str, str]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        return a, b

    def compatible(self, left: int, right: int) -> bool:
        """Whether merges leave ``left`` and ``right`` apart when their bytes stand side by side."""
        known = self.fits.get((left, right))
        if known is not None:
            return known
        if len(self.fits) >= 2_000_000:
            self.fits.clear()
        a, b, limit, answer = left, right, 1 << 62, True
        while True:
            joined = self.pair.get((a, b))
            if joined is not None and joined < limit:
                answer = False
                break
            # Undo the later of the two merges: the pair inside was adjacent before it happened.
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        break
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        break
        self.fits[left, right] = answer
        return answer

    def encode_word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(raw)
        longest, size = [-1] * n, [0] * n
        for end, (r, k) in self.matcher.iter(raw.decode("latin-1")):
            at = end - k + 1
            if k > size[at]:
                size[at], longest[at] = k, r
        out: list[int] = []
        closed = bytearray(n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n or token >= 0:
            last = out[-1] if out else -1
            while True:
                end = at + self.length[token]
                if not closed[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                if self.shorter[token] >= 0:
                    token = self.shorter[token]
                    continue
                closed[at] = 1
                token = out.pop()
                at -= self.length[token]
                break
        return [self.id_of[r] for r in out]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = self.cut.split(text) if self.cut is not None and any(s in text for s in self.special) else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                try:
                    part.encode("latin-1")
                    found = SPLIT_LATIN.findall(part)
                except UnicodeEncodeError:
                    found = SPLIT_ANY.findall(part)
                out.append(b"".join(map(self.words.__getitem__, found)))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids' tokens, gathered through the offset table."""
        if not len(ids):
            return b""
        if int(ids.max()) >= len(self.bytes_of):
            raise IndexError("id outside the vocabulary")
        start = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - start
        to = np.cumsum(size) - size
        return self.buffer[np.arange(int(size.sum())) + np.repeat(start - to, size)].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path)


LONG_PIECE = 1500  # characters; a merge loop over a longer pre-token takes more than linear time
LONG_WHITE = re.compile(rf"\s{{{LONG_PIECE}}}")


class MergeEncoder:
    """The same ids as ``Codec.encode``, by a compiled merge loop: faster on common text, used where encoding is only a means."""

    def __init__(self, path: str) -> None:
        self.codec = codec(path)
        ranks = {b: i for i, b in enumerate(self.codec.bytes_of) if b and i not in self.codec.special.values()}
        self.merges = tiktoken.Encoding("ranks", pat_str=_pattern(r"\p{L}", r"\p{N}", WHITE), mergeable_ranks=ranks, special_tokens=self.codec.special)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if max(map(len, text.split()), default=0) >= LONG_PIECE or LONG_WHITE.search(text):
            return self.codec.encode(text)
        return self.merges.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4").tobytes()


@lru_cache(maxsize=2)
def merge_encoder(path: str) -> MergeEncoder:
    """One for each worker process."""
    return MergeEncoder(path)


def encode_batches(batches: Iterator[pa.RecordBatch], encode: Callable[[str | None], bytes], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with the packed ids of their texts."""
    for batch in batches:
        for part in words.slices(batch, name=text):
            yield part, [encode(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]


def tokenize(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every whole text: key, n_tokens, ids (little-endian 32-bit), decoded (the decoded text's UTF-8 bytes, replaced where invalid).

    Null texts give no tokens and an empty decoded text; repeated rows stay; other columns are ignored.
    """
    schema = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part, found in encode_batches(batches, c.encode, text):
            arrays = [np.frombuffer(b, "<u4") for b in found]
            decoded = [c.decode(a).decode("utf-8", "replace").encode() for a in arrays]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(a) for a in arrays], pa.int64()), pa.array(found, pa.binary()), pa.array(decoded, pa.binary())], schema=schema)

    return docs.select(docs[key].cast("long").alias(key), docs[text].cast("string").alias(text)).mapInArrow(run, f"{key} long, n_tokens long, ids binary, decoded binary")


def token_digests(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``tokenize`` with the ids and the decoded text as sha256 digests, computed beside the encoder to keep long results out of the JVM."""
    schema = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        names = [str(i).encode() for i in range(len(c.bytes_of))]
        for part, found in encode_batches(batches, c.encode, text):
            count, one, two = [], [], []
            for packed in found:
                ids = np.frombuffer(packed, "<u4")
                count.append(len(ids))
                one.append(hashlib.sha256(b",".join(map(names.__getitem__, ids.tolist()))).hexdigest())
                two.append(hashlib.sha256(c.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], schema=schema)

    return docs.select(docs[key].cast("long").alias(key), docs[text].cast("string").alias(text)).mapInArrow(run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
