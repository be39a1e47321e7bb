"""Encoding of a corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The public pattern that splits text before merging, with the
# white space of Unicode spelled out, since \s differs between regex libraries.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Distinct pre-tokens a worker remembers before it starts afresh.
MEMO = 400_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k.tiktoken among the installed public tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash over byte strings, by displaced buckets.

    n keys fall into buckets by the upper half of a 64-bit hash; largest first,
    each bucket gets the smallest displacement that sends its keys to free slots
    of 0..n-1. A look-up is two array reads; whether the key is the slot's own is
    for the caller to compare.
    """

    LOAD = 4

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, -(-n // self.LOAD))
        self.shift = np.zeros(self.buckets, np.uint32)
        hashes = self.hashes(keys)
        if len(np.unique(hashes)) != n:
            raise ValueError("keys repeat, or their 64-bit hashes collide")
        bucket = self._bucket(hashes)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(n, bool)
        for b in np.argsort(-np.diff(starts), kind="stable"):
            members = hashes[order[starts[b] : starts[b + 1]]]
            if not len(members):
                break
            d, tries = 0, 64
            while True:
                slots = self._slot(members[None, :], np.arange(d, d + tries, dtype=np.uint64)[:, None])
                good = free[slots].all(axis=1)
                if len(members) > 1:
                    s = np.sort(slots, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if good.any():
                    i = int(good.argmax())
                    self.shift[b] = d + i
                    free[slots[i]] = False
                    break
                d, tries = d + tries, min(4 * tries, 1 << 16)

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (((h >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int64)

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return ((x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        h = self.hashes(keys)
        return self._slot(h, self.shift[self._bucket(h)].astype(np.uint64))


class Encoder:
    """Two-tier encoder: whole pre-tokens by perfect hash, the rest by merging."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks = ranks
        words = list(ranks)
        self.table = PerfectHash(words)
        slot = self.table.slots(words)
        self.words: list[bytes] = [b""] * len(words)
        self.ids = np.zeros(len(words), np.int32)
        for s, w in zip(slot.tolist(), words):
            self.words[s] = w
        self.ids[slot] = np.fromiter(ranks.values(), np.int32, len(words))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: merge the pair of lowest rank, leftmost first, until none is left.

        The bytes are a doubly linked list; a heap holds the candidate pairs, and
        a pair whose ends have changed since is skipped. O(n log n).
        """
        n, ranks = len(word), self.ranks
        end = list(range(1, n + 1))  # end of the piece that starts here; 0 if merged away
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := ranks.get(word[i : i + 2])) is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= stop or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for w, s in zip(words, self.table.slots(words).tolist() if words else ()):
            out.append([int(self.ids[s])] if self.words[s] == w else self.merge(w))
        return out


class BatchEncoder:
    """Encodes lists of texts; remembers the ids of distinct pre-tokens."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.find = regex.compile(PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        ids = self.encoder.encode_words([w.encode() for w in new])
        base = len(self.code)
        self.code.update(zip(new, range(base, base + len(new))))
        self.flat = np.concatenate([self.flat, np.fromiter((x for i in ids for x in i), np.int32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(i) for i in ids], dtype=np.int64)])

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The code of each pre-token of all texts, and where each text's codes end."""
        if len(self.code) > MEMO:
            self._reset()
        parts = [self.find(t) if t else [] for t in texts]
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        flat = [w for p in parts for w in p]
        if new := set(flat).difference(self.code):
            self._learn(sorted(new))
        return np.fromiter(map(self.code.__getitem__, flat), np.int64, len(flat)), ends

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        code, ends = self.codes(texts)
        total = np.concatenate([[0], np.cumsum(np.diff(self.start)[code])])
        return np.diff(np.concatenate([[0], total[ends]])).astype(np.int64)

    def ids(self, texts: list[str | None]) -> pa.ListArray:
        code, ends = self.codes(texts)
        count = np.diff(self.start)[code]
        stop = np.cumsum(count)
        total = int(stop[-1]) if len(stop) else 0
        pick = np.arange(total) + np.repeat(self.start[code] - (stop - count), count)
        offsets = np.concatenate([[0], np.concatenate([[0], stop])[ends]])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.flat[pick], pa.int32()))


def _batches(rows: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    for b in rows:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def _shared(df: DataFrame, vocabulary: str | None):
    # the vocabulary file is the size bound of what is broadcast
    return df.sparkSession.sparkContext.broadcast(Encoder(load_ranks(vocabulary or default_vocabulary())))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of each text, without special tokens.

    One row for each input row, in any order; a null text and an empty one give
    an empty list. The strings of special tokens are ordinary text. No shuffle.
    """
    shared = _shared(df, vocabulary)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BatchEncoder(shared.value)
        for b in _batches(rows):
            yield pa.RecordBatch.from_arrays([b.column(0), encoder.ids(b.column(1).to_pylist())], ["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of each text; 0 for a null or empty one."""
    shared = _shared(df, vocabulary)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BatchEncoder(shared.value)
        for b in _batches(rows):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encoder.lengths(b.column(1).to_pylist()))], ["doc_id", "n_tokens"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
