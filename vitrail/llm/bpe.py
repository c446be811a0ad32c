"""Byte-level BPE encoding of a whole corpus with a public vocabulary.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token that is a vocabulary entry as a
whole; it takes about two bytes an entry besides the entries and one vectorised probe a distinct pre-token. The
others are merged by rank with a heap over a linked list of their bytes, O(n log n) for any length. Both
results are remembered in each worker, up to a bound, since few pre-tokens make most of a corpus.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = os.path.join(os.environ.get("VITRAIL_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Fixed value: the pre-token pattern that belongs to the public byte-level vocabularies.
DEFAULT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_ENTRIES = 400_000
CHUNK = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def public_pattern() -> str:
    """The pattern that comes with the installed vocabularies, else ``DEFAULT_PATTERN``."""
    try:
        import public_tokenizers

        return public_tokenizers.PATTERN
    except ImportError:
        return DEFAULT_PATTERN


def _slots(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ (seed.astype(np.uint64) * _MIX)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return (x % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash from byte strings to 0..n-1, by hash and displace.

    Buckets are placed largest first with the smallest seed that sends their keys to free slots;
    buckets of one key take the free slots that remain and store them directly, as negative numbers.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n = n
        self.buckets = max(1, n // 3)
        self.seeds = np.zeros(self.buckets, np.int32)
        h = self.hashes(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(edges)
        taken = np.zeros(n, bool)
        self.slot_of = np.zeros(n, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            members = order[edges[b] : edges[b + 1]]
            seed = 0
            while True:
                slots = _slots(np.repeat(h[members], 32).reshape(-1, 32), np.arange(seed + 1, seed + 33)[None, :], n)
                free = ~taken[slots].any(0)
                free &= (np.diff(np.sort(slots, axis=0), axis=0) != 0).all(0)
                if free.any():
                    k = int(np.argmax(free))
                    self.seeds[b] = seed + 1 + k
                    taken[slots[:, k]] = True
                    self.slot_of[members] = slots[:, k]
                    break
                seed += 32
        left = iter(np.flatnonzero(~taken))
        for b in np.flatnonzero(sizes == 1):
            slot = next(left)
            self.seeds[b] = -slot - 1
            self.slot_of[order[edges[b]]] = slot

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """The only slot where each key can be; whether it is there shows the key stored in the slot."""
        h = self.hashes(keys)
        seeds = self.seeds[(h % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(seeds < 0, -seeds.astype(np.int64) - 1, _slots(h, np.maximum(seeds, 0), self.n))


class ByteBpe:
    """Encodes texts to ids. ``ranks``: byte strings to ids, ids being merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.keys: list[bytes] = [b""] * len(keys)
        self.ids = np.zeros(len(keys), np.int32)
        for key, slot in zip(keys, self.hash.slot_of.tolist()):
            self.keys[slot] = key
            self.ids[slot] = ranks[key]
        self.pattern_text = pattern
        self._reset()

    def _reset(self) -> None:
        self.pattern = regex.compile(self.pattern_text)
        self.memo: dict[str, int] = {}
        self.start, self.length, self.flat, self.used, self.entries = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.int32), 0, 0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("pattern", "memo", "start", "length", "flat", "used", "entries")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no entry: the adjacent pair of lowest rank is merged first, the leftmost of equals."""
        n = len(word)
        ranks = self.ranks
        ends = list(range(1, n + 1))  # the part that begins at i ends at ends[i]
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := ends[i]) >= n or ends[j] != end:
                continue
            alive[j] = 0
            ends[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(word[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : ends[i]]])
            i = ends[i]
        return out

    def _learn(self, words: list[str]) -> None:
        coded = [w.encode() for w in words]
        slots = self.hash.probe(coded).tolist()
        found = [[int(self.ids[s])] if self.keys[s] == c else self.merge(c) for c, s in zip(coded, slots)]
        need, n = self.used + sum(map(len, found)), self.entries + len(found)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(need, np.int32)])
        if n > len(self.start):
            self.start, self.length = np.concatenate([self.start, np.zeros(n, np.int64)]), np.concatenate([self.length, np.zeros(n, np.int32)])
        for w, ids in zip(words, found):
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[self.entries], self.length[self.entries] = self.used, len(ids)
            self.memo[w] = self.entries
            self.used += len(ids)
            self.entries += 1

    def _codes(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        try:
            return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(memo) > MEMO_ENTRIES:
                self._reset()
                memo = self.memo
            self._learn([w for w in dict.fromkeys(words) if w not in memo])
            return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= CHUNK:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while words := [m.group() for m in islice(found, CHUNK)]:
            yield words

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of ``text`` without special tokens; none for an empty or null text, blank text as it is."""
        if not text:
            return np.zeros(0, np.int32)
        out = []
        for words in self._pieces(text):
            codes = self._codes(words)
            lengths = self.length[codes]
            total = int(lengths.sum())
            if total == len(codes):
                out.append(self.flat[self.start[codes]])
            else:
                at = np.repeat(self.start[codes] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
                out.append(self.flat[at])
        return out[0] if len(out) == 1 else np.concatenate(out)

    def count(self, text: str | None) -> int:
        """The number of ids of ``text``."""
        total = 0
        for words in self._pieces(text or ""):
            codes = self._codes(words)  # may move self.length
            total += int(self.length[codes].sum())
        return total


@lru_cache(maxsize=4)
def load(path: str = DEFAULT_VOCABULARY, pattern: str | None = None) -> ByteBpe:
    """The encoder of a vocabulary file of lines "base64 rank"."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return ByteBpe(ranks, pattern or public_pattern())


def encode_corpus(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id_column, ids array<int>): the token ids of each row's text.

    Empty and null texts have the empty list; blank text is encoded as it is. Rows with repeated or null ids come out each for itself; other columns
    don't matter. The encoder (2 MB, the size of the vocabulary) is broadcast; no row is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(vocabulary))
    slim = df.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    id_type = slim.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in batches:
            for part in _by_size(batch):
                coded = [bpe.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(coded) + 1, np.int32)
                np.cumsum([len(c) for c in coded], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded) if coded else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["_id", "ids"])

    return slim.mapInArrow(run, f"_id {id_type}, ids array<int>").withColumnRenamed("_id", id_column)


def count_tokens(df: DataFrame, text_column: str = "text", into: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` without its text and with the number of tokens of the text; 0 for empty and null texts."""
    shared = df.sparkSession.sparkContext.broadcast(load(vocabulary))
    kept = [c for c in df.columns if c != text_column]
    slim = df.select(*kept, F.col(text_column).cast("string").alias(text_column))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + f", `{into}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in batches:
            n = pa.array([bpe.count(t) for t in batch.column(len(kept)).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], n], [*kept, into])

    return slim.mapInArrow(run, schema)


def _by_size(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes of text, so that long texts don't gather in one result."""
    if batch.nbytes <= limit or batch.num_rows <= 1:
        yield batch
        return
    step = max(1, batch.num_rows * limit // batch.nbytes)
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)
