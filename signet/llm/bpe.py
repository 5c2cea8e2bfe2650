"""Byte-level BPE encoding and decoding (operator 10).

Two tiers.  A minimal perfect hash, built once from the rank file, resolves every
pre-token that is itself in the vocabulary with one hash and one comparison; the
others are merged with a heap over a doubly linked list of byte spans, so that a
pre-token of n bytes costs n log n.

Nulls and empty texts give no ids; ids of a text never depend on other texts.
Rows are independent: no shuffle, no group, bounded memory (the pre-token memo of a
worker holds two generations of MEMO entries at most).
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise
from struct import pack, unpack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
MEMO = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class PerfectHash:
    """Slots 0..n-1 for exactly the n given tokens: hash, displace, and direct slots for lone keys."""

    def __init__(self, tokens: list[bytes], load: int = 4):
        self.n, self.buckets = len(tokens), max(1, len(tokens) // load)
        groups: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for token in tokens:
            groups[xxhash.xxh64_intdigest(token) % self.buckets].append(token)
        self.shift = array("i", bytes(4 * self.buckets))
        self.tokens: list[bytes | None] = [None] * self.n
        taken = bytearray(self.n)
        lone = []
        for bucket in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            own = groups[bucket]
            if len(own) == 1:
                lone.append(bucket)
            if len(own) < 2:
                continue
            seed = 1
            while True:
                slots = {xxhash.xxh64_intdigest(token, seed) % self.n for token in own}
                if len(slots) == len(own) and not any(taken[s] for s in slots):
                    break
                seed += 1
            self.shift[bucket] = seed
            for token in own:
                slot = xxhash.xxh64_intdigest(token, seed) % self.n
                taken[slot], self.tokens[slot] = 1, token
        free = (slot for slot in range(self.n) if not taken[slot])
        for bucket, slot in zip(lone, free, strict=False):
            self.shift[bucket], self.tokens[slot] = -slot - 1, groups[bucket][0]

    def slot(self, token: bytes) -> int:
        """The token's slot, or -1 if it isn't one of the tokens."""
        if not self.n:
            return -1
        shift = self.shift[xxhash.xxh64_intdigest(token) % self.buckets]
        slot = -shift - 1 if shift < 0 else xxhash.xxh64_intdigest(token, shift) % self.n
        return slot if self.tokens[slot] == token else -1


class Codec:
    """Encoder and decoder for one rank file and one pre-token pattern; ids are kept as little-endian uint32 bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.whole = PerfectHash(list(ranks))
        self.slot_ids = [pack("<I", ranks[token]) for token in self.whole.tokens]
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {ranks[token[:i]] << 32 | ranks[token[i:]]: rank for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pattern = pattern
        self.ready()

    def ready(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.memo, self.pieces = _Memo(self.pretoken), _Memo(self.piece)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "memo", "pieces")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ready()

    def pretoken(self, text: str) -> bytes:
        token = text.encode()
        slot = self.whole.slot(token)
        return self.slot_ids[slot] if slot >= 0 else self.merge(token)

    def merge(self, token: bytes) -> bytes:
        """Merges the pair of lowest rank, leftmost first, until no adjacent pair is in the vocabulary.

        The heap holds rank and place of pairs; an entry is stale if its place is gone
        or the pair there now has another rank.
        """
        rank_of, n = self.pairs.get, len(token)
        ids = list(map(self.byte_ids.__getitem__, token))
        after, before, bits = list(range(1, n + 1)), list(range(-1, n - 1)), n.bit_length()
        heap = [rank << bits | i for i, pair in enumerate(pairwise(ids)) if (rank := rank_of(pair[0] << 32 | pair[1])) is not None]
        heapify(heap)
        low = (1 << bits) - 1
        while heap:
            entry = heappop(heap)
            left, rank = entry & low, entry >> bits
            right = after[left]
            if ids[left] < 0 or right >= n or rank_of(ids[left] << 32 | ids[right]) != rank:
                continue
            ids[left], ids[right] = rank, -1
            follower = after[left] = after[right]
            if follower < n:
                before[follower] = left
                if (made := rank_of(rank << 32 | ids[follower])) is not None:
                    heappush(heap, made << bits | left)
            leader = before[left]
            if leader >= 0 and (made := rank_of(ids[leader] << 32 | rank)) is not None:
                heappush(heap, made << bits | leader)
        left = [i for i in ids if i >= 0]
        return pack(f"<{len(left)}I", *left)

    def piece(self, piece: str) -> bytes | None:
        """Ids of a space and ``piece``; None if a pre-token could reach beyond either end."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        if piece.isascii() and piece.isalpha():
            return self.memo[" " + piece]
        return b"".join(map(self.memo.__getitem__, self.find(" " + piece)))

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            ids = list(map(self.pieces.__getitem__, rest))
            if None not in ids:
                head = b"".join(map(self.memo.__getitem__, self.find(first)))
                return head + b"".join(ids)
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I") if sys.byteorder == "little" else unpack(f"<{len(ids) // 4}I", ids)))


class _Memo(dict):
    """Remembers what ``make`` gave, in two generations of MEMO entries, so that frequent keys stay; long keys aren't kept."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 to ``docs``; with ``keep_ids`` also ``ids``, array<int>.

    Columns of ``docs`` of those names are replaced.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]
    kinds = ["long", "string", "string", "array<int>"]
    docs = docs.drop(*names)
    rest = [c for c in docs.columns if c != text or keep_ids]

    shared = docs.sparkSession.sparkContext.broadcast(codec(path, pattern))  # its size is the vocabulary's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, ids_hash, back_hash, kept = [], [], [], []
                for value in part.column(text):
                    ids = own.encode(value.as_py() or "")
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    back_hash.append(hashlib.sha256(own.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(np.frombuffer(ids, "<u4").astype("i4"))
                made = [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(back_hash, pa.string())]
                made += [pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []
                yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + made, names=rest + names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest] + [f"{a} {b}" for a, b in zip(names, kinds, strict=False)])
    return docs.mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
