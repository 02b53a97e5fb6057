"""Byte-level byte-pair encoding and decoding from a file of ranks.

Each match of the splitting pattern is encoded on its own, in two tiers: a minimal perfect hash tells whether the whole
pre-token is a vocabulary entry; if not, its bytes form a linked list and a heap of (rank, position) merges the
neighbours of lowest rank, leftmost first, until no neighbours form an entry. Pre-tokens seen before are taken from a
bounded memory of the worker.

Null and empty texts have no ids. Text inside angle brackets and the like is ordinary text: there are no special
tokens. Rows are encoded one by one, in the partitions they come in; other columns are kept as they are.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.llm.arrow import slices
from cellscore.llm.store import read_table

RANKS = "byte_bpe_multi_50k.tiktoken"
REMEMBERED, LONGEST_REMEMBERED = 300_000, 48
MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """The entries by id; ids are 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = sorted((int(n), base64.b64decode(t)) for t, n in (line.split() for line in f if line.strip()))
    if [n for n, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ids must run from 0 without gaps")
    return [t for _, t in pairs]


class PerfectHash:
    """As many slots as keys. Keys fall into half as many groups; a group of several keys has a displacement under
    which all of them hit free slots, a single key has its slot itself."""

    def __init__(self, keys: list[bytes]):
        n = self.size = len(keys)
        self.groups = max(1, n // 2)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) != n:
            raise ValueError("keys repeat")
        members: list[list[int]] = [[] for _ in range(self.groups)]
        for i, h in enumerate(hashes):
            members[h % self.groups].append(i)
        self.shift, slots, free = [0] * self.groups, [-1] * n, 0
        for g in sorted(range(self.groups), key=lambda g: -len(members[g])):
            own = members[g]
            if len(own) > 1:
                d = 1
                while True:
                    at = [self._slot(hashes[i], d) for i in own]
                    if len(set(at)) == len(at) and all(slots[a] < 0 for a in at):
                        break
                    d += 1
                self.shift[g] = d
                for a, i in zip(at, own):
                    slots[a] = i
            elif own:
                while slots[free] >= 0:
                    free += 1
                slots[free], self.shift[g] = own[0], -free - 1
        self.slots, self.keys = slots, keys

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & MASK
        return (((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & MASK) >> 17) % self.size

    def get(self, key: bytes) -> int:
        """The key's number, or -1."""
        if not self.size:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.groups]
        i = self.slots[-d - 1 if d < 0 else self._slot(h, d)]
        return i if self.keys[i] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token that is no entry itself. A part is known by where it begins and ends where the next
    begins; rank[i] is that of the part at i joined with the next, -1 if there is none."""
    n = len(piece)
    get = ranks.get
    after, before = list(range(1, n + 2)), list(range(-1, n))
    rank = [get(piece[i : i + 2], -1) for i in range(n - 1)]
    rank += (-1, -1)
    bits = n.bit_length()
    low = (1 << bits) - 1
    heap = [r << bits | i for i, r in enumerate(rank) if r >= 0]
    heapify(heap)
    while heap:
        x = heappop(heap)
        i = x & low
        if rank[i] != x >> bits:
            continue
        j = after[i]
        k = after[i] = after[j]
        rank[j] = -1
        before[k] = i
        if k < n:
            rank[i] = r = get(piece[i : after[k]], -1)
            if r >= 0:
                heappush(heap, r << bits | i)
        else:
            rank[i] = -1
        b = before[i]
        if b >= 0:
            rank[b] = r = get(piece[b:k], -1)
            if r >= 0:
                heappush(heap, r << bits | b)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """pre-token -> its ids as little-endian 32-bit integers; looks up or merges what it doesn't remember.

    At ``REMEMBERED`` pre-tokens these become the older ones, and of the older ones before only those asked for since stay.
    """

    def __init__(self, tokens: list[bytes], whole: PerfectHash, pattern: str):
        self.tokens, self.whole, self.split = tokens, whole, regex.compile(pattern).findall
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "surrogatepass")
            i = self.whole.get(raw)
            ids = i.to_bytes(4, "little") if i >= 0 else struct.pack(f"<{len(m := merge(raw, self.ranks))}I", *m)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(1)  # a worker outlives the queries it serves
def _encoder(key: str, shared) -> Encoder:
    return Encoder(*shared.value)


class _Shared:
    """A broadcast that workers know by its number, so that they build one encoder however many tasks they run."""

    def __init__(self, broadcast):
        self.broadcast, self.key = broadcast, f"{broadcast._jbroadcast.id()}"

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key

    def __reduce__(self):
        return (_rebuilt, (self.broadcast, self.key))

    @property
    def value(self):
        return self.broadcast.value


def _rebuilt(broadcast, key):
    x = _Shared.__new__(_Shared)
    x.broadcast, x.key = broadcast, key
    return x


def _shared(spark: SparkSession, path: str, pattern: str) -> _Shared:
    tokens = read_ranks(path)
    return _Shared(spark.sparkContext.broadcast((tokens, PerfectHash(tokens), pattern)))


def encode(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, column: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the column ``ids``: the ids of ``column`` as little-endian unsigned 32-bit integers (binary)."""
    shared = _shared(df.sparkSession, path, pattern)

    def run(batches):
        encoder = _encoder(shared.key, shared)
        for batch in slices(batches, column):
            out = pa.array([encoder.encode(t) for t in batch.column(column).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, ids])

    df = df.drop(ids)
    return df.mapInArrow(run, df.withColumn(ids, F.lit(b"")).schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the column ``decoded``: the bytes (binary) of ``ids``."""
    shared = _shared(df.sparkSession, path, public_tokenizers.PATTERN)

    def run(batches):
        encoder = _encoder(shared.key, shared)
        for batch in slices(batches, ids):
            out = pa.array([encoder.decode(x or b"") for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, decoded])

    df = df.drop(decoded)
    return df.mapInArrow(run, df.withColumn(decoded, F.lit(b"")).schema)


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of each text's ids and of the bytes they decode to. As ``encode`` and
    ``decode``, in one pass, so that neither ids nor texts leave the worker."""
    shared = _shared(docs.sparkSession, path, pattern)

    def run(batches):
        encoder = _encoder(shared.key, shared)
        for batch in slices(batches):
            n, ids_sha, text_sha = [], [], []
            for t in batch.column("text").to_pylist():
                ids = encoder.encode(t)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
