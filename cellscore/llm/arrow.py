"""Words and word shingles of Arrow string columns as numpy arrays.

A column is one run of UTF-8 bytes; all separators used here are ASCII, so words are found on bytes, for every row of
a slice at once. Hashes are 64 bits wide: rows of ``TABLE`` weighted by powers of an odd base, then mixed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BASE = np.uint64(0x9E3779B97F4A7C13)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
TABLE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that separate words: ASCII white space, or (letters being lower case) all ASCII but digits and a to z.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) <= n:
        size = 1 << n.bit_length()
        for name, base in (("_powers", BASE), ("_inverses", INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            globals()[name] = np.multiply.accumulate(p)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``limit`` bytes of ``column`` (a longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and where each begins, with the end."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def summed(df: DataFrame, size: int, count: Callable[[pa.RecordBatch, np.ndarray], None], chunk: int = 1 << 12) -> np.ndarray:
    """``size`` counters over all rows of ``df``: each task lets ``count`` add its slices to a vector of its own, and
    the vectors are summed in chunks. Only the sums come to the driver."""

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in slices(batches):
            count(batch, total)
        for k in range(0, size, chunk):
            if total[k : k + chunk].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + chunk]], pa.list_(pa.int64()))], ["k", "counts"])

    spread = df.mapInArrow(run, "k int, counts array<bigint>").repartition("k").select("k", F.posexplode("counts").alias("at", "n"))
    rows = spread.groupBy("k", "at").agg(F.sum("n").alias("n")).where("n > 0").select((F.col("k") + F.col("at")).alias("at"), "n").toArrow()
    total = np.zeros(size, dtype=np.int64)
    total[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return total


class Words:
    """All words of a column of texts, A-Z lower-cased (or as ``fold`` maps bytes).

    ``hash``: of each word; ``first``: index of each text's first word, with the end; ``start``, ``end``: bytes.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray, fold: np.ndarray = LOWER):
        data, off = flat(texts)
        n = len(data)
        low = fold[data]
        inside = ~separators[low]
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        if n:
            before[0] = after[-1] = False
        edge = off[1:-1]
        before[edge[edge < n]] = False
        after[edge[(edge > 0)] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        _grow(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(TABLE[low] * _powers[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _inverses[self.start])
        self.first = np.searchsorted(self.start, off)
        self.data, self.off = data, off

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each position, and whether they lie in one text."""
        h, n = self.hash, len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.full(n - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = out * BASE + h[i : n - k + 1 + i]
        whole = np.ones(n - k + 1, dtype=bool)
        for f in self.first[1:-1]:
            whole[max(0, f - k + 1) : f] = False
        return mix(out), whole


def sequence_hash(words: np.ndarray) -> int:
    """As ``Words.shingles`` for one run of words."""
    out = np.full(1, len(words), dtype=np.uint64)
    for w in words:
        out = out * BASE + w
    return int(mix(out)[0])
