"""Exact dedup through a cuckoo-filter index of live digests.

``CuckooIndex`` keeps a 16-bit fingerprint of each digest in one of two buckets of four slots, and the digest itself
beside it. A fingerprint that matches is only a hit if the stored digest is the same. Inserting into two full buckets
moves an entry to its other bucket; after too many moves the index doubles and is filled again from the stored digests.
Digests can be deleted.

``exact_groups`` uses it twice: in each task over the rows as they come (equal texts of a task become one row, so a hot
text crosses the exchange once per task), and after the exchange by digest. ``change_index`` keeps an index as a table
of live digests and applies insertions and deletions to it, shard by shard.

Texts are equal when identical after deleting ASCII white space; null counts as empty. The row with the most code
points in the original text stays, then the smallest doc_id (null last). Rows repeated under one doc_id count singly
in group_size and are kept or dropped together. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.llm.store import read_table, written

SLOTS = 4
MOVES = 200
#: Digests that a task gathers before it passes on what it has.
GATHERED = 200_000


class CuckooIndex:
    """Set of byte strings (digests, evenly distributed, at least 12 bytes) with a number for each."""

    def __init__(self, buckets: int = 1024):
        self.live = 0
        self._make(buckets)

    def _make(self, buckets: int) -> None:
        self.buckets = buckets  # a power of two
        self.prints: list[list[int]] = [[] for _ in range(buckets)]
        self.content: list[list[tuple[bytes, int]]] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") | 1
        one = int.from_bytes(digest[4:12], "little") & (self.buckets - 1)
        return mark, one, one ^ self._turn(mark)

    def _turn(self, mark: int) -> int:
        return (mark * 0x5BD1E995 >> 3) & (self.buckets - 1)

    def _slot(self, digest: bytes) -> tuple[int, int]:
        """Bucket and slot of a live digest, else (-1, -1)."""
        mark, *places = self._places(digest)
        for b in places:
            if mark in self.prints[b]:
                for s, (kept, _) in enumerate(self.content[b]):
                    if kept == digest:
                        return b, s
        return -1, -1

    def find(self, digest: bytes) -> int | None:
        b, s = self._slot(digest)
        return None if b < 0 else self.content[b][s][1]

    def insert(self, digest: bytes, number: int) -> int:
        """The number the digest has; ``number`` if it was not live before."""
        b, s = self._slot(digest)
        if b >= 0:
            return self.content[b][s][1]
        self.live += 1
        left = self._place(digest, number)
        if left:
            self._grow([left, *self.entries()])
        return number

    def _grow(self, held: list[tuple[bytes, int]]) -> None:
        """Twice the buckets (again, if that isn't enough), filled from the stored digests."""
        size = self.buckets
        while True:
            size *= 2
            self._make(size)
            if all(self._place(*x) is None for x in held):
                return

    def _place(self, digest: bytes, number: int) -> tuple[bytes, int] | None:
        """Puts the entry into a bucket; returns the one left over after too many moves."""
        mark, one, two = self._places(digest)
        b = one if len(self.prints[one]) <= len(self.prints[two]) else two
        entry = (digest, number)
        for turn in range(MOVES):
            if len(self.prints[b]) < SLOTS:
                self.prints[b].append(mark)
                self.content[b].append(entry)
                return None
            s = turn % SLOTS
            self.prints[b][s], mark = mark, self.prints[b][s]
            self.content[b][s], entry = entry, self.content[b][s]
            b ^= self._turn(mark)
        return entry

    def delete(self, digest: bytes) -> int | None:
        """The number of the digest, which is live no more; None if it wasn't."""
        b, s = self._slot(digest)
        if b < 0:
            return None
        self.live -= 1
        self.prints[b].pop(s)
        return self.content[b].pop(s)[1]

    def entries(self) -> Iterator[tuple[bytes, int]]:
        for c in self.content:
            yield from c


GROUP = "digest binary, chars bigint, keep_id bigint, n bigint"
NAMES = ["digest", "chars", "keep_id", "n"]


def _combine(most: int | None):
    """Rows of GROUP combined by digest; with ``most``, what is gathered is passed on at that many digests."""

    def better(a, b):
        return (a[0], a[1] is not None, -(a[1] or 0)) > (b[0], b[1] is not None, -(b[1] or 0))

    def out(digests, best, n):
        for a in range(0, len(n), 20_000):
            b = a + 20_000
            yield pa.RecordBatch.from_arrays([pa.array(digests[a:b], pa.binary()), pa.array([x[0] for x in best[a:b]], pa.int64()), pa.array([x[1] for x in best[a:b]], pa.int64()), pa.array(n[a:b], pa.int64())], NAMES)

    def run(batches):
        index, digests, best, n = CuckooIndex(), [], [], []
        for batch in batches:
            for d, c, i, k in zip(*(batch.column(x).to_pylist() for x in NAMES)):
                at = index.insert(d, len(n))
                if at == len(n):
                    digests.append(d)
                    best.append((c, i))
                    n.append(k)
                else:
                    n[at] += k
                    if better((c, i), best[at]):
                        best[at] = (c, i)
            if most and len(n) >= most:
                yield from out(digests, best, n)
                index, digests, best, n = CuckooIndex(), [], [], []
        yield from out(digests, best, n)

    return run


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text without white space, code points of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(F.translate(text, " \t\n\x0b\x0c\r", ""), 256)).alias("digest"), F.length(text).cast("bigint").alias("chars"))


def exact_groups(rows: DataFrame) -> DataFrame:
    """One row (digest, chars, keep_id, n) for each distinct digest of ``rows`` (doc_id, digest, chars)."""
    one = rows.select("digest", "chars", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("n"))
    return one.mapInArrow(_combine(GATHERED), GROUP).repartition("digest").mapInArrow(_combine(None), GROUP)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of ``docs``."""
    rows = written(digested(docs), "digests")
    groups = written(exact_groups(rows), "groups")
    several = groups.where("n > 1").select("digest", "keep_id", "n")
    out = rows.join(several, "digest", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def change_index(index: DataFrame | None, changes: DataFrame, shards: int = 64) -> DataFrame:
    """The live digests after ``changes`` (digest binary, insert boolean, seq): in the order of seq (ties: insertions
    first) each is inserted, if it isn't live, or deleted, if it is. ``index``: what this function returned before."""
    rows = changes.select("digest", "insert", F.col("seq").cast("bigint").alias("seq"))
    if index is not None:
        rows = rows.unionByName(index.select("digest", F.lit(True).alias("insert"), F.lit(None).cast("bigint").alias("seq")))
    rows = rows.where("digest is not null and insert is not null").withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    rows = rows.repartition("shard").sortWithinPartitions(F.col("seq").asc_nulls_first(), F.col("insert").desc())

    def run(batches):
        live, number = CuckooIndex(), 0
        for batch in batches:
            for d, insert in zip(batch.column("digest").to_pylist(), batch.column("insert").to_pylist()):
                number += 1
                if insert:
                    live.insert(d, number)
                else:
                    live.delete(d)
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in live.entries()], pa.binary())], ["digest"])

    return rows.mapInArrow(run, "digest binary")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))
