"""Mixing sources to target weights, by balanced sampling with the cube method.

Sources share ``share`` times the words of all documents by weight; a source's target stops at ``most`` times its words, and
what is over goes to the others by weight, until none is above. A document of a source with rate r = target / words
is taken floor(r) times and once more with probability r - floor(r). These probabilities are a point of a cube, and are
moved to a corner: of three documents with open probabilities a step goes along the vector that changes
neither the expected number of documents nor of words (the null space of the two balancing equations), in one of both directions by
a draw that keeps each probability's expectation, until one of them is 0 or 1 and the next document takes its place.

The flight runs in groups of about ``GROUP`` documents of a source, by a hash of doc_id and text. Rows come longest first; the
``HELD`` longest are not moved, and at most two others are open at a time. What a group leaves open goes, for ``FAN`` groups
together, to a group of the next level, up to one group for each source. Its last documents (at most ``HELD`` + 2) are the landing problem: of
all their corners the one with the least difference in words (and, as one word each, in documents) is taken. So a
source's words differ from its target by the landing alone, and the longest documents are there to balance each other. Results depend
on the rows only, not on how they are spread over tasks.

Null and empty texts have no words, and are taken like others; a source without words has target 0. The null source comes last. Rows of
one doc_id are documents of their own; equal rows are interchangeable. Without rows the result is empty. Only doc_id, text and source are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.functions.common import bucketed_rank
from cellscore.llm.store import read_table, written

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
GROUP, HELD, FAN = 1024, 12, 64
NEAR = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and h (a hash by which groups are formed, ties ordered and directions drawn)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("h"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, n (documents), source_size, target. Only sums over all sources come to the driver."""
    each = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = written(each.repartitionByRange(*order).select("*", F.spark_partition_id().alias("range")), "sources")
    ranked = bucketed_rank(ranged, [], F.col("range"), order, "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    rows = written(ranked.select("source", "n", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "weights")
    total, left = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(float(share)), F.sum("weight")).first()
    per, before = total / left if left else 0.0, -1.0
    while per != before:
        above = F.col("weight") * F.lit(per) > F.col("cap")
        full, left = rows.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        per, before = (max(per, (total - full) / left) if left else per), per
    return rows.select("source", "n", "source_size", F.least("cap", F.col("weight") * F.lit(per)).alias("target"))


def draw(h: int, salt: int) -> float:
    """A number from 0 to 1, the same for the same document."""
    x = (h ^ salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return ((x ^ x >> 31) >> 11) / (1 << 53)


def step(p: list[float], s: list[int], u01: float) -> list[float]:
    """The probabilities of three documents of s words after a step; at least one becomes 0 or 1."""
    u = (s[1] - s[2], s[2] - s[0], s[0] - s[1])
    if not any(u):
        u = (1, -1, 0)
    ahead = min((1 - x) / d if d > 0 else x / -d for x, d in zip(p, u) if d)
    back = min(x / d if d > 0 else (1 - x) / -d for x, d in zip(p, u) if d)
    by = ahead if u01 * (ahead + back) < back else -back
    return [0.0 if (y := x + by * d) < NEAR else 1.0 if y > 1 - NEAR else y for x, d in zip(p, u)]


def land(p: list[float], s: list[int]) -> list[float]:
    """The corner with the least difference in words and documents; the first one of equals."""
    corners = np.array(list(itertools.product((0.0, 1.0), repeat=len(p))))
    d = corners - np.array(p)
    return corners[int(np.argmin(np.abs(d @ np.array(s, float)) + np.abs(d.sum(axis=1))))].tolist()


class Flight:
    """The documents of a group, one after another; ``out`` gets (row, probability) when a document is through."""

    def __init__(self, salt: int, last: bool):
        self.salt, self.last, self.out = salt, last, []
        self.held: list = []
        self.open: list = []

    def add(self, row: tuple, p: float, size: int, h: int) -> None:
        if len(self.held) < HELD:
            self.held.append((row, p, size))
            return
        self.open.append((row, p, size))
        if len(self.open) == 3:
            moved = step([x[1] for x in self.open], [x[2] for x in self.open], draw(h, self.salt))
            now = [(row, q, n) for (row, _, n), q in zip(self.open, moved)]
            self.out += [(row, q) for row, q, _ in now if q in (0.0, 1.0)]
            self.open = [x for x in now if x[1] not in (0.0, 1.0)]

    def end(self) -> None:
        """Lands, or leaves what is open to the next level."""
        left = self.held + self.open
        ends = land([x[1] for x in left], [x[2] for x in left]) if self.last else [x[1] for x in left]
        self.out += [(row, p) for (row, _, _), p in zip(left, ends)]
        self.held, self.open = [], []


PLAN = "doc_id bigint, source string, size bigint, h bigint, source_size bigint, target double, base bigint, bucket bigint, buckets bigint, p double"


def fly(rows: DataFrame, level: int) -> DataFrame:
    """One level for all groups (source, bucket). Groups of a source's last level land."""

    def run(batches):
        flight, key = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in batch.schema.names]
            for row in zip(*columns):
                doc_id, source, size, h, _, _, _, bucket, buckets, p = row
                if key != (source, bucket):
                    if flight:
                        flight.end()
                        yield from table(flight)
                    flight, key = Flight(level, buckets == 1), (source, bucket)
                flight.add(row, p, size, h)
            if flight and len(flight.out) > 10_000:
                yield from table(flight)
        if flight:
            flight.end()
            yield from table(flight)

    def table(flight):
        out, flight.out = flight.out, []
        columns = list(zip(*(row[:-1] + (p,) for row, p in out)))
        if columns:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], PLAN.replace(",", "").split()[::2])

    dealt = rows.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.col("size").desc(), "h", "doc_id")
    return dealt.mapInArrow(run, PLAN)


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the document is taken) and taken (its words in the mix)."""
    sizes = written(measured(docs), "sizes")
    goals = written(targets(sizes, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    buckets = F.ceil(F.col("n") / GROUP)
    each = goals.select(F.col("source").alias("_s"), "source_size", "target", F.floor(rate).alias("base"), (rate - F.floor(rate)).alias("p"), buckets.alias("buckets"))
    rows = sizes.join(each, F.col("source").eqNullSafe(F.col("_s"))).withColumn("bucket", F.pmod(F.xxhash64("h"), F.col("buckets")))
    rows = rows.select(PLAN.replace(",", "").split()[::2])
    whole = (F.col("p") < NEAR) | (F.col("p") > 1 - NEAR)
    done, level = rows.where(whole).withColumn("p", F.round("p")), 0
    open_ = rows.where(~whole)
    left = goals.agg(F.max(buckets)).first()[0] or 1
    while True:
        flown = written(fly(open_, level), "flight")
        settled = (F.col("p") == 0) | (F.col("p") == 1)
        done = done.unionByName(flown.where(settled))
        if left == 1:
            break
        open_ = flown.where(~settled).withColumn("bucket", F.floor(F.col("bucket") / FAN)).withColumn("buckets", F.ceil(F.col("buckets") / FAN))
        left, level = -(-left // FAN), level + 1
    copies = F.col("base") + F.col("p").cast("bigint")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken (its columns as they are). doc_ids must be unique and not null."""
    taken = plan.where("copies > 0").select(F.col("doc_id").alias("_d"), F.explode(F.sequence(F.lit(1), "copies")).alias("_copy"))
    return docs.join(taken.hint("merge"), F.col("doc_id") == F.col("_d")).select(docs.columns)


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
