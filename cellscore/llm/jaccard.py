"""N-gram Jaccard join: prefix filtering with rare n-grams first.

Documents whose sets of word n-grams have a Jaccard similarity of at least ``percent`` / 100 are linked, and the links
give components.

* **Order.** All n-grams have one global order: how often their hash bucket (a fixed number of counters, summed over
  the whole corpus) occurs, as a rounded logarithm, then the hash. Any order gives the same links; this one puts rare
  n-grams first. The table of orders has one byte for each bucket, whatever the corpus, and is all that is broadcast.
* **Classes.** Documents with equal sets form a class; from here on a class is one row, however many copies it has.
* **Prefix.** Two sets of the wanted similarity share an n-gram among the first n - ceil(t n) + 1 of both. Only these
  are exchanged.
* **Candidates without groups squared.** Round 1 pairs each class with the smallest class that shares a prefix n-gram
  with it. Verified pairs are links, links give components. Round 2 pairs, for each n-gram that several components share,
  its classes with one drawn by a hash, another for each n-gram. Round 3 pairs, for each n-gram, all classes of different
  components that can be similar; so no link between components is missed, and a large group of near copies, joined in
  the rounds before, is not paired within itself. The smaller set of a pair has its first common n-gram among its first
  n - ceil(2 t n / (1 + t)) + 1, so only those are looked up, and only in sets of the same or the next band of sizes.
* **Filters.** Length (the smaller set has at least t of the larger), position (what is left behind the first common
  prefix n-gram must suffice), suffix (each set has a bit for each value of some bits of the hashes, the parity of how many of its
  n-grams have it; two sets differ in at least as many n-grams as they differ in bits, which bounds the overlap).
* **Verification.** Each pair once, by intersecting the whole sets.

Null and empty texts have no n-grams: size 0, linked with nothing. Fewer than n words count as one n-gram. Rows with
the same doc_id count as one document; rows without doc_id keep their size and have no component. Other columns are
not read. N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.llm.arrow import SPACE, Words, mix, sequence_hash, slices, summed
from cellscore.llm.store import discarded, read_table, written

BUCKETS = 1 << 20
#: Bits of the sketches: a power of two for each set, its size or more, within these.
LEAST_BITS, MOST_BITS = 64, 1 << 13


def document_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words = Words(texts, SPACE)
    grams, _ = words.shingles(n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            yield g[np.concatenate(([True], g[1:] != g[:-1]))]
        elif b > a:
            yield np.array([sequence_hash(words.hash[a:b])], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)


def bucket_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(20)) & np.uint64(BUCKETS - 1)


def gram_order(docs: DataFrame, n: int) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole corpus: 8 log2(count), at most 255."""

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        grams, whole = Words(batch.column("text"), SPACE).shingles(n)
        np.add.at(total, bucket_of(grams[whole]), 1)

    total = summed(docs.select("text"), BUCKETS, count)
    return np.minimum(8 * np.log2(np.maximum(total, 1)), 255).astype(np.uint8)


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of how many n-grams have each value of their lower bits, as words of 64."""
    bits = min(max(LEAST_BITS, 1 << max(len(grams) - 1, 0).bit_length()), MOST_BITS)
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def signatures(docs: DataFrame, order: np.ndarray, n: int, percent: int) -> DataFrame:
    """doc_id, size, two hashes of the whole set, its prefix in the global order and its sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    bands = size_bands(percent)

    def sign(batches):
        rank = shared.value
        for batch in slices(batches):
            sizes, one, two, lengths, prefixes, sketches = [], [], [], [], [], []
            for g in document_sets(batch.column("text"), n):
                size = len(g)
                keep = size - (percent * size + 99) // 100 + 1 if size else 0
                first = g[np.argsort(rank[bucket_of(g)], kind="stable")[:keep]]
                m = mix(g)
                sizes.append(size)
                one.append(int(np.sum(m)))
                two.append(int(np.bitwise_xor.reduce(mix(m + np.uint64(1)))) if size else 0)
                lengths.append(keep)
                prefixes.append(first)
                sketches.append(sketch(g))
            tokens = np.concatenate(prefixes).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.searchsorted(bands, sizes, "right").astype(np.int32)),
                    pa.array(np.array(one, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(two, dtype=np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(tokens)),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sketches)]).astype(np.int32)), pa.array(np.concatenate(sketches))),
                ],
                ["doc_id", "size", "band", "s1", "s2", "prefix", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id bigint, size bigint, band int, s1 bigint, s2 bigint, prefix array<bigint>, sketch array<bigint>")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(id, grams) for the classes in ``wanted`` (id) and few others: the texts are read once more, and a table of hashed
    ids of fixed size lets most other documents go at once."""
    bits = np.zeros(BUCKETS, dtype=bool)
    at = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")
    bits[wanted.select(at.alias("b")).distinct().toArrow()["b"].to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def build(batches):
        hit = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(hit[batch.column("b").to_numpy(zero_copy_only=False)]))
            for part in slices([batch]):
                grams = list(document_sets(part.column("text"), n))
                ends = np.cumsum([len(g) for g in grams])
                flat = pa.array(np.concatenate(grams).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), flat)], ["id", "grams"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), "text").withColumn("b", at)
    return texts.mapInArrow(build, "id bigint, grams array<bigint>")


def first_places(size, percent: int):
    """How many n-grams of a set can be the first in common with a similar set that isn't smaller."""
    return size - F.ceil(2 * percent * size / (100 + percent)) + 1


def size_bands(percent: int, largest: int = 1 << 40) -> np.ndarray:
    """Smallest sizes of bands such that similar sets are in one band or in neighbouring ones."""
    out = [1]
    while out[-1] < largest:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, dtype=np.int64)


def enough(shared, a, b, percent: int):
    """100 shared >= percent (a + b - shared)."""
    return (100 + percent) * shared >= percent * (a + b)


def marked(grams: DataFrame) -> np.ndarray:
    """2^24 bits, by the upper bits of each of ``grams`` (gram), as words of 64."""
    bit = F.shiftrightunsigned("gram", 40)
    rows = grams.select(F.shiftright(bit, 6).alias("k"), F.expr("shiftleft(1L, cast(shiftrightunsigned(gram, 40) & 63 as int))").alias("w"))
    rows = rows.groupBy("k").agg(F.bit_or("w").alias("w")).toArrow()  # at most 2^18 rows
    words = np.zeros(1 << 18, dtype=np.uint64)
    words[rows["k"].to_numpy()] = rows["w"].to_numpy().view(np.uint64)
    return words


def shared_postings(reps: DataFrame, common: DataFrame) -> DataFrame:
    """id, size, band, at, gram, lead: the postings of the grams in ``common`` (gram, lead). Most others are dropped
    before the exchange by a table of fixed size; the join does the rest."""
    shared = reps.sparkSession.sparkContext.broadcast(marked(common))

    def keep(batches):
        words = shared.value
        for batch in batches:
            lists = batch.column("prefix")
            grams = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            begin = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            hit = np.flatnonzero((words[grams >> np.uint64(46)] >> ((grams >> np.uint64(40)) & np.uint64(63))) & np.uint64(1))
            row = np.searchsorted(begin, hit, "right") - 1
            own = batch.select(["id", "size", "band"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(hit - begin[row], pa.int64()), pa.array(grams[hit].view(np.int64))], ["id", "size", "band", "at", "gram"])

    found = reps.select("id", "size", "band", "prefix").mapInArrow(keep, "id bigint, size bigint, band int, at bigint, gram bigint")
    return found.hint("merge").join(common, "gram")


def between_components(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """``postings`` with comp, of the grams that several components share."""
    placed = postings.drop("comp").hint("merge").join(roots, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
    mixed = placed.groupBy("gram").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("gram")
    return written(placed.hint("merge").join(mixed, "gram", "left_semi"), "placed")


def suffix_bound(a, b, na, nb):
    """The most n-grams that sets of na and nb n-grams with these sketches can share. A longer sketch is folded first."""

    def folded(x, other):
        half = (F.size(x) / 2).cast("int")
        once = F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(other), once).otherwise(x)

    differing = F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.floor((na + nb - F.when(F.greatest(F.size(a), F.size(b)) > 2 * F.least(F.size(a), F.size(b)), 0).otherwise(differing)) / 2)


def verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Only texts in ``pairs`` are exchanged."""
    pairs = written(pairs, "pairs")
    sets = written(sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), n), "sets")
    b = pairs.hint("merge").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")  # no side is small
    both = b.hint("merge").join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
    common = F.size(F.array_intersect("ga", "gb"))
    links = written(both.where(enough(common, F.size("ga"), F.size("gb"), percent)).select("a", "b").distinct(), "links")
    discarded(pairs, sets)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of ``edges`` (a, b) that isn't the smallest of its component.

    Alternates large and small stars; each round is written to the shared folder. It ends when no root is itself a
    child and every child has one root.
    """
    pairs = written(edges.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("root")).where("id <> root").distinct(), "stars")
    while True:
        both = pairs.unionByName(pairs.select(F.col("root").alias("id"), F.col("id").alias("root")))
        low = both.groupBy("id").agg(F.least(F.min("root"), F.col("id")).alias("low"))
        large = both.join(low, "id").where("root > id").select(F.col("root").alias("id"), F.col("low").alias("root")).where("id <> root").distinct()
        low = large.groupBy("id").agg(F.min("root").alias("low"))
        joined = large.join(low, "id")
        small = joined.where("root <> low").select(F.col("root").alias("id"), F.col("low").alias("root")).unionByName(low.withColumnRenamed("low", "root"))
        before, pairs = pairs, written(small.distinct(), "stars")
        discarded(before)
        loose = pairs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
        chained = pairs.select(F.col("root").alias("id")).distinct().join(pairs.select("id"), "id", "left_semi")
        if loose.unionByName(chained).isEmpty():
            return pairs


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text)."""
    signed = written(signatures(docs, gram_order(docs, n), n, percent), "signed")
    keys = written(signed.select("doc_id", "size", "s1", "s2"), "keys")
    classes = keys.where("size > 0 and doc_id is not null").groupBy("s1", "s2", "size").agg(F.min("doc_id").alias("id"))
    first_of = written(classes, "first")
    reps = signed.join(first_of.select("s1", "s2", F.col("id").alias("doc_id")), ["s1", "s2", "doc_id"], "left_semi")
    reps = written(reps.select(F.col("doc_id").alias("id"), "size", "band", "prefix", "sketch"), "classes")
    discarded(signed)

    grams = reps.select("id", F.explode("prefix").alias("gram"))
    common = written(grams.groupBy("gram").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("gram", "lead"), "common")
    postings = written(shared_postings(reps, common), "postings")
    sketched = written(reps.select("id", "size", "sketch"), "sketches")
    discarded(common, reps)

    def sized(pairs: DataFrame) -> DataFrame:
        """Length and suffix filters."""
        for side in "ab":
            pairs = pairs.hint("merge").join(sketched.select(F.col("id").alias(side), F.col("size").alias(f"n{side}"), F.col("sketch").alias(f"p{side}")), side)
        na, nb = F.col("na"), F.col("nb")
        fits = (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & enough(suffix_bound(F.col("pa"), F.col("pb"), na, nb), na, nb, percent)
        return pairs.where(fits).select("a", "b")

    first = verified(docs, sized(postings.where("lead <> id").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()), n, percent)
    roots = components(first)

    placed = between_components(postings, roots)
    discarded(postings)
    draw = F.xxhash64("id", "gram")
    other = placed.groupBy("gram").agg(F.min_by("id", draw).alias("a"), F.min_by("comp", draw).alias("ca"))
    again = placed.join(other, "gram").where("comp <> ca").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    links = first.unionByName(verified(docs, sized(again), n, percent))

    before, placed = placed, between_components(placed, components(links))
    discarded(before)
    small = placed.where(F.col("at") < first_places(F.col("size"), percent)).select("gram", "band", F.col("comp").alias("ca"), F.col("id").alias("a"), F.col("size").alias("na"), F.col("at").alias("ia"))
    large = placed.select("gram", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("comp").alias("cb"), F.col("id").alias("b"), F.col("size").alias("nb"), F.col("at").alias("ib"))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    behind = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))  # in both from the first common n-gram on
    fits = ordered & (F.col("ca") != F.col("cb")) & (100 * F.col("na") >= percent * F.col("nb")) & enough(behind, F.col("na"), F.col("nb"), percent)
    key = [small["gram"] == large["gram"], small["band"] == large["band"]]
    cross = small.join(large, [*key, fits]).select("a", "b").distinct()
    third = verified(docs, sized(cross), n, percent)
    roots = components(links.unionByName(third))

    member = written(first_of.join(roots, "id", "left").select("s1", "s2", "size", F.coalesce("root", "id").alias("component_id")), "members")
    discarded(sketched, placed)
    out = keys.join(member, ["s1", "s2", "size"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
