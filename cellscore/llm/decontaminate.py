"""Benchmark decontamination: a prefix-filtered join of document words with the windows of benchmark items.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. A document
word inside any occurrence of a window is hit.

A window that occurs whole in a document has all its shingles (``SHINGLE`` consecutive words) there, so a prefix of
one shingle is necessary and enough: the rarest, as counted over all documents. Neighbouring windows mostly share it.
The documents' shingles are looked up in the table of these anchors; an occurrence gives an alignment, kept if both the
item and the document reach far enough around it (length and position), and verified by comparing the words around it
one by one over the length of a window.

Items are taken in blocks of about ``block_chars`` characters, which bounds what is sent to the executors; two passes
over the documents, counting and finding, are made for each block. Null texts have no words; null item_ids are left
out; rows of one item_id count as one item; repeated document rows each get their row. Words are compared by 64-bit
hashes. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.llm.arrow import SYMBOLS, Words, slices
from cellscore.llm.store import read_table, written

SHINGLE = 4
WINDOW = 13
BLOCK_CHARS = 8_000_000
BITS = 20


def filter_bits(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << BITS, dtype=bool)
    bits[hashes >> np.uint64(64 - BITS)] = True
    return bits


@dataclass
class Items:
    """Words of all items of a block, and of each shingle of each window its hash, item and place."""

    ids: list[str]
    words: np.ndarray
    first: np.ndarray
    window: int

    def __post_init__(self):
        self.size = np.diff(self.first)
        self.span = np.minimum(self.size, self.window)  # words of a window of each item
        self.width = np.minimum(self.size, SHINGLE)

    def shingles(self, words: Words) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """width -> hashes and word positions, for the widths that occur."""
        out = {}
        for q in sorted({*self.width.tolist()} - {0}):
            grams, whole = words.shingles(q)
            item = np.searchsorted(self.first, np.arange(len(grams)), "right") - 1
            at = np.flatnonzero(whole & (self.width[item] == q))
            out[q] = grams[at], at
        return out


def positions(words: Words, q: int, wanted: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where shingles of ``wanted`` (sorted) begin in the texts, and their index there."""
    grams, whole = words.shingles(q)
    at = np.flatnonzero(bits[grams >> np.uint64(64 - BITS)] & whole)
    found = np.searchsorted(wanted, grams[at])
    same = wanted[np.minimum(found, len(wanted) - 1)] == grams[at]
    return at[same], found[same]


def count_shingles(docs: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """Rows of two kinds: (doc_id, key, n) with the words of each document, (width, gram, n) with the occurrences of
    each wanted shingle in one task's documents."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    names = ["doc_id", "key", "width", "gram", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def count(batches):
        wanted = shared.value
        bits = {q: filter_bits(g) for q, g in wanted.items()}
        total = {q: np.zeros(len(g), dtype=np.int64) for q, g in wanted.items()}
        for batch in slices(batches):
            words = Words(batch.column("text"), SYMBOLS)
            for q, g in wanted.items():
                total[q] += np.bincount(positions(words, q, g, bits[q])[1], minlength=len(g))
            none = [pa.nulls(batch.num_rows, k) for k in kinds[2:4]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("key"), *none, pa.array(words.counts(), pa.int64())], names)
        for q, g in wanted.items():
            at = np.flatnonzero(total[q])
            none = [pa.nulls(len(at), k) for k in kinds[:2]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(np.full(len(at), q), pa.int32()), pa.array(g[at].view(np.int64)), pa.array(total[q][at])], names)

    return docs.mapInArrow(count, "doc_id bigint, key bigint, width int, gram bigint, n bigint")


def anchors(items: Items, grams: dict[int, tuple[np.ndarray, np.ndarray]], counts: dict[int, dict[int, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """width -> sorted hashes, with the range of places of each in a list of word positions: the rarest shingle of
    each window (ties: the smallest hash)."""
    out = {}
    for q, (hashes, at) in grams.items():
        seen = np.array([counts[q].get(h, 0) for h in hashes.view(np.int64).tolist()], dtype=np.int64)
        order = np.lexsort((hashes, seen))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        by_place = dict(zip(at.tolist(), rank.tolist()))
        chosen = set()
        for i in np.flatnonzero(items.width == q).tolist():
            a, m = int(items.first[i]), int(items.span[i])
            for s in range(a, a + int(items.size[i]) - m + 1):
                chosen.add(min(range(s, s + m - q + 1), key=by_place.__getitem__))
        place = np.array(sorted(chosen), dtype=np.int64)
        h = hashes[np.searchsorted(at, place)]
        by = np.argsort(h, kind="stable")
        keys, begin = np.unique(h[by], return_index=True)
        out[q] = keys, np.append(begin, len(by)), place[by]
    return out


def find(docs: DataFrame, items: Items, table: dict) -> DataFrame:
    """(doc_id, key, items, spans) of the documents with hits; spans are [start, end) in words and don't overlap."""
    shared = docs.sparkSession.sparkContext.broadcast((items, table))
    reach = items.window - 1

    def aligned(words: Words, q: int, entry: tuple, bits: np.ndarray, items: Items):
        """Text, item and the run of equal words, for every alignment that covers a window."""
        keys, begin, places = entry
        at, which = positions(words, q, keys, bits)
        times = begin[which + 1] - begin[which]
        at = np.repeat(at, times)
        p = places[np.repeat(begin[which], times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)]
        doc, item = np.searchsorted(words.first, at, "right") - 1, np.searchsorted(items.first, p, "right") - 1
        left = np.minimum(np.minimum(at - words.first[doc], p - items.first[item]), reach)
        right = np.minimum(np.minimum(words.first[doc + 1] - at, items.first[item + 1] - p), reach + 1)
        far = left + right >= items.span[item]
        at, p, doc, item, left, right = (x[far] for x in (at, p, doc, item, left, right))

        def run(room, step, offset):
            length, going = np.zeros(len(at), dtype=np.int64), np.ones(len(at), dtype=bool)
            for o in range(int(room.max(initial=0))):
                going &= o < room
                k = np.flatnonzero(going)
                going[k] = words.hash[at[k] + offset + step * o] == items.words[p[k] + offset + step * o]
                length += going
            return length

        r, left = run(right, 1, 0), run(left, -1, -1)
        whole = left + r >= items.span[item]
        return doc[whole], item[whole], (at - left)[whole], (at + r)[whole]

    def search(batches):
        items, table = shared.value
        bits = {q: filter_bits(e[0]) for q, e in table.items()}
        for batch in slices(batches):
            words = Words(batch.column("text"), SYMBOLS)
            got = [aligned(words, q, e, bits[q], items) for q, e in table.items()]
            doc, item, start, end = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 4
            order = np.lexsort((start, doc))
            doc, item, start, end = doc[order], item[order], start[order], end[order]
            rows, names, spans = [], [], []
            for d in np.unique(doc).tolist():
                a, b = np.searchsorted(doc, [d, d + 1])
                merged: list[list[int]] = []
                base = int(words.first[d])
                for s, e in zip((start[a:b] - base).tolist(), (end[a:b] - base).tolist()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                rows.append(d)
                names.append(sorted({items.ids[i] for i in item[a:b].tolist()}))
                spans.append([{"s": s, "e": e} for s, e in merged])
            if rows:
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("key"), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))],
                    ["doc_id", "key", "items", "spans"],
                )

    return docs.mapInArrow(search, "doc_id bigint, key bigint, items array<string>, spans array<struct<s: bigint, e: bigint>>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, items (ids as strings, sorted), spans (hit words, [s, e)) of each row of ``docs``."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    counted, hits = None, None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").toArrow()
        words = Words(rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string()), SYMBOLS)
        own = Items(rows["item_id"].to_pylist(), words.hash, words.first, window)
        grams = own.shingles(words)
        pass_1 = written(count_shingles(docs, {q: np.unique(h) for q, (h, _) in grams.items()}), "counts")
        counted = counted if counted is not None else pass_1.where("gram is null").select("doc_id", "key", F.col("n").alias("n_words"))
        counts: dict[int, dict[int, int]] = {q: {} for q in grams}
        for q, g, n in zip(*pass_1.where("gram is not null").groupBy("width", "gram").agg(F.sum("n").alias("n")).toArrow().to_pydict().values()):
            counts[q][g] = n
        found = written(find(docs, own, anchors(own, grams, counts)), "hits")
        hits = found if hits is None else hits.unionByName(found)
    one = hits.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"))
    out = counted.alias("d").join(one.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.key") == F.col("h.key")), "left")
    return out.select("d.doc_id", "d.key", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<s: bigint, e: bigint>>")).alias("spans"))


def hit_words():
    """Words inside the sorted ``spans``, which may overlap where several blocks of items were taken."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(acc, x):
        return F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["end"], x["s"]))).alias("n"))

    return F.aggregate("spans", start, step, lambda acc: acc["n"])


def contaminated():
    """The rule: any word is hit, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).withColumn("n_hit", hit_words())
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), contaminated().alias("contaminated"))
