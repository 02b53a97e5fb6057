"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers encode each text with a space before it. Where a token of either side ends at the same byte, both
sequences are cut; what lies between two cuts is a group. Shared cuts are found by divide and conquer: near the middle of
an interval's A ends one is looked for that bisecting the B ends finds too; it halves the interval, and both halves go on;
an interval without any is a leaf, one group. All intervals of a slice of texts take a step at the same time, and the
search moves out from the middle in windows that double.

A and B tokens that end together are a link (as no token is empty, there is one at each cut). Pairs of ids are counted over
the corpus, and each document's links are judged by these counts: ``BLOCK_PAIRS`` counts are broadcast at a time, and there are
no more pairs than A ids times B ids, however large the corpus.

Null and empty texts, and texts whose tokens do not give back their bytes on either side, have no tokens. Texts are encoded in
parts, cut before single spaces, where neither side has a token across, and a worker remembers parts; alignment goes over the
whole texts. Every row is aligned on its own (repeated rows count repeatedly); columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.llm.arrow import slices
from cellscore.llm.bpe import _Shared
from cellscore.llm.store import discarded, read_table, written

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
REMEMBERED, HELD_IDS, TOGETHER = 700_000, 10_000_000, 2000
SLICE = 1 << 20
BLOCK_PAIRS = 1 << 21
HELD_PAIRS = 1 << 22
PAIR_BITS = 31
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: A space at either end or beside other white space.
WIDE_SPACE = re.compile(r"\s |\A | (?:\s|\Z)")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_characters() -> dict[str, int]:
    """Byte-level BPE writes each byte as one character: visible Latin-1 ones as they are, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """The bytes of a tokenizer's tokens: ``size`` and ``at`` of each id in ``flat``."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        begin = np.cumsum(n) - n
        return self.flat[np.repeat(self.at[ids] - begin, n) + np.arange(int(n.sum()))]


class Tokenizers:
    """Both tokenizers, made from the content of their files."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(byte_level)
        self.a.encode_special_tokens = True
        byte_of = byte_characters()
        entries = self.a.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(entries.values()) + 1)
        for t, i in entries.items():
            tokens[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        self.bytes_a = Side(tokens)
        self.b = SentencePieceProcessor(model_proto=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        fallback = [BYTE_PIECE.fullmatch(p) for p in names]
        self.bytes_b = Side([bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for p, m in zip(names, fallback)])
        self.cuttable = not any("▁" in p.lstrip("▁") for p in names)
        if len(names) * len(tokens) >= 1 << PAIR_BITS:
            raise ValueError("vocabularies are too large for 31-bit pairs")
        self.text = [b"%d," % i for i in range(len(tokens)) for _ in (0, 1)] + [b"%d," % i for i in range(len(names)) for _ in (0, 1)]
        self.text[1 : 2 * len(tokens) : 2] = [b"%d|" % i for i in range(len(tokens))]
        self.text[2 * len(tokens) + 1 :: 2] = [b"%d;" % i for i in range(len(names))]
        self.second, self.n_b = 2 * len(tokens), len(names)
        self._forget()

    def parts(self, text: str) -> list[str]:
        """The text cut at single spaces between other characters (which are dropped, as both sides put one before each
        part): no token of either side spans such a cut or depends on what lies beyond it."""
        if not self.cuttable:
            return [text]
        return SINGLE_SPACE.split(text) if WIDE_SPACE.search(text) else text.split(" ")

    def _learn(self, parts: list[str]) -> None:
        """Encodes parts, numbering them on from those that are known. Many go as one text, and are told apart by their bytes."""
        joined = " ".join(parts)
        ends = np.cumsum([len(p.encode("utf-8", "surrogatepass")) + 1 for p in parts])
        for pool, side, encoded, single in (
            (self.pools[0], self.bytes_a, lambda: self.a.encode(" " + joined, add_special_tokens=False).ids, lambda p: self.a.encode(" " + p, add_special_tokens=False).ids),
            (self.pools[1], self.bytes_b, lambda: self.b.encode(joined), self.b.encode),
        ):
            ids = np.array(encoded() if self.cuttable else [], np.int32)
            at, there = _in(reach, ends) if len(reach := np.cumsum(side.size[ids])) else (ends, np.zeros(len(ends), bool))
            if there.all() and reach[-1] == ends[-1]:
                pool.add(ids, np.diff(at + 1, prepend=0))
            else:  # some part doesn't give back its bytes
                each = [np.array(single(p), np.int32) for p in parts]
                pool.add(np.concatenate(each), np.array([len(x) for x in each], np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids, B ids, and where each text's begin, with the end. Parts seen before are taken from a bounded memory."""
        if len(self.known) > REMEMBERED:
            self._forget()
        parts = [self.parts(t) for t in texts]
        flat = [p for x in parts for p in x]
        before = len(self.known)
        number = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        new = list(itertools.islice(self.known, before, None))
        for k in range(0, len(new), TOGETHER):
            self._learn(new[k : k + TOGETHER])
        first = np.cumsum([0, *map(len, parts)])
        (ids_a, begin_a), (ids_b, begin_b) = (x.take(number) for x in self.pools)
        if len(self.pools[0].ids) + len(self.pools[1].ids) > HELD_IDS:
            self._forget()
        return ids_a, ids_b, begin_a[first], begin_b[first]

    def _forget(self) -> None:
        self.known, self.pools = Numbers(), (Pool(), Pool())


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Pool:
    """Ids of numbered parts, one after another."""

    def __init__(self):
        self.ids, self.at, self.more = np.zeros(0, np.int32), np.zeros(1, np.int64), []

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.more.append((ids, size))

    def joined(self) -> None:
        if self.more:
            ids, size = (np.concatenate(x) for x in zip(*self.more))
            self.ids = np.concatenate((self.ids, ids))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(size)))
            self.more = []

    def take(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts, and where each part's begin, with the end."""
        self.joined()
        size = np.diff(self.at)[number]
        begin = np.concatenate(([0], np.cumsum(size)))
        return self.ids[np.repeat(self.at[number] - begin[:-1], size) + np.arange(begin[-1])], begin


@lru_cache(1)  # a worker outlives the queries it serves
def _tokenizers(shared: _Shared) -> Tokenizers:
    return Tokenizers(*shared.value)


def shared_tokenizers(spark: SparkSession, byte_level: str | None = None, pieces: str | None = None) -> _Shared:
    """The content of the two files (by default the public ones), for all workers."""
    content = [open(p or public_tokenizers.path(name), "rb").read() for p, name in ((byte_level, BYTE_LEVEL), (pieces, PIECES))]
    return _Shared(spark.sparkContext.broadcast(content))


def _in(b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x stands in the sorted b by bisection, and whether it is there."""
    at = np.minimum(np.searchsorted(b, x), len(b) - 1)
    return at, b[at] == x


def near_middle(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each interval of a (low to high, exclusive) the place nearest to its middle whose value is in b, else -1."""
    middle = (low + high) >> 1
    out = np.where(_in(b, a[middle])[1], middle, -1)
    open_, reach = np.flatnonzero(out < 0), 0
    while len(open_):
        wide = 2 * reach + 2  # the windows cover distances reach + 1 to wide
        m = middle[open_]
        left, right = np.maximum(low[open_], m - wide), np.minimum(high[open_] - 1, m + wide)
        n_left, n_right = np.maximum(m - reach - left, 0), np.maximum(right - m - reach, 0)
        count = n_left + n_right
        begin = np.cumsum(count) - count
        k = np.arange(int(count.sum())) - np.repeat(begin, count)
        side = k >= np.repeat(n_left, count)
        distance = np.where(side, k - np.repeat(n_left, count), np.repeat(n_left, count) - 1 - k) + reach + 1
        at = np.repeat(m, count) + np.where(side, distance, -distance)
        rank = np.where(_in(b, a[at])[1], 2 * distance + side, np.iinfo(np.int64).max)
        some = count > 0
        best = np.full(len(open_), np.iinfo(np.int64).max)
        if some.any():
            best[some] = np.minimum.reduceat(rank, begin[some])
        hit = best < np.iinfo(np.int64).max
        out[open_[hit]] = m[hit] + np.where(best[hit] & 1, best[hit] >> 1, -(best[hit] >> 1))
        open_ = open_[~hit & ((m - wide > low[open_]) | (m + wide < high[open_] - 1))]
        reach = wide
    return out


def shared_cuts(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of the ends that both have. Both ascend over all texts, a text's last end is in both."""
    whole = np.flatnonzero(np.diff(first_a))
    low, high = first_a[whole], first_a[whole + 1] - 1
    in_a, in_b = [high], [first_b[whole + 1] - 1]
    low_b, high_b = first_b[whole], in_b[0]
    while True:
        inner = (low < high) & (low_b < high_b)
        low, high, low_b, high_b = low[inner], high[inner], low_b[inner], high_b[inner]
        if not len(low):
            return np.sort(np.concatenate(in_a)), np.sort(np.concatenate(in_b))
        at = near_middle(a, b, low, high)
        found = at >= 0  # the others are leaves
        low, high, low_b, high_b, at = low[found], high[found], low_b[found], high_b[found], at[found]
        at_b = np.searchsorted(b, a[at])
        in_a.append(at)
        in_b.append(at_b)
        low, high = np.concatenate((low, at + 1)), np.concatenate((at, high))
        low_b, high_b = np.concatenate((low_b, at_b + 1)), np.concatenate((at_b, high_b))


class Aligned:
    """The alignment of a slice of texts."""

    def __init__(self, t: Tokenizers, texts: list[str | None]):
        n = len(texts)
        self.t = t
        some = [i for i, x in enumerate(texts) if x]
        ids_a, ids_b, at_a, at_b = t.encode([texts[i] for i in some])
        whole = [b" " + texts[i].encode("utf-8", "surrogatepass") for i in some]
        size = np.array([len(x) for x in whole], np.int64)
        good = np.ones(len(some), bool)
        for _ in (0, 1):  # first by length, then byte by byte
            for ids, at, side in ((ids_a, at_a, t.bytes_a), (ids_b, at_b, t.bytes_b)):
                ends = np.concatenate(([0], np.cumsum(side.size[ids])))[at]
                if not _:
                    good &= np.diff(ends) == size
                else:
                    wrong = side.joined(ids) != np.frombuffer(b"".join(whole), np.uint8)
                    good &= np.diff(np.concatenate(([0], np.cumsum(wrong)))[ends]) == 0
            keep = np.flatnonzero(good)
            ids_a, at_a = _kept(ids_a, at_a, keep)
            ids_b, at_b = _kept(ids_b, at_b, keep)
            some, whole, size, good = [some[i] for i in keep.tolist()], [whole[i] for i in keep.tolist()], size[keep], good[keep]
        self.a, self.b = ids_a, ids_b
        self.first_a, self.first_b = _spread(at_a, some, n), _spread(at_b, some, n)
        self.cut_a, self.cut_b = shared_cuts(np.cumsum(t.bytes_a.size[ids_a]), np.cumsum(t.bytes_b.size[ids_b]), self.first_a, self.first_b)
        self.first_cut = np.searchsorted(self.cut_a, self.first_a)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its different pairs (A id times the number of B ids, and B id), ascending, with their
        numbers of links, and where each text's begin, with the end."""
        pair = self.a[self.cut_a].astype(np.int64) * self.t.n_b + self.b[self.cut_b]
        doc = np.repeat(np.arange(len(self.first_cut) - 1), np.diff(self.first_cut))
        key = np.sort((doc << PAIR_BITS) | pair)
        new = np.flatnonzero(np.diff(key, prepend=-1))
        return (key[new] & ((1 << PAIR_BITS) - 1)).astype(np.int32), np.diff(np.append(new, len(key))).astype(np.int32), np.searchsorted(new, self.first_cut)

    def groups(self) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.cut_a] = last_b[self.cut_b] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b = np.concatenate(([0], self.cut_b + 1))
        tokens = np.empty(len(self.a) + len(self.b), np.int32)
        tokens[np.arange(len(self.a)) + before_b[group_a]] = 2 * self.a + last_a
        tokens[np.arange(len(self.b)) + (self.cut_a + 1)[group_b]] = self.t.second + 2 * self.b + last_b
        first, text = (self.first_a + self.first_b).tolist(), self.t.text.__getitem__
        return [b"".join(map(text, tokens[i:j].tolist()))[:-1] for i, j in zip(first, first[1:])]


def _kept(ids: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(keep) == len(at) - 1:
        return ids, at
    parts = [ids[at[i] : at[i + 1]] for i in keep.tolist()]
    return np.concatenate([*parts, ids[:0]]), np.cumsum([0, *map(len, parts)])


def _spread(at: np.ndarray, some: list[int], n: int) -> np.ndarray:
    size = np.zeros(n + 1, np.int64)
    size[np.array(some, np.int64) + 1] = np.diff(at)
    return np.cumsum(size)


def align(docs: DataFrame, shared: _Shared | None = None, text: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, the groups themselves (``text``, else null), and the different pairs of
    linked ids with their numbers of links (32-bit little-endian integers)."""
    shared = shared or shared_tokenizers(docs.sparkSession)

    def run(batches):
        t = _tokenizers(shared)
        for batch in slices(batches, limit=SLICE):
            x = Aligned(t, batch.column("text").to_pylist())
            written_out = x.groups()
            pair, links, at = x.pairs()
            cuts = list(zip(at.tolist(), at.tolist()[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    *(pa.array(np.diff(v), pa.int64()) for v in (x.first_a, x.first_b, x.first_cut)),
                    pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in written_out], pa.string()),
                    pa.array([g.decode() for g in written_out] if text else [None] * len(written_out), pa.string()),
                    *(pa.array([v[i:j].tobytes() for i, j in cuts], pa.binary()) for v in (pair, links)),
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "pairs", "links"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, groups string, pairs binary, links binary")


def _ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit integers of all rows, and where each row's begin, with the end."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.int32), np.cumsum([0, *(len(x) // 4 for x in raw)])


def _added(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pair, kind="stable")
    pair, n = pair[order], n[order]
    new = np.flatnonzero(np.diff(pair, prepend=-1))
    return pair[new], np.add.reduceat(n, new) if len(new) else n


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """pair, n (its links in all rows), best (whether no other pair of its B id has more). Tasks add up what they hold."""

    def run(batches):
        held, size = [], 0

        def total():
            return _added(*(np.concatenate(x) for x in zip(*held)))

        for batch in batches:
            pair, n = _added(_ints(batch.column("pairs"))[0], _ints(batch.column("links"))[0].astype(np.int64))
            held.append((pair, n))
            size += len(pair)
            if size > HELD_PAIRS:
                held = [total()]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["pair", "n"])
                    held, size = [], 0
        if held:
            pair, n = total()
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    counts = aligned.select("pairs", "links").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("b", F.col("pair") % n_b)
    top = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def judged(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with n_best (links whose pair is the best of its B id) and count_sum (the counts of all links' pairs)."""
    spark = aligned.sparkSession
    blocks = -(-counts.count() // BLOCK_PAIRS) or 1
    out = aligned.withColumn("n_best", F.lit(0).cast("bigint")).withColumn("count_sum", F.lit(0).cast("bigint"))
    schema = out.schema
    for k in range(blocks):
        rows = counts.where(F.pmod(F.hash("pair"), F.lit(blocks)) == k).sort("pair").toArrow()
        table = spark.sparkContext.broadcast((rows["pair"].to_numpy(), rows["n"].to_numpy(), rows["best"].to_numpy()))

        def run(batches, table=table):
            pair, n, best = table.value
            for batch in batches:
                own, at = _ints(batch.column("pairs"))
                links = _ints(batch.column("links"))[0].astype(np.int64)
                place, there = _in(pair, own) if len(pair) else (np.zeros(len(own), np.int64), np.zeros(len(own), bool))
                links = np.where(there, links, 0)
                sums = [links * (best[place] if len(pair) else 0), links * (n[place] if len(pair) else 0)]
                columns = {c: batch.column(c) for c in batch.schema.names}
                for name, x in zip(("n_best", "count_sum"), sums):
                    columns[name] = pa.array(np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[at]) + columns[name].to_numpy())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        found = out.mapInArrow(run, schema)
        if k < blocks - 1:
            before, found = out, written(found, "judged")
            if k:
                discarded(before)
        out = found
    return out


def align_corpus(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row."""
    spark = docs.sparkSession
    shared = shared_tokenizers(spark, byte_level, pieces)
    aligned = written(align(docs, shared, text=False).drop("groups"), "aligned")
    counts = written(pair_counts(aligned, Tokenizers(*shared.value).n_b), "pair-counts")
    return judged(aligned, counts).select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_corpus(read_table(spark, sf_dir, "documents"))
