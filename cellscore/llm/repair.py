"""Token-id output compressed by a Re-Pair grammar per shard, with random access.

Documents are put in ascending doc_id order, their ids (with an end id after each) cut into shards of at least
``SHARD_IDS`` ids, and in each shard frequent neighbouring pairs are replaced by nonterminals, again and again, until
no pair is frequent. A pair never spans two documents, so each document is a stretch of the
compressed sequence. Rules and the number of ids that each nonterminal stands for are stored with it, so a stretch of
ids is found and expanded without the rest (``ShardReader.ids``).

File format (``pack``; little endian, in the column ``payload`` of a Parquet table, one row per shard): magic, counts
of terminals, rules, symbols and documents; then 32-bit arrays: both sides of each rule, expansion lengths, symbols,
and for each document where it begins in the symbols, with the end.

Null and empty texts have the end id alone. Rows of one doc_id are ordered by text; null doc_ids come first. Other
columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellscore.llm.arrow import SPACE, Words, slices
from cellscore.llm.store import read_table, scratch_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SHARD_IDS = 1 << 19
#: How often a pair must stand to be replaced, and at how many places without overlap.
LEAST, LEAST_USED = 6, 3
TABLE = 1 << 18
#: From so many symbols on all rules are written out before they are expanded.
MANY = 4096
#: Pairs are counted exactly from the round on that replaces no more than a MUCH-th of the symbols.
MUCH = 3
MAGIC = 0x31505252
REMEMBERED, RECENT, TOGETHER = 2_000_000, 100_000, 500
SALT = np.uint64(0x632BE59BD9B4E019)
SAME = np.arange(256, dtype=np.uint8)
SPACED = re.compile(r"[\x20\x09-\x0D]")
#: A piece that is a word of letters below U+0250 (whose lower case and normal form are single steps), already in lower
#: case, with symbols behind it; or anything else.
SPLIT = re.compile(r"""^(?:([a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f]+)([!-/:-@\[-`{-~]*)|.*)$""", re.MULTILINE).findall


class Known:
    """Sorted piece hashes with the place and number of their ids in a pool."""

    def __init__(self):
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each of the sorted ``keys``, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return i, self.keys[i] == keys

    def add(self, keys: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        keys, at, n = (np.concatenate(x) for x in ((self.keys, keys), (self.at, at), (self.n, n)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.n = keys[order], at[order], n[order]


class WordEncoder:
    """Ids of whole columns of texts, by the tokenizers library.

    No token spans ASCII white space and none depends on what lies beyond it, so texts are cut there and a piece that
    was seen before (known by its 64-bit hash, A-Z lower-cased) is not encoded again. Pieces of plain letters with
    symbols behind them are encoded many in a call and told apart by the tokens that end a word or a run of symbols.

    With ``special``, as is the library's default, the strings of special tokens in a text are these tokens. A piece
    that holds one is encoded on its own and known by its hash as it is written.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special]
        if any(SPACED.search(t) for t in added):
            raise ValueError("added tokens with white space are not supported")
        self.added = re.compile("|".join(map(re.escape, added)).encode() or b"(?!)").finditer
        self.holds_added = re.compile("|".join(map(re.escape, added)) or "(?!)").search
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.terminals = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.terminals, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.old, self.new = Known(), Known()
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _whole(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        parts: list[np.ndarray] = []
        sizes = np.zeros(len(pieces), np.int64)
        kinds = SPLIT("\n".join(pieces).lower())
        units = np.array([bool(w) + bool(m) for w, m in kinds] if len(kinds) == len(pieces) else [0] * len(pieces))
        units[[i for i, x in enumerate(pieces) if self.holds_added(x)]] = 0
        plain, order = np.flatnonzero(units), []
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for g, ids in zip(groups, self._whole([" ".join([pieces[i] for i in g.tolist()]) for g in groups])):
            ends = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum(units[g])
            if len(ends) == last[-1]:
                sizes[g] = np.diff(ends[last - 1], prepend=0)
                parts.append(ids)
                order.append(g)
            else:
                units[g] = 0
        odd = np.flatnonzero(units == 0)
        single = self._whole([pieces[i] for i in odd.tolist()]) if len(odd) else []
        sizes[odd] = [len(x) for x in single]
        ids, order = np.concatenate([*parts, *single, np.zeros(0, np.uint32)]), np.concatenate([*order, odd])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), np.uint32)))
        self.pool[self.used : self.used + len(ids)] = ids
        at = np.empty(len(pieces), np.int64)
        at[order] = self.used + np.cumsum(sizes[order]) - sizes[order]
        self.used += len(ids)
        if len(self.new.keys) > RECENT:
            self.old.add(self.new.keys, self.new.at, self.new.n)
            self.new = Known()
        self.new.add(keys, at, sizes)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end`` behind it, and how many each has."""
        words = Words(texts, SPACE)
        keys, data = words.hash, words.data
        wide = (data > 0xC9) | ((data == 0xC9) & (np.append(data[1:], 0) >= 0x90)) if len(data) else np.zeros(0, bool)
        if wide.any():  # there, case is the library's business
            some = np.concatenate(([0], np.cumsum(wide)))
            keys = np.where(some[words.end] > some[words.start], Words(texts, SPACE, SAME).hash ^ SALT, keys)
        places = [m.start() for m in self.added(data.tobytes())]
        if places:  # case matters there
            held = np.searchsorted(words.start, places, "right") - 1
            keys = keys.copy()
            keys[held] = Words(texts, SPACE, SAME).hash[held] ^ ~SALT
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.old.keys) + len(self.new.keys) + len(keys) > REMEMBERED:
            self._forget()
        unseen = np.flatnonzero(~(self.old.find(keys)[1] | self.new.find(keys)[1]))
        if len(unseen):
            raw = data.tobytes()
            self._learn(keys[unseen], [raw[s:e].decode("utf-8") for s, e in zip(words.start[first[unseen]].tolist(), words.end[first[unseen]].tolist())])
        at, n = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
        for known in (self.old, self.new):
            i, there = known.find(keys)
            k = np.flatnonzero(there)
            at[k], n[k] = known.at[i[k]], known.n[i[k]]
        counts, first = words.counts(), words.first
        if end is not None:
            at[-1], n[-1] = len(self.pool), 1
            inverse = np.insert(inverse, first[1:], len(keys))
            counts, first = counts + 1, first + np.arange(len(first))
        sizes = n[inverse]
        before = np.concatenate(([0], np.cumsum(sizes)))
        place = np.repeat(at[inverse] - before[:-1], sizes) + np.arange(before[-1])
        ids = self.pool[np.minimum(place, len(self.pool) - 1)]
        ids[place == len(self.pool)] = end or 0
        return ids, np.diff(before[first])


@cache
def _encoder(path: str, special: bool) -> WordEncoder:
    return WordEncoder(path, special)


def _pairs(x: np.ndarray, new: np.ndarray, salt: int | None, least: int, since: int = 0):
    """For each place but the last: the number of its pair, whether the pair counts there, and the pairs.

    With ``salt`` pairs are numbered by a hash of ``TABLE`` values, of which the last pair of each counts, another
    one with another salt; without it all pairs have numbers of their own, and with ``since`` only pairs with a symbol from
    that one on count."""
    whole = ~new[1:]  # a pair never spans two documents
    if since:
        late = x >= since
        some = np.flatnonzero((late[:-1] | late[1:]) & whole)
        number, counts = np.zeros(len(x) - 1, dtype=np.int64), np.zeros(len(x) - 1, dtype=bool)
        held, number[some] = np.unique(x[some] << 32 | x[some + 1], return_inverse=True)
        counts[some] = True
        return number, counts, held
    code = x[:-1] << 32 | x[1:]
    mix = salt or 0
    slot = ((x[:-1] * (0x9E3779B1 + 2 * mix) ^ x[1:] * (0x85EBCA77 + 4 * mix)) >> 7) & (TABLE - 1)
    if salt is None:  # no pair is more frequent than its hash
        some = np.flatnonzero(whole & (np.bincount(slot[whole], minlength=TABLE)[slot] >= least))
        number, counts = np.zeros(len(code), dtype=np.int64), np.zeros(len(code), dtype=bool)
        held, number[some] = np.unique(code[some], return_inverse=True)
        counts[some] = True
        return number, counts, held
    held = np.full(TABLE, -1, dtype=np.int64)
    held[slot] = code
    return slot, whole & (held[slot] == code), held


def _places(number: np.ndarray, counts: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose pair is replaced, with the pairs' numbers: frequent ones, no two of which overlap, and each pair at ``LEAST_USED`` places or more."""
    none = np.zeros(0, dtype=np.int64)
    if not counts.any():
        return none, none
    count = np.bincount(number[counts], minlength=size)
    at = np.flatnonzero(counts & (count[number] >= least))
    if not len(at):
        return none, none
    # of a run of one pair (a a a a) every second place, then the place with the higher count of overlapping ones
    s = number[at]
    joined = np.concatenate(([False], (at[1:] == at[:-1] + 1) & (s[1:] == s[:-1])))
    group = np.flatnonzero(~joined)
    odd = (np.arange(len(at)) - group[np.cumsum(~joined) - 1]) & 1
    at, s = at[odd == 0], s[odd == 0]
    key = count[s] * size + s
    taken = np.zeros(len(number) + 2, dtype=bool)
    for _ in range(2):  # the second time, places between those taken
        better = np.ones(len(at), dtype=bool)
        touch = at[1:] == at[:-1] + 1
        better[1:] &= ~touch | (key[1:] > key[:-1])
        better[:-1] &= ~touch | (key[:-1] > key[1:])
        taken[at[better]] = True
        free = ~(taken[at - 1] | taken[at] | taken[at + 1])
        at, key = at[free], key[free]
    at = np.flatnonzero(taken)
    s = number[at]
    often = np.bincount(s, minlength=size)[s] >= LEAST_USED
    return at[often], s[often]


def frequent_pairs(x: np.ndarray, new: np.ndarray, least: int = LEAST) -> int:
    """How many pairs would still be replaced."""
    if len(x) < 2:
        return 0
    number, counts, held = _pairs(x, new, None, least)
    return len(np.unique(_places(number, counts, len(held), least)[1]))


def compress(ids: np.ndarray, starts: np.ndarray, terminals: int, least: int = LEAST):
    """Symbols, left and right sides of the rules, expansion lengths (of the rules), and ``starts`` in the symbols.

    Rounds go on until no pair is frequent. Pairs are counted by a salted hash while that finds much to replace, and then
    exactly: those with symbols of the last round while there are frequent ones, then all; a round without any replacement, with
    all pairs counted, is the last."""
    x = ids.astype(np.int64)
    new = np.zeros(len(x), dtype=bool)
    new[starts[starts < len(x)]] = True
    left, right = [], []
    lengths = np.ones(terminals, dtype=np.int64)
    names, salt, since = terminals, 0, 0
    while len(x) > 1:
        number, counts, held = _pairs(x, new, salt, least, since)
        at, s = _places(number, counts, len(held), least)
        if salt is None and not since and not len(at):
            break
        if salt is not None:
            salt = salt + 1 if len(at) > len(x) // MUCH else None
        since = names if salt is None and len(at) else 0
        if not len(at):
            continue
        chosen = np.unique(s)
        name = np.zeros(len(held), dtype=np.int64)
        name[chosen] = names + np.arange(len(chosen))
        names += len(chosen)
        left.append(held[chosen] >> 32)
        right.append(held[chosen] & 0xFFFFFFFF)
        lengths = np.concatenate((lengths, lengths[left[-1]] + lengths[right[-1]]))
        x[at] = name[s]
        keep = np.ones(len(x), dtype=bool)
        keep[at + 1] = False
        x, new = x[keep], new[keep]
    none = np.zeros(0, dtype=np.int64)
    size = lengths[x] if len(x) else none
    begin = np.searchsorted(np.concatenate(([0], np.cumsum(size))), starts)
    return x, np.concatenate([none, *left]), np.concatenate([none, *right]), lengths[terminals:], begin


def pack(ids: np.ndarray, starts: np.ndarray, terminals: int) -> bytes:
    """The file of one shard; ``starts`` has the place of each document in ``ids``, with the end."""
    symbols, left, right, lengths, begin = compress(ids, starts, terminals)
    head = np.array([MAGIC, terminals, len(left), len(symbols), len(starts) - 1])
    return np.concatenate((head, left, right, lengths, symbols, begin)).astype("<u4").tobytes()


def _gathered(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``at``, one after another."""
    end = np.cumsum(size)
    return flat[np.repeat(at - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)]


class ShardReader:
    def __init__(self, payload: bytes):
        head = np.frombuffer(payload, "<u4", 5).astype(np.int64)
        magic, self.terminals, rules, symbols, self.documents = head.tolist()
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        parts = np.split(np.frombuffer(payload, "<u4", offset=20), np.cumsum([rules, rules, rules, symbols]))
        self.left, self.right, lengths, self.symbols, begin = parts
        self.begin = begin.astype(np.int64)
        size = np.ones(len(self.symbols), dtype=np.int64)
        named = self.symbols >= self.terminals
        size[named] = lengths[self.symbols[named] - np.uint32(self.terminals)]
        self.place = np.concatenate(([0], np.cumsum(size)))  # of each symbol among the ids
        self.starts = self.place[self.begin]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all symbols, one after another, and where each symbol's begin and how many they are. Rules refer to
        symbols before them, so they are written out in stretches that refer to nothing of themselves."""
        n = len(self.left)
        at = np.arange(self.terminals + n, dtype=np.int64)
        size = np.ones(self.terminals + n, dtype=np.int64)
        pool = [np.arange(self.terminals, dtype=np.uint32)]
        highest, flat, i = np.maximum(self.left, self.right), pool[0], 0
        pairs = np.stack((self.left, self.right), axis=1).astype(np.int64)
        while i < n:
            later = np.flatnonzero(highest[i:] >= self.terminals + i)
            j = i + int(later[0]) if len(later) else n
            both = size[pairs[i:j]]
            begin = len(flat) + np.concatenate(([0], np.cumsum(both.sum(axis=1))))
            size[self.terminals + i : self.terminals + j] = both.sum(axis=1)
            at[self.terminals + i : self.terminals + j] = begin[:-1]
            flat = np.concatenate((flat, _gathered(flat, at[pairs[i:j].ravel()], both.ravel())))
            i = j
        return flat, at, size

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if len(symbols) > MANY:
            flat, at, size = self.tables()
            return _gathered(flat, at[symbols], size[symbols])
        while True:
            named = symbols >= self.terminals
            if not named.any():
                return symbols
            out = np.repeat(symbols, 1 + named)
            first = np.flatnonzero(named) + np.arange(int(named.sum()))
            rule = symbols[named] - np.uint32(self.terminals)
            out[first], out[first + 1] = self.left[rule], self.right[rule]
            symbols = out

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the shard; only the symbols over them are expanded."""
        a = int(np.searchsorted(self.place, start, "right")) - 1
        b = int(np.searchsorted(self.place, start + n, "left"))
        skip = start - int(self.place[a])
        return self.expand(self.symbols[a:b])[skip : skip + n]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.begin[k] : self.begin[k + 1]])


SHARD = "part int, shard bigint, n_ids bigint, doc_ids array<bigint>, payload binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, special: bool = False) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes the shards, in ascending doc_id order, as a Parquet table at ``path``.

    ``special``: strings of special tokens in a text are these tokens, not ordinary text.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def shard(part, number, doc_ids, sizes, held, terminals):
        starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        payload = pack(np.concatenate(held), starts, terminals)
        row = [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([int(starts[-1])], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([payload], pa.binary())]
        return pa.RecordBatch.from_arrays(row, ["part", "shard", "n_ids", "doc_ids", "payload"])

    def run(batches):
        encoder = _encoder(tokenizer, special)
        terminals = max(encoder.terminals, end_id + 1)
        part, number, doc_ids, sizes, held, size = 0, 0, [], [], [], 0
        for batch in slices(batches):
            part = batch.column("part")[0].as_py()
            ids, counts = encoder.encode(batch.column("text"), end_id)
            doc_ids += batch.column("doc_id").to_pylist()
            sizes += counts.tolist()
            held.append(ids)
            size += len(ids)
            if size >= shard_ids:
                yield shard(part, number, doc_ids, sizes, held, terminals)
                number, doc_ids, sizes, held, size = number + 1, [], [], [], 0
        if doc_ids:
            yield shard(part, number, doc_ids, sizes, held, terminals)

    ordered.mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(SHARD).parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, part, shard of each document in the shards, decoded from them."""

    def run(batches):
        for batch in batches:
            for part, shard, ids, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "doc_ids", "payload"))):
                reader = ShardReader(payload)
                raw = memoryview(reader.ids(0, int(reader.place[-1])).astype("<u4").tobytes())
                at = reader.starts.tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
                cols = [pa.array(ids, pa.int64()), pa.array(at[:-1], pa.int64()), pa.array(np.diff(reader.starts)), pa.array(crc, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array([shard] * len(ids), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "at", "n_tokens", "ids_crc32", "part", "shard"])

    found = shards.select("part", "shard", "doc_ids", "payload").mapInArrow(run, "doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint, part int, shard bigint")
    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as tasks wrote the shards
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", "shard", within.alias("w")).join(parts, "part").select("part", "shard", (F.col("p") + F.col("w")).alias("base"))
    return found.join(offsets, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")


def op3_token_id_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(read_table(spark, sf_dir, "documents"), scratch_path(spark, "token-ids"), public_tokenizers.path(TOKENIZER), special=True)
    return read_documents(shards)
