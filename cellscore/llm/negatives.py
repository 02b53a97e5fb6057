"""Hard negatives of anchor vectors, by exact integer scores from Four-Russians tables.

Components are integers, floor(scale * x), and a score is the inner product of two rows. For each anchor and each
group of eight dimensions the sums of all 256 subsets of the anchor's components are tabulated once. A row is kept as
packed bit planes: for each bit of its components (two's complement, as many bits as the row's largest component
needs) one byte a group. A byte looks up the sum of the anchor's components where that bit is set; the groups' sums are
added, and the planes' sums are shifted and added, highest plane first and negative, to the whole score.

Anchors are taken in blocks of bounded size, which are broadcast; each block passes over all rows twice: for the best
rows of its own label (positives), and, knowing their scores, for the best rows of other labels in each positive's
window. Tasks keep no more than the wanted rows of each list; the lists of the tasks are merged by anchor.

Rows with a null label, vector or component, one that is not finite, or a null vec_id take no part; without anchors or
rows the result is empty. Rows that repeat a vec_id count once, the one of least label (then of least packed vector).
Dimensions that a vector lacks count as zero, so an empty vector scores 0. Components beyond 64 bits are
cut to that range, and scores are taken modulo 2^64. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellscore.llm.store import read_table, written

GROUP = 8
SCALE = 256
BLOCK_ANCHORS, BLOCK_BYTES = 2048, 8 << 20
ROWS, TOGETHER = 512, 256
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of the rows of an int64 matrix, with the number of planes of each row: row i has in
    ``planes[i, :n[i]]`` one byte for each group of eight dimensions, the lowest bit first."""
    rows, dims = values.shape
    groups = -(-dims // GROUP)
    padded = np.zeros((rows, groups * GROUP), np.int64)
    padded[:, :dims] = values
    size = np.where(padded < 0, ~padded, padded).max(axis=1, initial=0).astype(np.uint64)
    n = np.ones(rows, np.int64)
    for b in range(63):
        n += size >> np.uint64(b) > 0
    planes = np.zeros((rows, int(n.max(initial=1)), groups), np.uint8)
    for b in range(planes.shape[1]):
        planes[:, b] = np.packbits(((padded >> np.int64(b)) & 1).astype(np.uint8), axis=1, bitorder="little")
    return planes, n


def tables(anchors: np.ndarray) -> np.ndarray:
    """[group, byte, anchor]: the sum of the anchor's components whose bits are set in the byte."""
    count, dims = anchors.shape
    groups = -(-dims // GROUP)
    padded = np.zeros((count, groups * GROUP), np.int64)
    padded[:, :dims] = anchors
    parts = padded.reshape(count, groups, GROUP).transpose(1, 2, 0)
    out = np.zeros((groups, 1 << GROUP, count), np.int64)
    for d in range(GROUP):
        out[:, 1 << d : 2 << d] = out[:, : 1 << d] + parts[:, d : d + 1]
    small = np.abs(padded).astype(np.float64).sum(axis=1).max(initial=0) < 2**31 - 1
    return out.astype(np.int32) if small else out


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[row, anchor]: inner products of the rows packed in ``planes`` [row, plane, group] with the tables' anchors."""
    out = np.zeros((len(planes), table.shape[2]), np.int64)
    groups = min(planes.shape[2], len(table))
    with np.errstate(over="ignore"):
        for b in range(planes.shape[1] - 1, -1, -1):
            at = planes[:, b]
            one = np.zeros(out.shape, table.dtype)  # whole, as a sum over all groups is a subset sum too
            for g in range(groups):
                one += table[g].take(at[:, g], axis=0)
            if b == planes.shape[1] - 1:
                out -= one
            else:
                out <<= 1
                out += one
    return out


class Lists:
    """The best ``most`` rows of each of ``count`` lists: higher scores first, then smaller ids."""

    def __init__(self, count: int, most: int):
        self.most = most
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(count, LEAST)  # a row below this doesn't enter the list

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        keep = rank < self.most
        self.key, self.score, self.id = key[keep], score[keep], ids[keep]
        full = rank == self.most - 1
        self.least[key[full]] = score[full]

    def batch(self, names: tuple[str, str, str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.key, pa.int32()), pa.array(self.id), pa.array(self.score)], list(names))


def packed(df: DataFrame, scale: float = SCALE, vector: str = "embedding") -> DataFrame:
    """vec_id, label, groups, planes of the rows that take part, each vec_id once."""
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col(vector).cast("array<double>").alias("v")).where(good & finite)

    def run(batches):
        for batch in batches:
            v = batch.column("v")
            size = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.floor(v.flatten().to_numpy(zero_copy_only=False) * scale)
            flat = np.where(flat >= 2.0**63, MOST, np.where(flat <= -(2.0**63), LEAST, np.clip(flat, -(2.0**63), 2.0**63 - 1024).astype(np.int64)))
            begin = np.cumsum(size) - size
            out: list = [None] * len(size)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                planes, n = pack(flat[begin[at][:, None] + np.arange(d)])
                for i, p, k in zip(at.tolist(), planes, n.tolist()):
                    out[i] = p[:k].tobytes()
            groups = pa.array((size + GROUP - 1) // GROUP, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), groups, pa.array(out, pa.binary())], ["vec_id", "label", "groups", "planes"])

    made = rows.mapInArrow(run, "vec_id bigint, label bigint, groups int, planes binary")
    first = made.groupBy("vec_id").agg(F.min(F.struct("label", "groups", "planes")).alias("_r"))
    return first.select("vec_id", "_r.label", "_r.groups", "_r.planes")


def unpacked(planes: np.ndarray) -> np.ndarray:
    """The components of rows packed alike, [row, plane, group]."""
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
    with np.errstate(over="ignore"):
        out = -bits[:, -1]
        for b in range(planes.shape[1] - 2, -1, -1):
            out = (out << 1) + bits[:, b]
    return out


def parts(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Up to ``ROWS`` rows of the same shape at a time: ids, labels, planes [row, plane, group], places in the batch."""
    for batch in batches:
        ids, labels, groups = (batch.column(c).to_numpy() for c in ("vec_id", "label", "groups"))
        size = pc.binary_length(batch.column("planes")).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = batch.column("planes").to_pylist()
        shape = np.stack((groups.astype(np.int64), size), axis=1)
        for g, n in np.unique(shape, axis=0).tolist():
            same = np.flatnonzero((groups == g) & (size == n))
            for k in range(0, len(same), ROWS):
                at = same[k : k + ROWS]
                planes = np.frombuffer(b"".join([raw[i] for i in at.tolist()]), np.uint8).reshape(len(at), n // g if g else 1, g)
                yield ids[at], labels[at], planes, at


class Block:
    """Anchors of one block in order of label and id, with their tables (built where they are used)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors

    def own_label(self, batches, most: int) -> Lists:
        """The best rows of each anchor's label, but itself."""
        found = Lists(len(self.ids), most)
        labels, first = np.unique(self.labels, return_index=True)
        last = np.append(first[1:], len(self.ids))
        table = tables(self.vectors)
        for ids, own, planes, _ in parts(batches):
            for k in np.flatnonzero(np.isin(labels, own)).tolist():
                rows = np.flatnonzero(own == labels[k])
                for a in range(first[k], last[k], TOGETHER):
                    b = min(a + TOGETHER, last[k])
                    s = scores(table[:, :, a:b], planes[rows])
                    r, c = np.nonzero((s >= found.least[a:b]) & (ids[rows][:, None] != self.ids[a:b]))
                    found.add(c + a, s[r, c], ids[rows][r])
        return found

    def other_labels(self, batches, low: np.ndarray, high: np.ndarray, most: int) -> Lists:
        """For each anchor i and window j (``low[i, j]`` to ``high[i, j]``) the best rows of other labels; key i * windows + j."""
        count, windows = low.shape
        found = Lists(count * windows, most)
        for a in range(0, count, TOGETHER):
            found.least[a * windows : (a + TOGETHER) * windows] = low[a : a + TOGETHER].ravel()
        table = tables(self.vectors)
        for ids, own, planes, _ in parts(batches):
            for a in range(0, count, TOGETHER):
                b = min(a + TOGETHER, count)
                s = scores(table[:, :, a:b], planes)
                other = own[:, None] != self.labels[a:b]
                for j in range(windows):
                    least = found.least[a * windows + j : b * windows : windows]
                    r, c = np.nonzero(other & (s >= least) & (s <= high[a:b, j]))
                    found.add((c + a) * windows + j, s[r, c], ids[r])
        return found


def _blocks(anchors: DataFrame) -> Iterator[Block]:
    """The anchors in blocks of at most about ``BLOCK_ANCHORS`` rows and ``BLOCK_BYTES``; one block at a time is on the driver."""
    n, groups = anchors.agg(F.count("*"), F.max("groups")).first()
    most = max(1, min(BLOCK_ANCHORS, BLOCK_BYTES // (8 * GROUP * max(groups or 1, 1))))
    number = 1 if n <= most else -(-n * 4 // (most * 3))
    for k in range(number):
        rows = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(number)) == k).orderBy("label", "vec_id").toArrow().to_batches()
        got = [(i, label, v) for batch in rows for ids, labels, planes, at in parts([batch]) for i, label, v in zip(ids.tolist(), labels.tolist(), unpacked(planes))]
        if not got:
            continue
        got.sort(key=lambda x: (x[1], x[0]))
        vectors = np.zeros((len(got), max(max(len(x[2]) for x in got), GROUP)), np.int64)
        for i, x in enumerate(got):
            vectors[i, : len(x[2])] = x[2]
        yield Block(np.array([x[0] for x in got], np.int64), np.array([x[1] for x in got], np.int64), vectors)


def _merged(lists: DataFrame, key: str, most: int) -> DataFrame:
    """The best ``most`` rows over the lists of all tasks, with their rank."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """The integers n with low * score <= 100 * n <= high * score, as bounds (empty: the first is greater)."""
    a, b = -(-low * score // 100), high * score // 100
    return (a, b) if LEAST <= a <= b <= MOST else (0, -1)


def hard_negatives(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = SCALE, vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row whose vec_id is divisible by
    ``every`` and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose score
    is from ``low`` to ``high`` per cent of the positive's (positives with a score below 0 have none)."""
    spark = df.sparkSession
    rows = written(packed(df, scale, vector), "packed")
    made = None
    for block in _blocks(rows.where(F.col("vec_id") % every == 0)):
        shared = spark.sparkContext.broadcast(block)

        def best(batches, shared=shared):
            yield shared.value.own_label(batches, positives).batch(("anchor", "id", "score"))

        some = rows.where(F.col("label").isin(np.unique(block.labels).tolist())) if len(np.unique(block.labels)) <= 100 else rows
        top = _merged(some.mapInArrow(best, "anchor int, id bigint, score bigint"), "anchor", positives).toArrow()
        anchor, rank, ids, score = (top[c].to_numpy() for c in ("anchor", "rank", "id", "score"))
        bounds = np.array([window_of(s, low, high) for s in score.tolist()], np.int64).reshape(-1, 2)
        lows, highs = np.zeros((len(block.ids), positives), np.int64), np.full((len(block.ids), positives), -1, np.int64)
        lows[anchor, rank - 1], highs[anchor, rank - 1] = bounds[:, 0], bounds[:, 1]
        windows = spark.sparkContext.broadcast((lows, highs))

        def harder(batches, shared=shared, windows=windows):
            yield shared.value.other_labels(batches, *windows.value, negatives).batch(("pair", "id", "score"))

        best_others = _merged(rows.mapInArrow(harder, "pair int, id bigint, score bigint"), "pair", negatives)
        names = pa.table({"pair": pa.array(anchor * positives + rank - 1, pa.int32()), "anchor_id": pa.array(block.ids[anchor]), "positive_id": pa.array(ids), "positive_score": pa.array(score)})
        out = best_others.join(F.broadcast(spark.createDataFrame(names)), "pair").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        out = written(out, "negatives")  # each block's lists: at most positives * negatives rows an anchor
        made = out if made is None else made.unionByName(out)
    if made is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return made


def relabelled(df: DataFrame) -> DataFrame:
    """Labels as in the query: where vec_id is divisible by 7, label becomes (label + 1) % 10."""
    return df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")))


ORACLE = """
with r as (
 select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
 from embeddings
 where label is not null and embedding is not null
   and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
 select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
        cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) as score
 from r a join r b on a.vec_id <> b.vec_id
 where a.vec_id % 100 = 0),
p as (
 select anchor_id, id as positive_id, score as positive_score
 from s where same
 qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id,
       cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as int) as rank,
       id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 10
"""
