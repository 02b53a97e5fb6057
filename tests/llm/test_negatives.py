import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cellscore.llm import negatives
from cellscore.llm.negatives import hard_negatives, op12_hard_negatives, pack, relabelled, scores, tables, unpacked

SCHEMA = "vec_id bigint, label int, embedding array<float>, planes string, rank int, score double"


def brute(rows, every=100):
    """rows: (vec_id, label, vector), each vec_id once."""
    good = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        good[i] = (label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
    out = []
    for a, (la, va) in good.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(va, v)) for i, (_, v) in good.items()}
        order = sorted((i for i in good if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in order if good[i][0] == la][:5]:
            others = [i for i in order if good[i][0] != la and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(others[:10])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, label, v, "x", 1, 0.5) for i, label, v in rows], SCHEMA).repartition(3)


def got(df):
    return sorted(map(tuple, df.collect()))


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 20), st.integers(1, 5), st.integers(1, 5), st.sampled_from([1, 3, 300, 1 << 20, 1 << 40, 1 << 62]), st.randoms())
def test_scores_are_inner_products(dims, rows, anchors, size, r):
    x = np.array([[r.randint(-size, size - 1) for _ in range(dims)] for _ in range(rows)], np.int64).reshape(rows, dims)
    y = np.array([[r.randint(-9, 9) for _ in range(dims)] for _ in range(anchors)], np.int64).reshape(anchors, dims)
    planes, n = pack(x)
    for i in range(rows):
        own = planes[i : i + 1, : n[i]]
        assert (unpacked(own)[:, :dims] == x[i]).all()
        want = [(sum(int(p) * int(q) for p, q in zip(x[i], y[j])) + (1 << 63)) % (1 << 64) - (1 << 63) for j in range(anchors)]
        assert scores(tables(y), own)[0].tolist() == want


def test_odd_rows(spark):
    r = random.Random(4)
    rows = [(i * 5, r.randrange(3), [r.choice((-0.5, -0.25, 0.0, 0.125, 0.25, 1.0)) for _ in range(11)]) for i in range(150)]
    rows += [(1001, None, [0.5] * 11), (1002, 1, None), (1003, 1, [0.5, None]), (1004, 1, [float("nan")] * 11), (1005, 0, [float("inf"), 1.0]), (None, 1, [0.5] * 11)]
    rows += [(1006, 2, []), (1007, 2, [1.0]), (1008, 1, [0.5] * 30), (1100, 7, [1.0] * 11), (1200, 1, [-1e9] * 3), (-100, 0, [0.5] * 9)]
    df = frame(spark, rows)
    want = brute(rows)
    assert want and got(hard_negatives(relabelled(df))) == want
    assert got(hard_negatives(relabelled(df.unionByName(df)))) == want
    assert got(hard_negatives(df.limit(0))) == []
    assert hard_negatives(df.where("vec_id = 5")).count() == 0


def test_blocks_and_slices(spark, monkeypatch):
    """Several blocks of anchors, which all see all rows; many equal vectors."""
    r = random.Random(8)
    rows = [(i, r.randrange(12), [0.25] * 8 if i % 3 else [r.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    want = brute(rows, 20)
    for name, value in (("BLOCK_ANCHORS", 6), ("ROWS", 7), ("TOGETHER", 2)):
        monkeypatch.setattr(negatives, name, value)
    assert got(hard_negatives(relabelled(frame(spark, rows)), every=20)) == want


def test_lists_keep_the_best():
    r = random.Random(2)
    lists, kept = negatives.Lists(3, 4), {k: [] for k in range(3)}
    for _ in range(50):
        new = [(r.randrange(3), r.choice((5, 6, 7, negatives.LEAST, negatives.MOST)), r.randrange(1000)) for _ in range(r.randrange(8))]
        lists.add(*(np.array([x[i] for x in new], np.int64) for i in range(3)))
        for k, s, i in new:
            kept[k] = sorted([*kept[k], (-s, i)])[:4]
    assert [(k, s, i) for k, s, i in zip(lists.key.tolist(), lists.score.tolist(), lists.id.tolist())] == [(k, -s, i) for k in range(3) for s, i in kept[k]]


def test_test_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(x.vec_id, x.label, x.embedding) for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    assert len(want) > 500 and got(op12_hard_negatives(spark, sf)) == want
