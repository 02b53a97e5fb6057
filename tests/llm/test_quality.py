import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cellscore.llm import quality as Q

from .conftest import frame


def test_marginals_equal_those_of_all_labellings():
    r = np.random.default_rng(1)
    lines = np.array([1, 4, 2, 1, 3])
    u, moves = r.normal(size=lines.sum()), r.normal(size=(2, 2))
    p = Q.forward_backward(u, moves, Q.Layout(lines))[2]
    at = 0
    for n in lines:
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(u[at + i] for i in range(n) if y[i]) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
        assert np.allclose(p[at : at + n], good / total)
        at += n


def test_lines_of_odd_texts(odd_texts):
    lines, measures, weight = Q.line_measures(pa.array(odd_texts))
    want = [(t or "").encode().split(b"\n") for t in odd_texts]
    assert lines.tolist() == [len(x) for x in want]
    assert weight.tolist() == [max(1, len(x)) for w in want for x in w]
    assert np.allclose(np.exp(measures[:, 1]) - 1, [len([y for y in x.replace(b"\x1c", b"_").split() if y]) for w in want for x in w]) and np.isfinite(measures).all()


def test_odd_texts_are_scored_alone_as_together(spark, odd_texts):
    docs = frame(spark, odd_texts, ("score", "label", "packed"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 7 != 1, F.col("doc_id").cast("int") % 2).alias("quality"), F.lit(1).alias("text"))
    chain = Q.train(docs, labels.unionByName(labels).unionByName(labels.withColumn("doc_id", F.lit(None).cast("bigint"))))
    out = {r.doc_id: r for r in Q.score_quality(docs, chain).collect()}
    for i, t in enumerate(odd_texts):
        assert out[i].score == Q.scores(chain, pa.array([t], pa.string()))[0] and 0 <= out[i].score <= 1 and out[i].label == 7
    assert Q.score_quality(docs.limit(0), chain).count() == 0


def test_without_labels(spark):
    docs = frame(spark, ["a", None])
    assert Q.train(docs, spark.createDataFrame([(0, 1), (1, None)], "doc_id bigint, quality int")) is None
    assert {r.score for r in Q.score_quality(docs, None).collect()} == {0.5}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = Q.op5_quality_crf(spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = (sorted(r.score for r in rows if r.quality == q) for q in (1, 0))
    order = sum(np.searchsorted(bad, s, "left") + (np.searchsorted(bad, s, "right") - np.searchsorted(bad, s, "left")) / 2 for s in good)
    assert order / len(good) / len(bad) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95 and np.mean([r.predicted for r in rows if r.quality]) > 0.985
