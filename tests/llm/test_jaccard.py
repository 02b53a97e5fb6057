import re

from cellscore.llm.jaccard import components, jaccard_components, op7_ngram_jaccard_join

from .conftest import frame

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n=4, percent=85):
    sets = {i: shingles(t, n) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def test_odd_texts(spark, odd_texts):
    docs = frame(spark, odd_texts, ("id", "size", "gram", "a", "b", "root"))
    assert got(jaccard_components(docs)) == brute(enumerate(odd_texts))


def test_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len({c for _, _, c in want}) < len(want)
    assert got(op7_ngram_jaccard_join(spark, "/root/testdata/sf0.01")) == want


def test_empty_table_and_rows_without_id(spark):
    docs = frame(spark, ["a b c d e", "a b c d e"])
    assert got(jaccard_components(docs.limit(0))) == []
    null = docs.selectExpr("cast(null as bigint) doc_id", "text").unionByName(docs.select("doc_id", "text"))
    out = jaccard_components(null).collect()
    assert sorted((r.doc_id is None, r.n_shingles, r.component_id or 0) for r in out) == [(False, 2, 0), (False, 2, 0), (True, 2, 0), (True, 2, 0)]


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    out = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert sorted(map(tuple, out.collect())) == [(i, 0) for i in range(1, 41)] + [(95, 90), (100, 90)]


def test_sketches_bound_the_overlap(spark):
    """Never less than the true overlap, and far less for sets without much in common."""
    import numpy as np
    from pyspark.sql import functions as F

    from cellscore.llm.jaccard import sketch, suffix_bound

    r = np.random.default_rng(3)
    rows = []
    for n in (1, 2, 63, 64, 65, 128, 129, 700, 9000, 20_000):
        for m, shared in ((n, n), (n, n // 2), (max(1, int(n * 0.86)), int(n * 0.85)), (3 * n, 0)):
            pool = r.choice(1 << 62, n + m, replace=False).astype(np.uint64) * np.uint64(2)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:shared], pool[n : n + m - shared])))
            rows.append((n, m, min(shared, m), sketch(a).tolist(), sketch(b).tolist()))
    df = spark.createDataFrame(rows, "na int, nb int, shared int, a array<bigint>, b array<bigint>")
    for x in df.withColumn("most", suffix_bound(F.col("a"), F.col("b"), F.col("na"), F.col("nb"))).collect():
        assert x.shared <= x.most and (x.shared * 2 != x.na or x.na not in (128, 700) or x.most < 0.92 * x.na)


def test_group_of_near_copies(spark, words):
    """Many texts around one, some linked, some not; links through others than the first."""
    import random

    r = random.Random(12)
    base = [r.choice(words) for _ in range(60)]
    texts = []
    for i in range(120):
        w = list(base)
        for _ in range(1 + i % 4):
            w[r.randrange(60)] = f"own{r.randrange(10**6)}"
        texts.append(" ".join(w))
    for n, percent in ((4, 85), (5, 80)):
        want = brute(enumerate(texts), n, percent)
        assert len({c for _, _, c in want}) > 10 and got(jaccard_components(frame(spark, texts), n, percent)) == want
