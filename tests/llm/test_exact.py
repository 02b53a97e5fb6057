import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellscore.llm.exact import CuckooIndex, change_index, exact_dedup, op10_exact_dedup

from .conftest import frame

BLANK = str.maketrans("", "", " \t\n\x0b\x0c\r")


def digest(x):
    return hashlib.sha256(str(x).encode()).digest()


def brute(rows):
    groups = {}
    for i, t in rows:
        t = t or ""
        groups.setdefault(t.translate(BLANK), []).append((-len(t), i))
    out = []
    for k, g in groups.items():
        keep = min(g)[1]
        out += [(i, keep, len(g), i == keep, hashlib.sha256(k.encode()).hexdigest()) for _, i in g]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 40)), max_size=300))
def test_index_is_a_set(steps):
    index, live = CuckooIndex(1), {}
    for n, (insert, x) in enumerate(steps):
        if insert:
            assert index.insert(digest(x), n) == live.setdefault(x, n)
        else:
            assert index.delete(digest(x)) == live.pop(x, None)
        assert index.live == len(live)
    assert sorted(index.entries()) == sorted((digest(x), n) for x, n in live.items())


def test_index_grows_and_keeps_its_digests():
    index = CuckooIndex(2)
    for i in range(5000):
        index.insert(digest(i), i)
    assert index.buckets > 1000 and all(index.find(digest(i)) == i for i in range(5000)) and index.find(digest(-1)) is None


def test_equal_fingerprints_are_told_apart_by_content():
    one = digest(1)
    other = one[:12] + bytes(20)
    index = CuckooIndex()
    assert index.insert(one, 1) == 1 and index.find(other) is None
    assert index.insert(other, 2) == 2 and index.delete(one) == 1 and index.find(other) == 2


def test_odd_texts(spark, odd_texts):
    texts = [*odd_texts, "a b", "ab", "a  b", "AB", "a b", " ab "]
    docs = frame(spark, texts, ("keep_id", "n", "digest", "chars"))
    assert got(exact_dedup(docs)) == brute(enumerate(texts))
    assert got(exact_dedup(docs.limit(0))) == []


def test_repeated_rows_and_rows_without_id(spark):
    docs = frame(spark, ["x y", "xy", "z"])
    twice = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("bigint")))
    out = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(twice).collect()), key=str)
    assert out == [(0, 0, 4, True), (0, 0, 4, True), (1, 0, 4, False), (2, 2, 1, True), (None, 0, 4, False)]


def test_changes_of_a_kept_index(spark):
    r = random.Random(3)
    index, live = None, set()
    for _ in range(3):
        steps = [(r.random() < 0.6, r.randrange(60), n) for n in range(200)]
        for insert, x, _ in steps:
            (live.add if insert else live.discard)(x)
        index = change_index(index, spark.createDataFrame([(digest(x), i, n) for i, x, n in steps], "digest binary, insert boolean, seq bigint"), shards=5)
        rows = [bytes(x.digest) for x in index.collect()]
        assert sorted(rows) == sorted(map(digest, live))
        index = spark.createDataFrame([(x,) for x in rows], "digest binary")


def test_test_table(spark):
    sf = "/root/testdata/sf0.01"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert any(not r[3] for r in want) and got(op10_exact_dedup(spark, sf)) == want
