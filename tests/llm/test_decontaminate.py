import hashlib
import re

from pyspark.sql import functions as F

from cellscore.llm.decontaminate import contaminated, contamination, hit_words, op8_benchmark_decontamination

from .conftest import frame
from .test_jaccard import AZ


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def brute(docs, items, window=13):
    index = {}
    for i, t in items:
        w = words(t)
        m = min(len(w), window)
        for s in range(len(w) - m + 1 if m else 0):
            index.setdefault(tuple(w[s : s + m]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for m in sorted({len(k) for k in index}):
            for s in range(len(w) - m + 1):
                if k := index.get(tuple(w[s : s + m])):
                    names |= k
                    hit.update(range(s, s + m))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def digested(df):
    df = df.withColumn("n_hit", hit_words())
    return df.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint"), F.sha2(F.concat_ws(",", "items"), 256), contaminated())


def test_odd_texts_in_one_and_many_blocks(spark, odd_texts):
    long = [t for t in odd_texts if t and len(t) > 150]
    items = [(1, long[0]), (2, "a"), (3, "A, a: a"), (4, ""), (5, None), (10, " ".join(long[1].split(" ")[5:30])), (10, "nul"), (11, long[2][:120]), (12, " ".join(long[1].split(" ")[8:20])), (13, "!!"), (14, long[0])]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id bigint, text string, key int, items int")
    docs = frame(spark, odd_texts, ("key", "items", "spans", "n"))
    docs = docs.unionByName(docs.where("doc_id % 4 = 0"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], items)
    assert sum(r[2] > 0 for r in want) > 10
    assert got(digested(contamination(docs, table))) == want
    assert got(digested(contamination(docs, table, block_chars=900))) == want


def test_empty_tables(spark, odd_texts):
    docs = frame(spark, odd_texts)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert got(digested(contamination(docs, none))) == brute(enumerate(odd_texts), [])
    assert got(digested(contamination(docs.limit(0), none))) == []


def test_test_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    assert 0 < sum(r[5] for r in want) < len(want)
    assert got(op8_benchmark_decontamination(spark, sf)) == want
