import re

import numpy as np
from pyspark.sql import functions as F

from cellscore.llm import secrets as S

from .conftest import frame

KEY = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
HEX = re.compile(r"""(?i)token = "([0-9a-f]{40})\"""")


def test_coverage_counts_bytes_of_frequent_words():
    import pyarrow as pa

    frequent = np.zeros(S.WORDS, bool)
    frequent[S.bucket(S.Words(pa.array(["house garden"]), S.SYMBOLS).hash)] = True
    assert S.coverage(np.frombuffer(b"Housegarden12", np.uint8), frequent) == 11 / 13
    assert S.coverage(np.frombuffer(b"x", np.uint8), frequent) == 0


def test_candidates():
    text = f'é token = "{KEY}" and ordinarylongwords pwd: "hunter-two" 1234567890123456'
    assert [text[s:e] for s, e in sorted(S.candidates(text))] == [KEY, "hunter-two", "1234567890123456"]


def test_planted_secrets_on_the_test_table(spark):
    sf = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(i, *m.span(1)) for i, t in texts.items() for m in HEX.finditer(t)}
    out = S.op2_secret_forest(spark, sf).collect()
    assert len(out) == len(texts) and len(want) > 50
    got = {(r.doc_id, *map(int, x.split(":"))) for r in out for x in r.spans.split(",") if x}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.02 * len(want)
    assert sum(r.n_candidates for r in out) > 2 * len(want)


def test_odd_texts(spark, odd_texts):
    texts = [*odd_texts, f'token = "{KEY}"', f'token = "{KEY}"', "1" * 50_000, "call 1234567890123456", f"sha {KEY}", '"' * 5000, "a1" * 30_000, 'pwd="\U0001f600\U0001f600\U0001f600x12345"']
    docs = frame(spark, texts, ("found", "key", "path", "label", "s", "f"))
    docs = docs.unionByName(docs.where("doc_id < 3"))
    rows = S.scan_secrets(docs).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        assert [(x.s, x.e) for x in r.found] == sorted(S.candidates(texts[r.doc_id] or "")) and all(0 <= x.score <= 1 for x in r.found)
    assert S.scan_secrets(docs.limit(0)).count() == 0


def test_given_findings(spark):
    r = np.random.default_rng(2)
    texts = [f"item {r.integers(10**15, 10**16)}" if i % 2 else f"use {r.bytes(20).hex()} now" for i in range(60)]
    docs = frame(spark, texts)
    labelled = docs.where("doc_id < 40").select("doc_id", F.when(F.col("doc_id") % 2 == 1, 5).otherwise(4).cast("bigint").alias("s"), F.length("text").alias("n"), (1 - F.col("doc_id") % 2).cast("int").alias("label"))
    labelled = labelled.select("doc_id", "s", F.when(F.col("label") == 1, F.col("n") - 4).otherwise(F.col("n")).cast("bigint").alias("e"), "label")
    for x in S.scan_secrets(docs, labelled=labelled).collect():
        assert len(x.found) == 1 and (x.found[0].score >= 0.5) == (x.doc_id % 2 == 0)


def test_one_finding_copied_more_often_than_the_sample(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE", 100)
    each = [([float(i), 1.0], int(i >= 50)) for i in range(100) for _ in range(1 if i != 7 else 3000)]
    findings = spark.createDataFrame(each, "f array<double>, label int")
    first = findings.orderBy(F.xxhash64(F.col("f").cast("string"))).select("f").first().f
    findings = findings.unionByName(spark.range(200).select(F.array(*map(F.lit, first)).alias("f"), F.lit(int(first[0] >= 50)).alias("label")))
    score = S.forest(findings)
    out = {r.x: r.p for r in spark.range(100).select(F.col("id").alias("x"), score(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("p")).collect()}
    assert all(out[i] < 0.5 for i in range(45)) and all(out[i] >= 0.5 for i in range(55, 100))
