import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cellscore.llm import pii

from .conftest import frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        twice = [int(x) * (1 + i % 2) for i, x in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    out = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in out)
    return tuple(sum(x[0] == k for x in out) for k in PATTERNS), hashlib.sha256(joined.encode()).hexdigest(), {f"{k}:{s}:{e}" for k, s, e in out}


PERSONAL = [
    "a.b@c.de and x_y%z@mail-1.example.com. é@ü.de ünï@x.y", "a@b.c_d@e.f.g..h@i.j a@b @c.d a@b.c.@d.ef", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 9999999999999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 3", "+1 (555) 555-0199 +49.30.1234 +1 ) + 12345678 +123456789012345678 +1-2", "\U0001f600 +44 20 7946 0958 ́ 8.8.8.8",
    "call (030) 555-1234 or jo [at] site.org, fe80:0:0:1:2:3:4:5", "a" * 20000 + "@" + "b." * 3000 + "c", "1 " * 9000, "+" + "1 " * 4000, "1." * 6000, "@" * 3000, "5105105105105100 " * 40,
]


def check(df, texts):
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, digest, base = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == n and r.base_sha256 == digest
        spans = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert base <= set(r.spans.split(",")) and len(set(spans)) == len(spans)
        assert [(pii.KINDS.index(k), int(s)) for k, s, _ in spans] == sorted((pii.KINDS.index(k), int(s)) for k, s, _ in spans)
        assert all(0 <= int(s) < int(e) <= len(texts[r.doc_id]) for _, s, e in spans)


@pytest.fixture
def run(spark, tmp_path):
    def go(docs):
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        return pii.op6_personal_data(spark, str(tmp_path))

    return go


def test_odd_texts(spark, odd_texts, run):
    texts = [*odd_texts, *PERSONAL]
    check(run(frame(spark, texts, ("_text", "_base", "kind", "m", "s"))), texts)


def test_no_candidates(spark, run):
    check(run(frame(spark, [None, "", "no"])), [None, "", "no"])


def test_empty_table(spark, run):
    assert run(frame(spark, ["a"]).limit(0)).collect() == []


def test_test_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = pii.op6_personal_data(spark, sf)
    check(out, texts)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, pii.op6_personal_data(spark, sf).collect()))


def test_redact(spark):
    df = spark.createDataFrame([("é call a@b.c now", [(0, 7, 12), (3, 9, 12)]), ("x", [])], "text string, spans array<struct<kind:int,s:int,e:int>>")
    assert [r[0] for r in df.select(pii.redact(F.col("text"), F.col("spans"))).collect()] == ["é call <email> now", "x"]


def test_thresholds_over_all_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE", 300)
    runs = " ".join(f"no {1000000 + 7919 * i}" for i in range(20))
    texts = [f"{runs} tel +49 30 12345{i:03d}" + (f" mail a{i}@example.org" if i % 20 < 3 else "") for i in range(400)]
    spans = pii.spans_of(frame(spark, texts))
    c = pii.train(spans)[1]
    assert set(c) == set(range(len(pii.KINDS))) and all(0 < x <= 1 for x in c.values())
    assert c[pii.KINDS.index("ip")] == c[pii.KINDS.index("card")]  # no labels of their own: the mean of all


def test_stretches_of_a_run(spark):
    texts = ["7536784127813050 4845168114407329", "+49 30 1234567 4111 1111 1111 1111", "1 " * 3000, "call 030 (555) 1234567/8"]
    rows = {r.doc_id: r for r in pii.spans_of(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        got = {(x.kind, x.s, x.e) for x in rows[i]._more}
        assert all(t[x.s : x.e] == x.m for x in rows[i]._more) and len(got) == len(rows[i]._more)
        groups = [m.span() for m in re.finditer("[+(]?[0-9]+", t)]
        for kind, (low, high) in ((2, (12, 19)), (3, (7, 15))):
            want = {(kind, s, e) for k, (s, _) in enumerate(groups) for _, e in groups[k : k + 19] if low <= len(re.sub("[^0-9]", "", t[s:e])) <= high}
            assert {x for x in got if x[0] == kind} == want


def test_neighbours_with_only_a_blank_between(spark, run):
    def card(i):
        d = f"4{i * 7919 % 10**14:014d}"
        return d + next(c for c in "0123456789" if valid("card", d + c))

    around = ["{}", "see {} there", "card {} now", "{} there", "see {}"]
    texts = [around[i % 5].format(x) for i in range(150) for x in (card(i), 10**15 + 7919 * i, f"+49 30 {10**6 + 57919 * i}")]
    texts += [f"{card(900)} {card(901)}", f"+49 30 1234567 {card(902)}"]
    out = {r.doc_id: set(r.spans.split(",")) for r in run(frame(spark, texts)).collect()}
    assert {"card:0:16", "card:17:33"} <= out[450] and {"phone:0:14", "card:15:31"} <= out[451]


def test_a_text_of_very_many_matches(spark, run):
    """1 MB with 20,000 addresses and as many numbers takes seconds; every base span is found."""
    import time

    text = " ".join(f"user{i}@host{i % 97}.example.org +49 30 {10**6 + i}" for i in range(20_000))
    docs = frame(spark, [text, "one a@b.cd", *[f"call +49 30 {10**6 + i} or a{i}@b.cd" for i in range(60)]])
    began = time.monotonic()
    out = {r.doc_id: r for r in run(docs).collect()}
    assert time.monotonic() - began < 60 and (out[0].n_email, out[0].n_phone) == (20_000, 20_000)
    assert brute(text)[1] == out[0].base_sha256 and brute(text)[2] <= set(out[0].spans.split(","))


def test_context_of_candidates(spark):
    text = "call me on mobile 030 123 4567 or fax: (040) 7654321, mail a@b.cd or c@d.ef"
    row = pii.spans_of(frame(spark, [text])).first()
    for x in row._more:
        before = text[max(0, x.s - 24) : x.s]
        assert x.b == before[len(before) - len(x.b) :] and x.a == text[x.e : x.e + 1]
        assert x.m == text[x.s : x.e] and x.label == float(any((y.kind, y.s, y.e) == (x.kind, x.s, x.e) for y in row._base))
    assert any(x.label for x in row._more) and any("mobile" in x.b for x in row._more)
