import math

from cellscore.llm import licenses as L

from .conftest import frame
from .test_decontaminate import words


def brute(rows):
    """As op4: every beginning of every template is tried."""
    texts = {i: words(t) for i, t in rows}
    n = len(texts)
    df = {w: sum(w in t for t in texts.values()) for w in L.vocabulary()}
    idf = {w: math.log((n + 1) / (df[w] + 1)) + 1.0 for w in df}
    out = []
    for i, w in texts.items():
        at, base, other, best = [], set(), set(), 0.0
        for phrase, label in L.BASE:
            p = phrase.split()
            own = [s for s in range(len(w)) if w[s : s + len(p)] == p]
            at += own
            base |= {label} if own else set()
        for text, key, label in L.TEMPLATES:
            t, k = text.split(), key.split()
            o = next(j for j in range(len(t)) if t[j : j + len(k)] == k)
            whole = sum(idf[x] for x in t)
            for s in range(-len(t), len(w)):
                if s + o < 0 or w[s + o : s + o + len(k)] != k:
                    continue
                same = [0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(t)]
                anchors = [j for _, j in L.indexed(t, idf, L.ANCHORS)]
                cover = sum(idf[x] / whole for x, y in zip(t, same) if y)
                if sum(same[j] for j in anchors) >= 2 and cover >= L.COVERAGE:
                    other.add(label)
                    best = max(best, cover)
        score = 1.0 if base else min(1.0, best)
        out.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | other)), round(score, 9)))
    return sorted(out)


def got(df):
    return sorted((*r[:7], round(r[7], 9)) for r in map(tuple, df.collect()))


def run(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return got(L.op4_license_scan(spark, str(tmp_path)))


def test_odd_texts(spark, odd_texts, tmp_path):
    texts = [
        *odd_texts, "The MIT License, the mit-license. MIT LICENSE", "Licensed under CC BY-NC-SA 4.0.", "GNU  Lesser\nGeneral Public License and the GNU General Public License, version 3",
        "Licensed under the Apache License, Version 2.0 (the License)", "license " * 5000, "apache license", "Apache License, Version 1.0", "mit einer license", "creative commons attribution sharealike",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of that program", "cc", "by cc by", "licensed under a gnu general public license version 2", "All rights reserved",
    ]
    want = brute(enumerate(texts))
    assert {x for r in want for x in r[6].split(",")} >= {"apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl", "cc-by-nc-sa", "mit", "cc-by-sa"}
    assert run(spark, tmp_path, frame(spark, texts, ("_words", "_at", "base", "w"))) == want


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, frame(spark, ["a"]).limit(0)) == []


def test_test_table(spark):
    sf = "/root/testdata/sf0.01"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert any(r[2] for r in want) and got(L.op4_license_scan(spark, sf)) == want
