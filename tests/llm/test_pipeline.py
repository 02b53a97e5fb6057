import sys
from pathlib import Path

import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P  # noqa: E402
from cellscore.llm import quality  # noqa: E402

from . import test_decontaminate, test_jaccard, test_lines  # noqa: E402
from .conftest import frame  # noqa: E402
from .test_bpe import WANT, ids  # noqa: E402

SF = "/root/testdata/sf0.01"


def stages(spark, docs, tmp_path, sf_dir=SF):
    out = []
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        out.append((before, docs))
        if k < 4:
            assert docs.columns == before.columns and [x.dataType for x in docs.schema] == [x.dataType for x in before.schema]
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, two, three, four, five = stages(spark, docs, tmp_path)

    chain = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = sorted(r for r in rows(docs) if quality.scores(chain, pa.array([r[1]]))[0] >= 0.3)
    assert sorted(rows(one[1])) == kept and 0.8 * docs.count() < len(kept) < docs.count()

    import hashlib

    left = {r[0]: r[3] for r in test_lines.brute(kept)}
    got = dict(rows(two[1]))
    assert all(hashlib.sha256(t.encode()).hexdigest() == left[i] for i, t in got.items())
    assert all(left[i] in (hashlib.sha256(b"\n" * n).hexdigest() for n in range(50)) for i, _ in kept if i not in got)
    assert all(r.n_chars == len(r.text) for r in two[1].collect())

    assert sorted(r[0] for r in rows(three[1])) == sorted(i for i, _, c in test_jaccard.brute(rows(two[1]), 5, 80) if i == c)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r[0] for r in test_decontaminate.brute(rows(three[1]), items) if not r[5]]
    assert sorted(r[0] for r in rows(four[1])) == sorted(clean) and len(clean) < three[1].count()

    for r in five[1].collect():
        assert bytes(r.ids) == ids(r.text) and WANT.decode_bytes(list(memoryview(bytes(r.ids)).cast("I"))) == r.text.encode() and r.n_tokens == len(r.ids) // 4
    assert sorted(map(str, P.run(spark, SF).collect())) == sorted(map(str, five[1].collect()))


def test_odd_texts_and_clashing_columns(spark, odd_texts, tmp_path):
    names = ("score", "key", "d", "size", "gram", "items", "spans", "a", "id")
    docs = frame(spark, odd_texts, names)
    out = stages(spark, docs.unionByName(docs.where("doc_id < 9")), tmp_path)
    assert all(r.key == 7 and r.id == 7 for r in out[-1][1].collect())
    assert any(r.text is None for r in out[3][1].collect())
    none = tmp_path / "none"
    none.mkdir()
    assert stages(spark, docs.limit(0), none)[-1][1].count() == 0


def test_near_duplicates_by_five_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = sorted((r.doc_id, test_jaccard.shingles(r.text, 5)) for r in docs.collect())
    root = {i: i for i, _ in sets}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and root[i] != root[j] and 100 * (both := len(a & b)) >= 80 * (len(a) + len(b) - both):
                p, q = sorted((root[i], root[j]))
                root = {x: p if r == q else r for x, r in root.items()}
    assert sorted(r.doc_id for r in P.without_near_duplicates(spark, docs, SF).collect()) == [i for i in root if root[i] == i]


def test_pair_at_80_percent_of_five_words(spark):
    a = " ".join(f"w{i}" for i in range(48))  # 44 shingles of five words, 45 of four
    b = " ".join(["x0 x1 x2 x3 x4", *(f"w{i}" for i in range(4, 48))])
    one, two = ([test_jaccard.shingles(x, n) for x in (a, b)] for n in (5, 4))
    assert 0.8 <= len(one[0] & one[1]) / len(one[0] | one[1]) and len(two[0] & two[1]) / len(two[0] | two[1]) < 0.85
    assert [r.doc_id for r in P.without_near_duplicates(spark, frame(spark, [a, b]), SF).collect()] == [0]
