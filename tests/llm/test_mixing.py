import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellscore.llm import mixing
from cellscore.llm.mixing import land, mix_sources, mixed_documents, op11_source_mix, step

from .conftest import frame

BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    for c in BLANKS:
        text = (text or "").replace(c, " ")
    return len([x for x in text.split(" ") if x])


def goals(rows):
    """source -> (words, target), by sharing the excess again and again. rows: (doc_id, text, source)."""
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += words(text)
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(size.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            return {s: (size[s], capped.get(s, share.get(s))) for s in order}
        capped |= {s: 2.0 * size[s] for s in over}


def check(rows, out, near):
    """``near``: words by which a source may miss its target, given the sizes of its documents."""
    goal = goals(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.source or "") for r in out) == sorted((i is None, i or 0, words(t), s or "") for i, t, s in rows)
    taken, size, copies = defaultdict(int), defaultdict(list), defaultdict(int)
    for r in out:
        assert r.source_size == goal[r.source][0] and r.target == pytest.approx(goal[r.source][1], rel=1e-9)
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + 1) and r.taken == r.copies * r.size <= 2 * r.size or r.copies <= 2 and abs(rate - round(rate)) < 1e-9
        taken[r.source] += r.taken
        copies[r.source] += r.copies
        size[r.source].append(r.size)
    for s, (n, target) in goal.items():
        assert abs(taken[s] - target) <= near(size[s]), (s, taken[s], target, sorted(size[s])[-20:])
        if n:
            assert abs(copies[s] - target / n * len(size[s])) <= mixing.HELD + 2
    return taken


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(0, 5000)), min_size=3, max_size=3), st.floats(0, 0.999))
def test_a_step_keeps_both_totals(units, u):
    p, s = [x[0] for x in units], [x[1] for x in units]
    q = step(p, s, u)
    assert all(0 <= x <= 1 for x in q) and any(x in (0, 1) for x in q)
    assert sum(q) == pytest.approx(sum(p), abs=1e-6) and sum(x * n for x, n in zip(q, s)) == pytest.approx(sum(x * n for x, n in zip(p, s)), abs=1e-3)


def test_steps_keep_expectations():
    r, p, s = random.Random(1), [0.3, 0.6, 0.5], [10, 500, 77]
    runs = [step(p, s, r.random()) for _ in range(20_000)]
    for i in range(3):
        assert sum(x[i] for x in runs) / len(runs) == pytest.approx(p[i], abs=0.01)


def test_landing_is_the_nearest_corner():
    assert land([0.5, 0.5, 0.5], [10, 20, 30]) in ([0, 0, 1], [1, 1, 0]) and land([], []) == []


def test_odd_texts(spark, odd_texts):
    texts = [*odd_texts, *["one two three"] * 40, *[" ".join("w" * n) for n in range(1, 60)]]
    docs = frame(spark, texts, ("size", "taken", "p", "target", "h", "copies"))
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.selectExpr("cast(null as bigint) doc_id", "text", "lang", "'empty' source", "n_chars", "size", "taken", "p", "target", "h", "copies").where("text is null or text = ''"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    out = mix_sources(docs).collect()
    check(rows, out, lambda sizes: max(sizes) / 2 + 1)
    assert {r.source for r in out} == {"src0", "src1", None, "empty"} and all(r.target == 0 for r in out if r.source == "empty")
    assert mix_sources(docs.limit(0)).collect() == []
    assert all(r.taken == 0 for r in mix_sources(docs.where("text is null")).collect())


def test_levels_reruns_and_copies(spark, monkeypatch):
    """A source of many groups, so that open documents pass several levels; other partitions give the same mix."""
    monkeypatch.setattr(mixing, "GROUP", 16)
    monkeypatch.setattr(mixing, "FAN", 4)
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * int(r.paretovariate(1.1) * 20)), "hot" if i % 3 else f"s{i % 4}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = sorted(mix_sources(docs).collect())
    check(rows, out, lambda sizes: 0.002 * sum(sizes) + 3)
    assert sorted(mix_sources(docs.repartition(7)).collect()) == out
    mixed = mixed_documents(docs, mix_sources(docs))
    assert mixed.columns == docs.columns and mixed.count() == sum(x.copies for x in out)


def test_test_table(spark):
    for sf, near in (("sf0.01", lambda sizes: 0.01 * sum(sizes)), ("sf0.1", lambda sizes: 0.0005 * sum(sizes))):
        rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
        check(rows, op11_source_mix(spark, f"/root/testdata/{sf}").collect(), near)
