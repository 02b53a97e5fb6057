"""Canonical documents and keys of content."""

import json

from pyspark.sql import functions as F

from cellscore.functions import documents as dc
from cellscore.operators import worklist as wl

NESTED = '{"b": [{"Password": 1, "z": {"my_API_KEY_2": [1], "k": null}}, [{"secretive": {}}, 2]], "a": {"d": 1.50, "c": "ü"}}'


def test_canonical_text():
    assert dc.canonical_text(NESTED) == '{"a":{"c":"ü","d":1.5},"b":[{"z":{"k":null}},[{},2]]}'
    assert dc.canonical_text(NESTED, without_nulls=True, paths=("a.c", "b[].z.k")) == '{"a":{"d":1.5},"b":[{"z":{}},[{},2]]}'
    assert json.loads(dc.canonical_text(NESTED, scrub=False)) == json.loads(NESTED)
    assert dc.canonical_text('{"x": 4, "y": {"x": 4, "z": true}}', floats=("x", "z")) == '{"x":4.0,"y":{"x":4.0,"z":true}}'
    assert dc.canonical_text("no json") is None and dc.canonical_text(None) is None and dc.canonical_text("[]") == "[]"


def test_documents_of_columns(spark):
    d = spark.createDataFrame([(1, 'a "b"\n', None), (2, None, 0.5)], "i int, t string, x double")
    inner = dc.document(t=F.col("t"))
    got = [r[0] for r in d.orderBy("i").select(dc.document({"in": inner, "none": F.lit(None).cast("string")}, i=F.col("i"), x=F.col("x"))).collect()]
    assert [json.loads(x) for x in got] == [{"in": {"t": 'a "b"\n'}, "none": None, "i": 1, "x": None}, {"in": {"t": None}, "none": None, "i": 2, "x": 0.5}]
    texts = spark.createDataFrame([(NESTED,), ("{",), (None,)], "t string")
    assert [r[0] for r in texts.select(dc.canonical(F.col("t"))).collect()] == [dc.canonical_text(NESTED), None, None]


def key_of(spark, f, *docs):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(docs)], "i int, doc string")
    return [r[0] for r in d.orderBy("i").select(f(F.col("doc"))).collect()]


def test_equal_specs_have_one_key(spark):
    a, b, c = key_of(
        spark,
        lambda x: wl.spec_key(x, F.lit("h")),
        '{"id": "s1", "grid": {"step_deg": 4, "placement": "center"}, "mask": {"path": "/a", "rule": "r"}}',
        '{"mask": {"rule": "r"}, "grid": {"placement": "center", "step_deg": 4.0}, "name": "other"}',
        '{"mask": {"rule": "r"}, "grid": {"placement": "corner", "step_deg": 4.0}}',
    )
    assert a == b != c
    assert key_of(spark, lambda x: wl.spec_key(x, F.lit("other mask")), '{"mask": {"rule": "r"}, "grid": {"placement": "center", "step_deg": 4.0}}')[0] != a


def test_what_changes_a_run_changes_its_key(spark):
    base = dict(spec="s", provider="p", model="m", quant=None, version=None, config='{"temperature": 1, "rpm": 5, "headers": {"Authorization": "x"}}', mode="sample", repeat_idx=0)
    other = [{"provider": "q"}, {"quant": "q4"}, {"version": "v1"}, {"config": '{"temperature": 0.5}'}, {"mode": "greedy"}, {"repeat_idx": 1}, {"spec": "t"}, {"model": "n"}]
    same = [{"version": "m"}, {"config": '{"headers": {}, "temperature": 1.0, "effort": null}'}, {"config": '{"max_concurrency": 2, "headers": {"bearer": 1}, "temperature": 1}'}]
    rows = [(i, *{**base, **x}.values()) for i, x in enumerate([{}, *same, *other])]
    d = spark.createDataFrame(rows, "i int, spec string, provider string, model string, quant string, version string, config string, mode string, repeat_idx int")
    keys = [r[0] for r in d.orderBy("i").select(wl.run_key(*[F.col(n) for n in base])).collect()]
    assert len(set(keys[: len(same) + 1])) == 1 and len(set(keys)) == 1 + len(other) and None not in keys
