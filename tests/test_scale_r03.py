"""Plans of the jobs that failed or grew too fast on larger tables, and values that show they still do the whole job."""

from pyspark.sql import functions as F

from cellscore.operators import extract as ex
from cellscore.operators import points_log as pl
from cellscore.operators import worklist as wl
from cellscore.plans import raster
from cellscore.sources import masks as mk
from cellscore.sources import testbed as tb


def plan(df):
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def under(text, node):
    """For each line that names ``node``, the lines of the plan below it."""
    lines = text.split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    out = []
    for i, x in enumerate(lines):
        if node in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i + 1 : end]))
    return out


def price_frames(spark):
    prices = spark.createDataFrame([("a", 1.0, 2.0, 0.5), ("ab", 3.0, 4.0, 0.5), ("p/abc", 5.0, 6.0, 0.5)], "key string, input_per_m double, output_per_m double, batch_discount double")
    rows = [("m1", "p", "k", "abc", None, None), ("m2", "q", "k", "abc", None, None), ("m3", "q", "k", "x/ab", None, None), ("m4", "q", "k", "z", None, None), ("m5", "q", "k", None, None, None)]
    models = spark.createDataFrame(rows, "model_id string, provider string, kind string, name string, own_input double, own_output double")
    return models, prices


def test_price_lookup_does_not_broadcast_the_prefixes(spark, tmp_path):
    models, prices = price_frames(spark)
    models.write.parquet(str(tmp_path / "m"))  # its files' size is what Spark's estimate goes by
    models = spark.read.parquet(str(tmp_path / "m"))
    d = wl.price_lookup(models, wl.price_table(prices.limit(0), prices))
    assert not any("Generate explode" in x for x in under(plan(d), "BroadcastExchange"))
    assert {r.model_id: r.input_per_m for r in d.collect()} == {"m1": 5.0, "m2": 3.0, "m3": 3.0, "m4": None, "m5": None}
    over = prices.where(F.col("key") == "a")
    got = {r.model_id: (r.input_per_m, r.source) for r in wl.price_lookup(models, wl.price_table(over, prices)).collect()}
    assert got["m1"] == (1.0, "override") and got["m4"] == (None, None)


def test_burning_does_not_widen_with_the_layers(spark):
    def spans(n):
        k = F.col("id")
        return spark.range(n).select(k.cast("int").alias("layer_pos"), (k % 3 != 1).cast("int").alias("burn"), (k % 5).cast("int").alias("r"),
                                     (k * 7 % 50).cast("int").alias("c0"), F.least(F.lit(59), k * 7 % 50 + k % 11).cast("int").alias("c1"))

    few, many = mk.burnt(spans(3), 60), mk.burnt(spans(400), 60)
    assert plan(few).count("\n") == plan(many).count("\n") and max(map(len, plan(many).split("\n"))) < max(map(len, plan(few).split("\n"))) + 200
    want = {}
    for s in sorted(spans(400).collect()):
        want.update({(s.r, c): s.burn for c in range(s.c0, s.c1 + 1)})
    got = {(x.r, c) for x in many.collect() for c in range(x.c0, x.c1 + 1)}
    assert got == {at for at, burn in want.items() if burn}


def test_tables_of_a_few_rows_have_a_known_size(spark):
    for d in (tb.specs(spark), tb.runs(spark), tb.run_state(spark)):
        assert d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10_000
    assert [tuple(r) for r in tb.runs(spark).collect()] == tb.RUNS and tb.runs(spark).schema["n_samples_set"].dataType.simpleString() == "int"
    places = spark.range(100).select(F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("spec_id"), F.col("id").alias("place_id"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    good, _ = ex.prompt_table(places, tb.specs(spark))
    assert "Exchange hashpartitioning(spec_id" not in plan(good)


def test_first_token_steps_stand_once(spark):
    raw = '{"choices":[{"message":{"content":"<think>a</think> Land "},"logprobs":{"content":[{"token":"<think>a</think>"},{"token":" "},{"token":"Land","logprob":-0.1,"top_logprobs":[{"token":"La","logprob":-1.0},{"token":"La","logprob":-0.5}]}]}}]}'
    d = ex.response_normalise(spark.createDataFrame([(raw,), ("{}",), (None,)], "raw string"))
    optimized = d.select("logprobs")._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("(?s)^(.*</think>)") == 1
    assert [(r.answer, r.thinking, r.logprobs) for r in d.collect()] == [("Land", "a", {"La": -0.5, "Land": -0.1}), ("", None, None), ("", None, None)]


def test_latest_points_sort_only_late_attempts(spark, monkeypatch):
    rows = [(f"r{k % 3}", k % 7, None if k % 11 == 0 or k % 7 == 4 else f"1998-01-{1 + k % 20:02d}", (k * 37) % 101, k, None if k % 5 == 0 else k / 10) for k in range(400)]
    rows += [(None, 1, "1998-01-01", 1, 900, 0.5), (None, 1, "1998-01-03", 0, 901, 0.25), ("r0", None, None, 2, 902, None), ("r0", None, None, 1, 903, 1.0)]
    d = spark.createDataFrame(rows, "run_id string, idx int, day string, s int, k int, p double").select("run_id", "idx", F.col("day").cast("date").alias("updated_at"), F.struct("s", "k").alias("seq"), "k", "p")
    want, many = {}, {}
    for run, idx, day, s, k, p in rows:
        best = want.get((run, idx))
        if best is None or (day or "", s, k) > best[:3]:
            want[run, idx] = (day or "", s, k, p)
        many[run, idx] = many.get((run, idx), 0) + 1
    for buckets in (1, 4, pl.TIME_BUCKETS):  # also where several cells share a time
        monkeypatch.setattr(pl, "TIME_BUCKETS", buckets)
        got = {(x.run_id, x.idx): (x.k, x.p, x.attempts) for x in pl.latest_points(d, ["k", "p"]).collect()}
        assert got == {at: (*v[2:], many[at]) for at, v in want.items()}
    monkeypatch.undo()
    text = plan(pl.latest_points(d, ["k", "p"], counted=False))
    assert under(text, "SortAggregate") and all("BroadcastHashJoin" in x for x in under(text, "SortAggregate"))
    assert pl.late_attempts(d.where("run_id is not null and idx < 4 and updated_at is not null")).count() < 40


def test_image_metrics_reads_the_log_for_mask_and_points_only(spark, monkeypatch):
    read, table = [], tb.table
    monkeypatch.setattr(tb, "table", lambda *a: read.append(a[-1]) or table(*a))
    d = raster.image_metrics(spark, "/root/testdata/sf0.001")
    assert read == ["lineitem", "lineitem"] and d.count() == tb.N_RUNS


def test_score_all_joins_its_parts_without_an_exchange(spark, monkeypatch):
    def rows(*names):  # instead of the longest parts; the join of the parts is what is looked at
        return lambda *a: tb.runs(spark).select("run_id", *[F.lit(0.5).alias(n) for n in names])

    read, table = [], tb.table
    monkeypatch.setattr(tb, "table", lambda *a: read.append(a[-1]) or table(*a))
    monkeypatch.setattr(raster, "_tile_scores", rows("ssim", "prob_rmse"))
    monkeypatch.setattr(raster, "_boundary_scores", rows("boundary_f_2"))
    monkeypatch.setattr(raster.ra, "coastline_error", rows("coastline_error_deg"))
    d = raster.score_all(spark, "/root/testdata/sf0.001")
    text = plan(d)
    assert read == ["lineitem"] * 3  # points, mask, costs
    assert "BroadcastHashJoin" in text and not any(x in text for x in ("hashpartitioning", "Sort", "HashAggregate", "Window"))
    assert d.count() == 2 * tb.N_RUNS
