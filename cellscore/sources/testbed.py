"""The provided test tables read as the tables of this engine.

``lineitem`` is the attempt log (and, by vote, the truth mask), ``events`` the response log,
``orders`` the history of runs, ``part`` the registry of models and prices, ``customer`` polygons.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellscore.sources.grid import with_cell

STEP = 4.0
N_CELLS = 4050
N_RUNS = 8
MASK_H, MASK_W = 180, 360

# run, variant, mode, n_samples, vendor, release date, forced thinking, thinking, repeat, price in, price out
RUNS = [
    ("r0", "m0@effort=low", "sample", 4, "v0", "2024-03-01", False, True, 0, 0.5, 2.0),
    ("r1", "m0@effort=high", "sample", 4, "v0", "2024-03-01", False, True, 0, 0.5, 2.0),
    ("r2", "m1", "sample", 4, "v1", "2024-06-15", False, False, 0, 4.0, 20.0),
    ("r3", "m1@effort=high", "sample", 4, "v1", "2024-06-15", False, True, 0, 4.0, 20.0),
    ("r4", "m2", "logprobs", 1, "v2", "2025-01-20", False, False, 0, 0.15, 0.6),
    ("r5", "m2", "logprobs", 1, "v2", "2025-01-20", False, False, 1, 0.15, 0.6),
    ("r6", "m3", "greedy", 1, "v2", "2025-04-02", False, False, 0, 1.0, 5.0),
    ("r7", "m4", "greedy", 1, "v3", "2025-09-09", True, True, 0, None, None),
]
RUN_FIELDS = (
    "run_id string, variant string, extraction_mode string, n_samples_set int, vendor string, "
    "release_date string, forced_thinking boolean, thinking boolean, repeat_idx int, "
    "price_in double, price_out double"
)


# Spec, status, runner version and provider of the runs.
RUN_STATE = [
    ("r0", "s0", "complete", "1.2.0", "p0"), ("r1", "s0", "complete", "1.2.0", "p0"), ("r2", "s0", "failed", "1.2.0", "p1"), ("r3", "s0", "complete", "1.3.0", "p1"),
    ("r4", "s0", "paused", "1.3.0", "p2"), ("r5", "s0", "complete", "1.3.0", "p2"), ("r6", "s0", "complete", "1.3.1", "p2"), ("r7", "s1", "running", "1.3.1", "p0"),
]


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows, made from Arrow columns: Spark then knows how small it is, and need not bring all rows that share
    one of its keys into one task."""
    fields = T._parse_datatype_string(schema)
    return spark.createDataFrame(pa.table({f.name: [r[i] for r in rows] for i, f in enumerate(fields)}), fields)


def run_state(spark: SparkSession) -> DataFrame:
    return few_rows(spark, RUN_STATE, "run_id string, spec_id string, status string, runner_version string, provider string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, as it lies in its files at every size."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession) -> DataFrame:
    return few_rows(spark, RUNS, RUN_FIELDS)


def true_class(idx: Column, lat: Column, lon: Column) -> Column:
    land = ((F.abs(lat) < 40) & (lon > -20) & (lon < 40)) | (lat < -65)
    return F.when(land, F.lit(1)).otherwise(F.lit(0))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt log: one row per call, several per cell."""
    return attempts_of(table(spark, sf_dir, "lineitem"))


def attempts_of(li: DataFrame) -> DataFrame:
    """Attempts from line items, batch or stream."""
    run_no = (F.col("l_suppkey") % N_RUNS).cast("int")
    d = li.select(
        F.concat(F.lit("r"), run_no.cast("string")).alias("run_id"),
        run_no.alias("run_no"),
        ((F.col("l_partkey") * 37 + F.col("l_orderkey") * 11 + F.col("l_linenumber")) % N_CELLS)
        .cast("int")
        .alias("idx"),
        F.col("l_shipdate").alias("updated_at"),
        F.struct("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice").alias("seq"),
        "l_linenumber",
        "l_returnflag",
        "l_linestatus",
        "l_quantity",
        "l_extendedprice",
    )
    d = with_cell(d, STEP)
    failed = (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R")
    empty = (F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 7)
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint") % 100
    t0 = true_class(F.col("idx"), F.col("lat"), F.col("lon"))
    said = F.when(cents < 5 + 5 * F.col("run_no"), 1 - t0).otherwise(t0)
    p = F.rint((F.lit(0.5) + (2 * said - 1) * (F.lit(0.05) + F.col("l_quantity") * 0.009)) * 10000) / 10000
    logprobs = F.col("run_no").isin(4, 5)
    n_set = F.when(F.col("run_no") < 4, F.lit(4)).otherwise(F.lit(1))
    return d.select(
        "run_id",
        "idx",
        "updated_at",
        "seq",
        F.when(~(failed | empty), p).alias("p_land"),
        F.when(failed, F.concat(F.lit("HTTP 500: server error "), (F.col("l_quantity") % 3).cast("int").cast("string")))
        .alias("error"),
        F.when(failed, F.lit(0)).otherwise(n_set).alias("n_samples"),
        F.when(failed | empty, F.lit(0)).otherwise(n_set).alias("n_valid"),
        F.when(logprobs & ~(failed | empty), F.rint((F.lit(0.3) + F.col("l_quantity") * 0.014) * 10000) / 10000)
        .alias("validity_mass"),
        F.when(F.col("l_linenumber") == 6, F.lit("length"))
        .when((F.col("l_linenumber") == 5) & (F.col("l_returnflag") == "A"), F.lit("MAX_TOKENS"))
        .otherwise(F.lit("stop"))
        .alias("finish_reason"),
        (F.floor((F.round(F.col("l_extendedprice") * 100).cast("bigint") + 500) / 1000) / 10000).alias("latency_s"),
        (F.lit(50) + F.col("l_linenumber")).cast("int").alias("input_tokens"),
        (F.col("l_quantity").cast("int") + 2).alias("output_tokens"),
        F.when(F.col("run_no").isin(0, 1, 3, 7), F.col("l_linenumber") * 10)
        .otherwise(F.lit(0))
        .cast("int")
        .alias("thinking_tokens"),
    )


def place(points: DataFrame) -> DataFrame:
    """Add place, weight and truth, which all follow from the cell number."""
    d = with_cell(points, STEP)
    truth = F.when(F.col("idx") % 97 != 5, true_class(F.col("idx"), F.col("lat"), F.col("lon")))
    return d.withColumn("truth", truth)


def points(spark: SparkSession, sf_dir: str, *payload: str) -> DataFrame:
    """Points table: the last attempt of every (run, cell). Only the named columns are carried; ``attempts``, the number of
    attempts, is one that may be named."""
    from cellscore.operators.points_log import latest_points

    cols = [c for c in payload if c != "attempts"] or ["p_land"]
    return place(latest_points(attempts(spark, sf_dir), cols, "attempts" in payload))


ALL_PAYLOAD = (
    "p_land",
    "error",
    "n_samples",
    "n_valid",
    "validity_mass",
    "finish_reason",
    "latency_s",
    "input_tokens",
    "output_tokens",
    "thinking_tokens",
)


def base_land(r: Column, c: Column) -> Column:
    lat = F.lit(90.0) - (r + F.lit(0.5))
    lon = F.lit(-180.0) + (c + F.lit(0.5))
    main = (F.abs(lat) < 36 + (c * 7) % 9) & (lon > -20 - (r % 4)) & (lon < 40 + (r % 3))
    south = lat < -65 + (c % 3)
    island = r.between(60, 66) & ((c < 5) | (c >= 355))
    return main | south | island


def masks(spark: SparkSession) -> DataFrame:
    return few_rows(spark, [("mask",)], "mask_id string")


def mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth mask, 180 x 360: a drawn coast, with pixels turned over where the log votes for it."""
    n = MASK_H * MASK_W
    li = table(spark, sf_dir, "lineitem")
    pix = (F.col("l_partkey") * 131 + F.col("l_orderkey") * 17 + F.col("l_linenumber") * 7) % n
    votes = (
        li.groupBy(pix.alias("pix"))
        .agg(F.sum(F.when(F.col("l_quantity") >= 49, F.lit(1)).otherwise(F.lit(-1))).alias("v"))
        .select("pix", (F.col("v") > 0).alias("turned"))
    )
    d = spark.range(n).withColumnRenamed("id", "pix").join(votes, "pix", "left")
    r, c = F.floor(F.col("pix") / MASK_W).cast("int"), (F.col("pix") % MASK_W).cast("int")
    d = d.select(r.alias("r"), c.alias("c"), F.coalesce("turned", F.lit(False)).alias("turned"))
    return d.select(
        F.lit("mask").alias("mask_id"), "r", "c", (base_land(F.col("r"), F.col("c")) != F.col("turned")).alias("land")
    )


# Comparisons as stored: name, ordered runs, when saved. Re-using a name replaces the earlier set.
COMPARISONS = [
    ("all", ["r0", "r1", "r2", "r3", "r4", "r5", "r6", "r7"], "2025-10-01 10:00:00"),
    ("sampled", ["r3", "r7"], "2025-10-02 10:00:00"),
    ("sampled", ["r3", "r1", "r2", "r0"], "2025-10-03 10:00:00"),
    ("late", ["r5", "r2", "r4", "r7"], "2025-10-04 10:00:00"),
]


def comparisons(spark: SparkSession) -> DataFrame:
    return few_rows(spark, COMPARISONS, "name string, run_ids array<string>, saved_at string")


def comparison_runs(spark: SparkSession) -> DataFrame:
    from cellscore.operators.points_log import comparison_members

    return comparison_members(comparisons(spark))


def attempt_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts with their price: NULL where the run has no price."""
    priced = runs(spark).select("run_id", "price_in", "price_out")
    cost = (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1e6
    return attempts(spark, sf_dir).join(priced, "run_id").withColumn("cost_usd", cost)


def run_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempt_costs(spark, sf_dir).groupBy("run_id").agg(F.sum("cost_usd").alias("cost_usd"))


GRAY_SIZE = 128


def rgba_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square colour image made from the log; pixels nobody wrote are black."""
    n = GRAY_SIZE * GRAY_SIZE
    pix = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_linenumber")) % n
    seen = table(spark, sf_dir, "lineitem").groupBy(pix.alias("pix")).agg(
        F.max("l_quantity").alias("q"), F.count("*").alias("n"), F.max("l_linenumber").alias("ln")
    )
    d = spark.range(n).withColumnRenamed("id", "pix").join(seen, "pix", "left")
    r = F.floor(F.col("pix") / GRAY_SIZE).cast("int")
    land = F.when(((r + F.col("pix") % GRAY_SIZE) % 64) < 24, F.lit(80)).otherwise(F.lit(0))
    return d.select(
        F.lit("upload").alias("image_id"),
        r.alias("r"),
        (F.col("pix") % GRAY_SIZE).cast("int").alias("c"),
        (F.coalesce(F.col("q") * 3, F.lit(0.0)) + land).cast("int").alias("red"),
        (F.coalesce(F.col("n") * 5 % 100, F.lit(0)) + land).cast("int").alias("green"),
        (F.coalesce(F.col("ln") * 10, F.lit(0)) + land).cast("int").alias("blue"),
        (F.lit(255) - F.coalesce(F.col("ln") * 4, F.lit(0))).cast("int").alias("alpha"),
    )


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polygon per customer: three or four corners, every fourth with a hole; 50 neighbouring keys are a layer, so
    that shapes of a layer overlap."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    layer = F.floor(k / 50).cast("int")
    x0 = (F.lit(-165) + k * 37 % 330).cast("double") + 0.25
    y0 = (F.lit(-75) + k * 53 % 150).cast("double") + 0.125
    size = (F.lit(2) + F.abs(F.col("c_acctbal")).cast("bigint") % 9).cast("double")

    def ring(s: Column) -> Column:
        pt = lambda dx, dy: F.struct((x0 + dx * s).alias("x"), (y0 + dy * s).alias("y"))
        square = F.array(pt(-1, -1), pt(1, -1), pt(1, 1), pt(-1, 1))
        diamond = F.array(pt(0, -1), pt(1, 0), pt(0, 1), pt(-1, 0))
        triangle = F.array(pt(-1, -1), pt(1, -1), pt(0, 1))
        line = F.array(pt(-1, -1), pt(1, 1))
        kind = F.col("c_nationkey") % 4
        return F.when(kind == 0, square).when(kind == 1, diamond).when(kind == 2, triangle).otherwise(
            F.when(k % 8 == 3, line).otherwise(square)
        )

    outer = c.select(layer.alias("layer_pos"), (layer % 3 != 1).cast("int").alias("burn"), k.cast("int").alias("shape_id"),
                     F.lit(0).alias("ring_no"), ring(size).alias("ring"))
    hole = c.where(k % 4 == 0).select(
        layer.alias("layer_pos"), (layer % 3 != 1).cast("int").alias("burn"), k.cast("int").alias("shape_id"),
        F.lit(1).alias("ring_no"), ring(size / 2).alias("ring"))
    return outer.unionByName(hole)


N_MODELS_IN_LOG = 300


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of runs, one per order."""
    o, k, m = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey") % N_MODELS_IN_LOG
    status = F.element_at(
        F.array(*[F.lit(s) for s in ("queued", "running", "paused", "complete", "failed")]), (k % 5 + 1).cast("int")
    )

    def key(rep: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit("h"), m.cast("string"), rep.cast("string")))

    done = k % 5 == 3
    return o.select(
        F.md5(F.concat(F.lit("run:"), k.cast("string"))).alias("run_id"),
        key(k % 4).alias("run_hash"),
        key((k + 1) % 4).alias("plan_hash"),
        F.concat(F.lit("s"), (k % 3).cast("string")).alias("spec_id"),
        F.concat(F.lit("m"), m.cast("string")).alias("model_id"),
        F.element_at(F.array(F.lit("logprobs"), F.lit("sample"), F.lit("greedy")), (k % 3 + 1).cast("int")).alias("extraction_mode"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(done, F.date_add("o_orderdate", (k % 50).cast("int")).cast("timestamp_ntz")).alias("ended_at"),
        F.when(k % 3 != 0, F.concat(F.lit("v"), (k % 11).cast("string"))).alias("resolved_version"),
        F.when(k % 13 != 0, F.col("o_totalprice") / 100000).alias("cost_usd"),
        (k % 4).cast("int").alias("repeat_idx"),
        (k * 7 % (N_CELLS + 1)).cast("int").alias("n_points_done"),
        F.concat(F.lit("r"), (k % N_RUNS).cast("string")).alias("points_of"),
    )


# Answer texts and first tokens that exercise every parsing rule, Unicode white space among them.
ANSWERS = [
    "water",
    "LAND!",
    "\u2003Land",
    "Land\u00a0of course",
    "water\u3000",
    "«Water»",
    "(water) since it is the open sea",
    "1. Land",
    "It is land",
    "waterfall",
    "land-locked",
    "<think>far from any coast</think>water",
    "<reasoning>x</reasoning>\n<reasoning>y</reasoning>\nLand",
    "<thinking>not finished, maybe water",
    "<|channel|>analysis<|message|>far out<|end|><|channel|>final<|message|>water<|end|>",
    "no idea",
    "\u2009\u00a0",
    "",
]
TOKENS = ["water", "WATER", " wat", "\nland", "Ġwa", "▁lan", "*Land", "“water", "land!", "water…", "la\n", "wateR,", "l", "w", "la nd",
          "lander", "wet", "no", " ", "ocean"]
PIECES = ["Land", "ĠLand", " Land", "▁Water", " Water", "Ċ"]
SHORT_ANSWERS = ["Land", "Water", " Water.", "land, yes"]
MODES = ["sample", "sample", "sample", "sample", "logprobs", "logprobs", "greedy", "auto"]


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response log: texts, first-token alternatives, usage, HTTP errors."""
    e, k, run = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id") % 8
    bad = F.col("event_type") == "error"
    has_lp = run.isin(4, 5) | ((run == 7) & (k % 2 == 0))
    alts = F.map_from_arrays(
        F.array(*[_pick(TOKENS, k * 3 + j * 4) for j in range(5)]), F.array(*[F.lit(-(0.5 + 0.25 * j)) for j in range(5)])
    )
    return e.select(
        k.alias("event_id"),
        F.concat(F.lit("r"), run.cast("string")).alias("run_id"),
        ((k * 131 + F.col("user_id")) % N_CELLS).cast("int").alias("idx"),
        "ts",
        _pick(MODES, run).alias("mode"),
        F.when(~bad, F.array(*[_pick(ANSWERS, k * 7 + j * 5) for j in range(4)])).alias("texts"),
        F.when(~bad & has_lp, alts).alias("logprobs"),
        F.when(bad, F.when(k % 3 == 0, 429).when(k % 3 == 1, 500).otherwise(404)).alias("status"),
        F.when(bad, F.concat(F.lit("HTTP "), F.when(k % 3 == 0, "429").when(k % 3 == 1, "500").otherwise("404"))).alias("error"),
        (50 + k % 9).cast("int").alias("input_tokens"),
        (2 + k % 5).cast("int").alias("output_tokens"),
    )


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw response documents with think blocks that are closed, absent, stray or cut off."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    word, tok, kind = _pick(SHORT_ANSWERS, k), _pick(TOKENS, k * 5 + 1), k % 4
    tops = F.array(
        *[F.struct(_pick(TOKENS, k * 3 + j * 4).alias("token"), F.lit(-(0.5 + 0.25 * j)).alias("logprob")) for j in range(5)]
    )
    none = F.slice(tops, 1, 0)
    plain = lambda t: F.struct(F.lit(t).alias("token"), F.lit(-0.01).alias("logprob"), none.alias("top_logprobs"))
    own = F.struct(tok.alias("token"), F.lit(-0.1).alias("logprob"), tops.alias("top_logprobs"))
    tokens = (
        F.when(kind == 0, F.array(plain("<think>"), plain("hm"), plain("</"), plain("think>"), plain(" "), own))
        .when(kind == 1, F.array(own))
        .when(kind == 2, F.array(plain("hm "), plain("</think>"), plain("\n"), own))
        .otherwise(F.array(plain("<think>"), plain("hm")))
    )
    content = (
        F.when(kind == 0, F.concat(F.lit("<think>hm</think>"), word))
        .when(kind == 1, word)
        .when(kind == 2, F.concat(F.lit("hm </think>\n"), word))
        .otherwise(F.lit("<think>hm"))
    )
    choice = F.struct(
        F.struct(content.alias("content")).alias("message"),
        F.lit("stop").alias("finish_reason"),
        F.struct(tokens.alias("content")).alias("logprobs"),
    )
    usage = F.struct(
        (50 + k % 9).alias("prompt_tokens"),
        (2 + k % 5).alias("completion_tokens"),
        F.struct((k % 3).alias("reasoning_tokens")).alias("completion_tokens_details"),
    )
    doc = F.struct(F.concat(F.lit("v"), (k % 3).cast("string")).alias("model"), F.array(choice).alias("choices"), usage.alias("usage"))
    return e.select("event_id", F.to_json(doc).alias("raw"))


SPECS = [
    ("s0", "hemisphere", "What is at {coord}? Keep {this}."),
    ("s1", "signed_decimal", "At {lat}, {lon} ({lat:+08.2f} | {lon:.0f} | {lat:6.1f}): {coord}"),
    ("s2", "dms", "Place {coord}"),
    ("s3", "dms", "No place at all, {lat} only"),
]


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place per order; some latitudes are out of range, some longitudes have to be wrapped."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("place_id"),
        F.concat(F.lit("s"), (k % 4).cast("string")).alias("spec_id"),
        ((k * 3700 % 18201 - 9050) / 100.0).alias("lat"),
        ((F.col("o_custkey") * 2500 % 43000 - 21500) / 100.0).alias("lon"),
    )


def specs(spark: SparkSession) -> DataFrame:
    return few_rows(spark, SPECS, "spec_id string, coord_format string, template string")


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model registry, one per part; many share a name."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.concat_ws(
        "-", F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))), F.lower("p_type"), F.col("p_size").cast("string")
    )
    provider = F.concat(F.lit("p"), (k % 7).cast("string"))
    model_id = F.concat(F.lit("m"), k.cast("string"))
    return p.select(
        model_id.alias("model_id"),
        provider.alias("provider"),
        F.when(k % 7 == 6, F.lit("ollama")).otherwise(F.concat(F.lit("kind"), (k % 3).cast("string"))).alias("kind"),
        name.alias("name"),
        F.when(k % 4 == 0, F.concat(F.lit("rv"), (k % 9).cast("string"))).alias("resolved_version"),
        F.when(F.col("p_size") % 10 == 0, F.lit("q4")).alias("quant"),
        F.when(k % 50 == 3, F.lit(1.5)).alias("own_input"),
        F.when(k % 50 == 3, F.lit(6.0)).alias("own_output"),
        F.concat(provider, F.lit("/"), model_id, F.lit("#"), F.substring(F.md5(name), 1, 8)).alias("store_id"),
    )


def price_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(override, default) price entries: full names, name families and provider-bound names."""
    p, k = models(spark, sf_dir), F.substring("model_id", 2, 20).cast("bigint")
    family, brand = F.substring_index("name", "-", 2), F.substring_index("name", "-", 1)
    key = F.when(k % 4 == 0, F.col("name")).when(k % 4 == 1, family).when(k % 4 == 2, F.concat_ws("/", "provider", "name")).otherwise(brand)
    rows = (
        p.select(key.alias("key"), (k % 4 >= 2).alias("over"), k.alias("k"))
        .groupBy("key", "over")
        .agg((F.min("k") % 90 / 10 + 0.1).alias("input_per_m"), (F.max("k") % 90 / 2 + 0.5).alias("output_per_m"))
        .withColumn("batch_discount", F.lit(0.5))
    )
    return rows.where("over").drop("over"), rows.where(~F.col("over")).drop("over")


def model_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as users write them, one per customer, in five forms."""
    m = models(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    d = c.withColumn("model_id", F.concat(F.lit("m"), F.col("k").cast("string"))).join(m, "model_id")
    ref = (
        F.when(F.col("k") % 5 == 0, F.col("model_id"))
        .when(F.col("k") % 5 == 1, F.concat_ws("/", "provider", "model_id"))
        .when(F.col("k") % 5 == 2, F.concat_ws("/", "provider", "name"))
        .when(F.col("k") % 5 == 3, F.col("name"))
        .otherwise(F.concat(F.lit("unknown-"), F.col("k").cast("string")))
    )
    return d.select("k", ref.alias("ref"))


def asked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run ids as typed: whole, prefixes of three letters and more, and some that do not exist."""
    k = F.col("c_custkey")
    h = F.md5(F.concat(F.lit("run:"), k.cast("string")))
    text = F.when(k % 11 == 0, h).when(k % 13 == 0, F.concat(F.lit("zz"), h)).otherwise(F.expr("substring(_h, 1, 3 + cast(c_custkey % 6 as int))"))
    return table(spark, sf_dir, "customer").withColumn("_h", h).select(text.alias("prefix")).distinct()


def plan_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with the configuration each customer asks for; one row per repeat."""
    c = table(spark, sf_dir, "customer")
    seg, n, k = F.col("c_mktsegment"), F.col("c_nationkey"), F.col("c_custkey")
    d = c.select(
        k.alias("k"),
        F.concat(F.lit("m"), k.cast("string")).alias("model_id"),
        F.when(seg == "BUILDING", "low").when(seg == "AUTOMOBILE", "high").when(seg == "HOUSEHOLD", "off").when(seg == "FURNITURE", "xhigh").alias("effort"),
        F.when(n % 2 == 1, F.lit(0.7)).alias("temperature"),
        F.when(n % 3 == 0, F.lit(3)).alias("n_samples"),
        F.lit(None).cast("int").alias("top_logprobs"),
        F.when(n == 5, F.lit(5000)).alias("max_output_tokens"),
        _pick(["auto", "logprobs", "sample", "greedy"], n).alias("requested"),
        F.when(n % 2 == 0, F.lit("Answer in one word.")).alias("system_prompt"),
        (k % 17 == 0).alias("forced_thinking"),
        F.explode(F.sequence(F.lit(0), n % 3)).alias("repeat_idx"),
    )
    d = d.join(models(spark, sf_dir), "model_id")
    prov = F.col("provider")
    return d.withColumns(
        {
            "position": F.col("k") * 10 + F.col("repeat_idx"),
            "label": F.concat(F.col("model_id"), F.lit("#"), F.col("repeat_idx").cast("string")),
            "cell_hash": F.md5(F.concat_ws(":", F.lit("h"), (F.col("k") % N_MODELS_IN_LOG).cast("string"), F.col("repeat_idx").cast("string"))),
            "has_logprobs": F.when(prov.isin("p0", "p1", "p2"), True).when(prov.isin("p3", "p4"), False),
            "top_logprobs_cap": F.when(prov == "p1", F.lit(5)),
            "use_batch": prov == "p2",
            "spec_id": F.concat(F.lit("s"), (F.col("k") % 3).cast("string")),
            "pilot_of": F.when(F.col("k") % 5 == 2, F.concat(F.lit("r"), (F.col("k") % N_RUNS).cast("string"))),
            "thinking": F.col("forced_thinking") | (F.col("effort").isNotNull() & (F.col("effort") != "off")),
            "spec_temperature": F.lit(1.0),
            "spec_n_samples": F.lit(4),
        }
    )


def calls_of(e: DataFrame) -> DataFrame:
    """Calls with provider, outcome and tokens from events, batch or stream."""
    return e.select(
        F.concat(F.lit("r"), (F.col("user_id") % 8).cast("string")).alias("run_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"),
        "ts",
        F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("ok"),
        (F.lit(52) + F.col("event_id") % 9 + F.col("event_id") % 5).alias("tokens"),
    )
