"""Jobs on response logs: parse, classify, reconcile, prompt and score."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from cellscore.functions import text as tx
from cellscore.functions.common import count_if, rounded
from cellscore.operators import extract as ex
from cellscore.operators import points_log as pl
from cellscore.plans.log import all_cells
from cellscore.sources import testbed as tb
from cellscore.sources.grid import with_cell

ANSWER_COLUMNS = ("p_land", "n_valid", "n_samples", "validity_mass")


def _only(mode: str, way):
    def job(spark, sf):
        d = tb.responses(spark, sf).where(F.col("error").isNull() & (F.col("mode") == mode))
        return rounded(d.select("event_id", "run_id", "idx", *[c.alias(n) for n, c in way().items()]))

    return job


def extract_auto(spark, sf):
    d = ex.extract(tb.responses(spark, sf))
    return rounded(d.select("event_id", "run_id", "idx", "mode", *ANSWER_COLUMNS, "answer_text", "error"))


def strip_thinking(spark, sf):
    d = tb.responses(spark, sf).select("event_id", F.posexplode("texts").alias("j", "text"))
    return d.select("event_id", "j", tx.strip_thinking(F.col("text")).alias("final_text"), tx.parse_answer(F.col("text")).alias("answer"))


def token_mass_merge(spark, sf):
    e, k = tb.table(spark, sf, "events"), F.col("event_id")
    pieces = e.select(
        k.alias("response_id"),
        F.explode(
            F.array(*[F.struct(tb._pick(tb.PIECES, k + j).alias("piece"), F.lit(-(0.5 + 0.25 * j)).alias("logprob")) for j in range(5)])
        ).alias("x"),
    ).select("response_id", "x.*")
    return rounded(ex.token_mass_merge(pieces))


def response_normalise(spark, sf):
    d = ex.response_normalise(tb.raw_responses(spark, sf))
    total = F.aggregate(F.map_values("logprobs"), F.lit(0.0), lambda a, x: a + x)
    return rounded(
        d.select(
            "event_id", "answer", "thinking", "finish_reason", "input_tokens", "output_tokens", "thinking_tokens", "resolved_model",
            F.when(F.col("logprobs").isNotNull(), F.size("logprobs")).alias("n_alternatives"), total.alias("sum_logprob"),
        )
    )


def error_taxonomy(spark, sf):
    k = F.col("event_id")
    secs = F.when(k % 4 == 0, (k % 30 - 3).cast("string"))
    date = F.when(k % 4 == 1, F.date_format(F.date_add(F.to_date("ts"), 1), "EEE, dd MMM yyyy 00:00:00 'GMT'"))
    ms = F.when(k % 4 == 2, (k % 5000).cast("string"))
    d = tb.responses(spark, sf).where(F.col("status").isNotNull())
    wait = F.when(F.col("status") == 429, ex.retry_after_s(F.coalesce(secs, date), ms, F.col("ts")))
    d = d.withColumn("kind", ex.error_kind(F.col("status"))).withColumn("retry_after_s", wait)
    return rounded(
        d.groupBy("run_id").agg(
            *[count_if(F.col("kind") == x).alias(f"n_{x}") for x in ("rate_limited", "retryable", "permanent")],
            F.count("retry_after_s").alias("n_with_retry_after"),
            F.sum("retry_after_s").alias("sum_retry_after_s"),
        )
    )


def batch_reconcile(spark, sf):
    r = tb.responses(spark, sf)
    asked = r.select("run_id", "idx").distinct()
    got = r.where(F.col("event_id") % 5 != 4).groupBy("run_id", "idx").agg(
        F.max("event_id").alias("result_id"), F.max_by("error", "event_id").alias("error"),
        F.max_by("input_tokens", "event_id").alias("input_tokens"), F.max_by("output_tokens", "event_id").alias("output_tokens"),
    )
    got = got.withColumn("custom_id", F.concat(F.lit("p"), F.col("idx").cast("string"))).drop("idx")
    d = ex.batch_reconcile(asked, got).join(tb.runs(spark), "run_id")
    cost = (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1e6 * 0.5
    return rounded(d.select("run_id", "idx", "error", cost.alias("cost_usd")), 9)


def prompt_table(spark, sf):
    good, bad = ex.prompt_table(tb.places(spark, sf), tb.specs(spark))
    rejects = bad.withColumn("prompt", F.lit(None).cast("string"))
    return good.unionByName(rejects).select("place_id", "spec_id", "prompt")


def _fixed_rule(prompt: pd.Series, system: pd.Series) -> pd.DataFrame:
    """A stand-in for a model: land where the first number of the prompt is between -35 and 35; it fails beyond 80 degrees."""
    lat = prompt.str.extract(r"(-?\d+\.\d+)")[0].astype(float)
    land = lat.between(-35, 35)
    far = lat.abs() > 80
    return pd.DataFrame(
        {
            "text": land.map({True: "Land", False: "Water"}).where(~far, None),
            "logprobs": [None if f else {"Land": -0.25 if x else -2.0, "Water": -2.0 if x else -0.25} for x, f in zip(land, far)],
            "input_tokens": prompt.str.len(),
            "output_tokens": (~far).astype(int),
            "error": far.map({True: "out of range", False: None}),
        }
    )


def batch_scoring(spark, sf):
    """Prompts of all missing points, answered by a fixed rule: log rows, with the answer and the probability read from them."""
    todo = pl.missing_points(all_cells(spark), tb.points(spark, sf, "error"))
    d = with_cell(todo, tb.STEP).withColumn("system_prompt", F.lit(""))
    d = d.withColumn("prompt", tx.render_prompt(F.lit("{lat}, {lon}?"), F.col("lat"), F.col("lon"), F.lit("signed_decimal")))
    out = ex.batch_scoring(d, _fixed_rule)
    p = ex.logprob_answer(F.col("logprobs"))["p_land"]
    return rounded(out.select("run_id", "idx", tx.parse_answer(F.col("text")).alias("answer"), p.alias("p_land"), "input_tokens", "output_tokens", "error", (F.col("latency_s") >= 0).alias("timed")))


QUERIES = {
    "extract_greedy": _only("greedy", lambda: ex.greedy_answer(F.col("texts"))),
    "extract_sample": _only("sample", lambda: ex.sample_answer(F.col("texts"))),
    "extract_logprobs": _only("logprobs", lambda: ex.logprob_answer(F.col("logprobs"))),
    "extract_auto": extract_auto,
    "strip_thinking": strip_thinking,
    "token_mass_merge": token_mass_merge,
    "response_normalise": response_normalise,
    "error_taxonomy": error_taxonomy,
    "batch_reconcile": batch_reconcile,
    "prompt_table": prompt_table,
    "batch_scoring": batch_scoring,
}
