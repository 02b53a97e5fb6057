"""From response logs to answers: every job is a projection unless rows have to meet."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellscore.functions import text as tx
from cellscore.functions.common import flag, safe_div


def _mass(logprobs: Column, cls: str) -> Column:
    """Probability of all alternatives of a class; the map of a response has some twenty entries."""
    hits = F.filter(
        F.map_entries(logprobs),
        lambda e: (tx.token_class(e["key"]) == cls) & e["value"].isNotNull() & ~F.isnan(e["value"]),
    )
    return F.aggregate(
        hits, F.lit(0.0), lambda a, e: a + F.when(e["value"] > tx.MIN_LOGPROB, F.exp(e["value"])).otherwise(F.lit(0.0))
    )


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


ANSWER = ("p_land", "n_valid", "n_samples", "validity_mass")


def _parts(answer: Column) -> dict[str, Column]:
    return {n: answer[n] for n in ANSWER}


def _logprob_struct(logprobs: Column) -> Column:
    some = flag(F.size(logprobs) > 0)

    def of(m: Column) -> Column:
        p = F.when(some, safe_div(m["land"], m["land"] + m["water"]))
        mass = F.when(some, F.least(m["land"] + m["water"], F.lit(1.0)))
        return F.struct(p.alias("p_land"), p.isNotNull().cast("int").alias("n_valid"), F.lit(1).alias("n_samples"), mass.alias("validity_mass"))

    return once(F.struct(_mass(logprobs, "land").alias("land"), _mass(logprobs, "water").alias("water")), of)


def logprob_answer(logprobs: Column) -> dict[str, Column]:
    """p_land, n_valid, n_samples and validity_mass from first-token alternatives."""
    return _parts(_logprob_struct(logprobs))


def _sample_struct(texts: Column) -> Column:
    def of(said: Column) -> Column:
        land = F.size(F.filter(said, lambda a: a == "land"))
        valid = F.size(F.filter(said, lambda a: a.isNotNull()))
        return F.struct(safe_div(land, valid).alias("p_land"), valid.alias("n_valid"), F.size(said).alias("n_samples"), F.lit(None).cast("double").alias("validity_mass"))

    return once(F.transform(texts, tx.parse_answer), of)


def sample_answer(texts: Column) -> dict[str, Column]:
    """Share of land among the valid samples."""
    return _parts(_sample_struct(texts))


def _greedy_struct(texts: Column) -> Column:
    def of(a: Column) -> Column:
        p = F.when(a == "land", F.lit(1.0)).when(a == "water", F.lit(0.0))
        return F.struct(p.alias("p_land"), p.isNotNull().cast("int").alias("n_valid"), F.lit(1).alias("n_samples"), F.lit(None).cast("double").alias("validity_mass"))

    return once(tx.parse_answer(F.get(texts, F.lit(0))), of)


def greedy_answer(texts: Column) -> dict[str, Column]:
    return _parts(_greedy_struct(texts))


def extract(log: DataFrame) -> DataFrame:
    """Points from a response log with mode, texts, logprobs and error; mode auto is settled per row."""
    err = F.col("error").isNotNull()
    mode = F.when(
        F.col("mode") == "auto", F.when(flag(F.size("logprobs") > 0), F.lit("logprobs")).otherwise(F.lit("sample"))
    ).otherwise(F.col("mode"))
    none = F.lit(None).cast("double")
    x = F.when(err, F.struct(none.alias("p_land"), F.lit(0).alias("n_valid"), F.lit(0).alias("n_samples"), none.alias("validity_mass")))
    ways = {"logprobs": _logprob_struct(F.col("logprobs")), "sample": _sample_struct(F.col("texts")), "greedy": _greedy_struct(F.col("texts"))}
    for m, way in ways.items():
        x = x.when(F.col("mode") == m, way)
    d = log.withColumn("mode", mode).withColumn("_x", x)  # one way a row, evaluated once for all columns
    cols = _parts(F.col("_x"))
    answer = F.when(err, F.lit("")).otherwise(F.coalesce(F.substring(F.get("texts", F.lit(0)), 1, tx.ANSWER_TEXT_MAX), F.lit("")))
    cols["answer_text"] = answer
    cols["error"] = F.substring("error", 1, tx.ERROR_TEXT_MAX)
    return d.withColumns(cols).drop("_x")


def token_mass_merge(pieces: DataFrame) -> DataFrame:
    """Vocabulary pieces of a response by surface text, duplicates added as probabilities."""
    d = pieces.withColumn("surface", tx.surface(F.col("piece")))
    top = F.max("logprob")
    d = d.groupBy("response_id", "surface").agg(top.alias("m"), F.collect_list("logprob").alias("l"))
    total = F.aggregate("l", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m")))  # a few pieces a surface
    return d.select("response_id", "surface", (F.col("m") + F.log(total)).alias("logprob"))


TOKEN = T.StructType(
    [
        T.StructField("token", T.StringType()),
        T.StructField("logprob", T.DoubleType()),
        T.StructField(
            "top_logprobs",
            T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("logprob", T.DoubleType())])),
        ),
    ]
)
RESPONSE = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField(
            "choices",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("message", T.StructType([T.StructField("content", T.StringType())])),
                        T.StructField("finish_reason", T.StringType()),
                        T.StructField("logprobs", T.StructType([T.StructField("content", T.ArrayType(TOKEN))])),
                    ]
                )
            ),
        ),
        T.StructField(
            "usage",
            T.StructType(
                [
                    T.StructField("prompt_tokens", T.LongType()),
                    T.StructField("completion_tokens", T.LongType()),
                    T.StructField("completion_tokens_details", T.StructType([T.StructField("reasoning_tokens", T.LongType())])),
                ]
            ),
        ),
    ]
)
THINK_BLOCK = r"(?is)<think>(.*?)</think>"


def _think_struct(text: Column) -> Column:
    def of(x: Column) -> Column:
        rest, inner, low = x["rest"], x["inner"], F.lower(x["rest"])
        stray, unclosed = low.contains("</think>"), low.contains("<think>")
        before = F.trim(F.regexp_replace(rest, r"(?is)</think>(?!.*</think>).*$", ""))
        cut = F.instr(low, "<think>")
        after = F.trim(F.substr(rest, cut + 7))
        answer = (
            F.when(stray, F.regexp_replace(rest, r"(?is)^.*</think>", ""))
            .when(unclosed, F.substr(rest, F.lit(1), cut - 1))
            .otherwise(rest)
        )
        extra = lambda c: F.filter(F.array(c), lambda t: t != "")
        thoughts = F.when(stray, F.concat(extra(before), inner)).when(unclosed, F.concat(inner, extra(after))).otherwise(inner)
        return F.struct(F.regexp_replace(answer, r"^\s+|\s+$", "").alias("answer"), once(thoughts, lambda t: F.when(F.size(t) > 0, F.array_join(t, "\n\n"))).alias("thinking"))

    inner = F.filter(F.transform(F.regexp_extract_all(text, F.lit(THINK_BLOCK), 1), F.trim), lambda t: t != "")
    return once(F.struct(F.regexp_replace(text, THINK_BLOCK, "").alias("rest"), inner.alias("inner")), of)


def split_think(text: Column) -> tuple[Column, Column]:
    """(answer, thinking) of a raw text with think blocks, closed, unopened or unclosed."""
    x = _think_struct(text)
    return x["answer"], x["thinking"]


def first_token_logprobs(tokens: Column) -> Column:
    """Alternatives of the first token of the final answer, as a map.

    The answer starts after the last closing think tag, which may span tokens: tokens that begin
    before the end of the tag are counted in one pass over their lengths. Each step is evaluated once.
    """
    joined = F.lower(F.array_join(F.transform(tokens, lambda t: F.coalesce(t["token"], F.lit(""))), ""))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))

    def skip(end: Column) -> Column:
        return F.aggregate(
            tokens,
            zero,
            lambda a, t: F.struct(
                (a["at"] + F.length(F.coalesce(t["token"], F.lit("")))).alias("at"),
                (a["n"] + (a["at"] < end).cast("int")).alias("n"),
            ),
            lambda a: a["n"],
        )

    def first(n: Column) -> Column:
        rest = F.slice(tokens, n + 1, F.greatest(F.size(tokens), F.lit(1)))
        return F.get(F.filter(rest, lambda t: F.regexp_replace(F.coalesce(t["token"], F.lit("")), r"\s", "") != ""), F.lit(0))

    def tops(t: Column) -> Column:
        some = F.coalesce(t["top_logprobs"], F.array().cast(TOKEN["top_logprobs"].dataType))
        return F.filter(some, lambda a: a["token"].isNotNull() & a["logprob"].isNotNull())

    def entries(t: Column, tops: Column, names: Column) -> Column:
        best = F.transform(
            names,
            lambda n: F.struct(
                n.alias("token"),
                F.array_max(F.transform(F.filter(tops, lambda a: a["token"] == n), lambda a: a["logprob"])).alias("logprob"),
            ),
        )
        own = F.filter(
            F.array(F.struct(t["token"].alias("token"), t["logprob"].alias("logprob"))),
            lambda a: a["logprob"].isNotNull() & ~F.array_contains(names, a["token"]),
        )
        return F.map_from_entries(F.concat(best, own))

    def alternatives(t: Column) -> Column:
        return once(tops(t), lambda x: once(F.array_distinct(F.transform(x, lambda a: a["token"])), lambda names: entries(t, x, names)))

    end = F.length(F.regexp_extract(joined, r"(?s)^(.*</think>)", 1))
    out = once(once(once(end, skip), first), alternatives)
    return once(out, lambda m: F.when(F.size(m) > 0, m))


def response_normalise(raw: DataFrame) -> DataFrame:
    """Raw response documents (column ``raw``) to answer, thinking, alternatives, usage and version."""
    d = raw.withColumn("_j", F.from_json("raw", RESPONSE))
    choice = F.get("_j.choices", F.lit(0))
    d = d.withColumn("_t", _think_struct(F.coalesce(choice["message"]["content"], F.lit(""))))
    u = F.col("_j.usage")
    return d.withColumns(
        {
            "answer": F.col("_t.answer"),
            "thinking": F.col("_t.thinking"),
            "finish_reason": choice["finish_reason"],
            "logprobs": first_token_logprobs(choice["logprobs"]["content"]),
            "input_tokens": F.coalesce(u["prompt_tokens"], F.lit(0)),
            "output_tokens": F.coalesce(u["completion_tokens"], F.lit(0)),
            "thinking_tokens": F.coalesce(u["completion_tokens_details"]["reasoning_tokens"], F.lit(0)),
            "resolved_model": F.col("_j.model"),
        }
    ).drop("_j", "_t", "raw")


def error_kind(status: Column) -> Column:
    return (
        F.when(status == 429, F.lit("rate_limited"))
        .when(status.isin(408, 409, 425) | (status >= 500), F.lit("retryable"))
        .otherwise(F.lit("permanent"))
    )


# Forms of an HTTP date, and which groups are its day, month, year, time and zone.
HTTP_DATES = {
    r"^[A-Za-z]{3}, (\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}:\d{2}:\d{2}) (GMT|UTC|[+-]\d{4})$": (1, 2, 3, 4, 5),
    r"^[A-Za-z]{6,9}, (\d{2})-([A-Za-z]{3})-(\d{2}) (\d{2}:\d{2}:\d{2}) (GMT)$": (1, 2, 3, 4, 5),
    r"^[A-Za-z]{3} ([A-Za-z]{3}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4})()$": (2, 1, 4, 3, 5),
}


def retry_after_s(header: Column, header_ms: Column, now: Column) -> Column:
    """Seconds to wait: a number, an HTTP date (any of the three forms, or with an offset) against ``now``, or the
    millisecond header."""
    floor = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))  # noqa: E731  (greatest skips NULL)
    text = F.trim(header)
    secs = floor(text.try_cast("double"))
    day = F.lit(None).cast("string")
    for form, order in HTTP_DATES.items():
        parts = [F.regexp_extract(text, form, i) for i in order]
        zone = F.when(parts[-1].rlike(r"^[+-]\d{4}$"), parts[-1]).otherwise(F.lit("+0000"))
        day = F.when(text.rlike(form), F.concat_ws(" ", *parts[:-1], zone)).otherwise(day)
    date = F.coalesce(*[F.try_to_timestamp(day, F.lit(f"d MMM {year} HH:mm:ss xx")) for year in ("yyyy", "yy")])
    wait = floor(date.cast("double") - now.cast("timestamp").cast("double"))
    return F.coalesce(secs, wait, header_ms.try_cast("double") / 1000.0)


def batch_reconcile(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests of a batch with their results; one without is an error. custom_id is p<idx>."""
    ask = requests.withColumn("custom_id", F.concat(F.lit("p"), F.col("idx").cast("string")))
    d = ask.join(results, ["run_id", "custom_id"], "left")
    lost = F.when(F.col("result_id").isNull(), F.lit("no result in the batch"))
    return d.withColumn("error", F.coalesce("error", lost))


def prompt_table(places: DataFrame, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prompts, rejects): one prompt per (spec, place); bad latitudes and templates are set aside."""
    d = places.join(specs, "spec_id")
    ok = F.col("lat").between(-90, 90) & tx.valid_template(F.col("template"))
    prompt = tx.render_prompt(F.col("template"), F.col("lat"), F.col("lon"), F.col("coord_format"))
    return d.where(ok).withColumn("prompt", prompt), d.where(~ok)


#: Prompts and system texts in; answers out, either texts alone or a frame with ``text`` and any of the other SCORED columns.
Scorer = Callable[[pd.Series, pd.Series], "pd.Series | pd.DataFrame"]
SCORED = {"text": "string", "logprobs": "map<string,double>", "input_tokens": "int", "output_tokens": "int", "thinking_tokens": "int", "finish_reason": "string", "error": "string"}


def batch_scoring(prompts: DataFrame, scorer: Scorer, batch: int = 256) -> DataFrame:
    """Log rows of a user's scorer for every prompt (run_id, idx, prompt, system_prompt): answer, first-token logprobs, usage, seconds
    per prompt and error. The scorer gets at most ``batch`` prompts at a time; if it raises, these prompts get its message as
    their error and the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for k in range(0, len(frame), batch):
                b = frame.iloc[k : k + batch].reset_index(drop=True)
                out, began = b[["run_id", "idx"]].copy(), time.monotonic()
                try:
                    got = scorer(b["prompt"], b["system_prompt"])
                    got = got if isinstance(got, pd.DataFrame) else pd.DataFrame({"text": got})
                    if len(got) != len(b):
                        raise ValueError(f"{len(got)} answers to {len(b)} prompts")
                except Exception as e:  # noqa: BLE001  a user's function
                    got = pd.DataFrame({"error": [f"{type(e).__name__}: {e}"[:500]] * len(b)})
                for name in SCORED:
                    out[name] = got[name].to_numpy() if name in got else None
                out["latency_s"] = (time.monotonic() - began) / max(len(b), 1)
                yield out

    d = prompts.select("run_id", "idx", "prompt", "system_prompt").repartition("run_id", "idx")
    return d.mapInPandas(run, "run_id string, idx int, " + ", ".join(f"{k} {v}" for k, v in SCORED.items()) + ", latency_s double")
