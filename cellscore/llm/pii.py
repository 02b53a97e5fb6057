"""Personal data: generated candidates, boosted trees and calibrated thresholds, with DataFrame functions only.

* **Base spans** follow fixed formats (see ``BASE``) and always stay.
* **Candidates** come from looser generators that may overlap each other and the base spans: anything around an at sign
  or a spelt one, dotted and colon-separated groups, and of runs of digits with separators each stretch of consecutive groups
  whose digits fit (proposed as phone and as card).
* **Boosted trees** (the ML library's, trained in the JVM on at most ``SAMPLE`` candidates, those with the smallest
  hashes, of all documents) score each candidate by its format and what stands around it. Candidates that are base
  spans are labelled; the others are not negative but unlabelled.
* **Calibration.** With labelled and unlabelled examples the score of a true span is about c times its probability, c
  being the mean score of labelled ones (of documents held out from training, by kind; a kind without any has the mean of
  all). A candidate is selected if score / c is at least ``THRESHOLD``; without held-out labels nothing is added.

The trees become one SQL expression that is evaluated in the row, so finding needs no exchange. Null texts count as
empty; repeated rows each get their row; only doc_id and text are read. Places are code points, the end exclusive.
The patterns start only where a match can start and give nothing back, places are running sums and equal spans are found
by sorting, so that long runs and texts of many matches take little more than linear time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.llm.store import read_table, written

KINDS = ["email", "ip", "card", "phone"]
SAMPLE, TREES, DEPTH, THRESHOLD, SEED = 20_000, 12, 4, 0.5, 7

#: The contract's patterns, written so that they don't backtrack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Generators: kinds proposed for each match, and its pattern.
GENERATORS = {
    "around": (["email"], r"(?:\G|(?<![A-Za-z0-9._%+'-]))[A-Za-z0-9._%+'-]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[^\x20\x09-\x0D@<>(),;\x22]++"),
    "groups": (["ip"], r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,5}+(?:[.:][0-9A-Fa-f]{1,5}+){2,8}+"),
    "digits": (["card", "phone"], r"[+(]?[0-9](?:[\x20().:/-]{0,2}[0-9]){6,}+"),
}

#: How many digits a candidate of a kind may have.
DIGITS = {"card": (12, 19), "phone": (7, 15)}

CALLS = "tel|phone|fax|call|mail|contact|mobile|card|visa|pay|host|server|addr|login"
CODES = "token|key|secret|sha|hash|order|invoice|version|isbn|id"
SPAN = "struct<kind:int,s:int,e:int,m:string,b:string,a:string>"
CHUNK, CONTEXT = 256, 24
EMPTY = f"array<{SPAN}>"


def none() -> Column:
    return F.array().cast(EMPTY)


def named(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def starts(gaps: Column, matches: Column) -> Column:
    """Where each match begins: the running sum of the lengths of gaps and matches. Sums are kept in chunks, so that an
    array that grows has ``CHUNK`` entries and not as many as there are matches."""
    steps = F.zip_with(gaps, matches, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
    ints, lists = "array<int>", "array<array<int>>"

    def one(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["p"]
        return F.struct((s + x["m"]).alias("at"), F.concat(acc["s"], F.array(s)).cast(ints).alias("s"))

    def chunk(steps: Column) -> Callable[[Column, Column], Column]:
        def add(acc: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(steps, k, F.lit(CHUNK)), F.struct(acc["at"].alias("at"), F.array().cast(ints).alias("s")), one)
            return named(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["s"], F.array(x["s"])).cast(lists).alias("s")))

        return add

    def over(steps: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(lists).alias("s"))
        return F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(steps), F.lit(CHUNK)), zero, chunk(steps))["s"])

    return named(steps, over)


def located(pattern: str, matches: Column, kind: int) -> Column:
    """The matches of ``pattern`` in the text with their places and what stands around them, up to the neighbouring
    matches: they lie between the parts of a split by the pattern."""
    between = F.split("_text", pattern, -1)

    def spans(parts: Column) -> Column:
        gaps, after = F.slice(parts, 1, F.size(matches)), F.slice(parts, 2, F.size(matches))
        at = F.arrays_zip(starts(gaps, matches).alias("s"), matches.alias("m"), F.transform(gaps, lambda p: F.right(p, F.lit(CONTEXT))).alias("b"), F.transform(after, lambda p: F.left(p, F.lit(1))).alias("a"))
        return F.transform(at, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a")))

    return F.when(F.size(matches) > 0, named(between, spans)).otherwise(none())


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right counts twice, less 9 if over 9; the sum is a multiple of 10."""

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(F.reverse(digits), i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def holds(kind: str, m: Column) -> Column:
    """What a match of the base pattern must fulfil besides."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: F.coalesce(x.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(digits_of(m)).between(16, 19) & luhn(digits_of(m))
    if kind == "phone":
        return F.length(digits_of(m)).between(8, 15)
    return F.lit(True)


def fulfils(kind: str) -> Callable[[Column], Column]:
    return lambda x: holds(kind, x["m"])


def possible(kind: str) -> Callable[[Column], Column]:
    low, high = DIGITS.get(kind, (0, 1 << 30))
    return lambda x: F.length(digits_of(x["m"])).between(low, high)


def of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def stretches(run: Column) -> Column:
    """The stretches of consecutive groups of digits in a run: at most 19 from each group on, as each has a digit."""
    most = max(high for _, high in DIGITS.values())

    def of(chars: Column) -> Column:
        digit = lambda i: F.coalesce(F.get(chars, i).between("0", "9"), F.lit(False))
        places = F.sequence(F.lit(0), F.size(chars) - 1)
        starts = F.filter(places, lambda i: digit(i) & ~digit(i - 1))
        ends = F.filter(places, lambda i: digit(i) & ~digit(i + 1))

        def span(s: Column, e: Column) -> Column:
            begin = s - F.coalesce(F.get(chars, s - 1).isin("+", "("), F.lit(False)).cast("int")
            m = F.array_join(F.slice(chars, begin + 1, e - begin + 1), "")
            near = F.array_join(F.slice(chars, F.greatest(F.lit(1), begin - CONTEXT + 1), F.least(begin, F.lit(CONTEXT))), "")
            before = F.right(F.concat(F.when(begin < CONTEXT, run["b"]).otherwise(F.lit("")), near), F.lit(CONTEXT))
            after = F.coalesce(F.get(chars, e + 1), run["a"])
            return F.struct(F.lit(0).alias("kind"), (run["s"] + begin).alias("s"), (run["s"] + e + 1).alias("e"), m.alias("m"), before.alias("b"), after.alias("a"))

        return named(ends, lambda ends: F.flatten(F.transform(starts, lambda s, k: F.transform(F.slice(ends, k + 1, most), lambda e: span(s, e)))))

    return F.filter(named(F.split(run["m"], ""), of), lambda x: F.length(digits_of(x["m"])) <= most)


def as_kind(kind: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(kind).alias("kind"), *[x[c].alias(c) for c in ("s", "e", "m", "b", "a")])


def marked(base: Column, more: Column) -> Column:
    """The different spans of ``more`` by kind and place, with ``label``: 1 for those that are also in ``base``.

    Equal spans are neighbours once both are sorted, the one of ``base`` first."""
    of = lambda tag: lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(tag).alias("tag"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a"))

    def labelled(both: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            last = F.get(both, i - 1)
            same = F.coalesce(same_span(x, last), F.lit(False))
            return F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a"), (same & (last["tag"] == 0)).cast("double").alias("label"), ((x["tag"] == 1) & ~(same & (last["tag"] == 1))).alias("own"))

        return F.filter(F.transform(both, one), lambda x: x["own"])

    return named(F.array_sort(F.concat(F.transform(base, of(0)), F.transform(more, of(1)))), labelled)


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, _base and _more: the base spans, and the generated ones with what stands around them and their label."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    digit = F.col("_text").rlike("[0-9]")
    may = {
        "email": F.col("_text").contains("@"), "phone": F.col("_text").contains("+") & digit, "ip": digit, "card": digit,
        "around": F.col("_text").rlike(r"@|[\[(](?:at|AT)[\])]"), "groups": F.col("_text").rlike(r"[0-9A-Fa-f][.:][0-9A-Fa-f]"), "digits": digit,
    }
    patterns = {**BASE, **{k: p for k, (_, p) in GENERATORS.items()}}
    found = [F.when(may[k], F.regexp_extract_all("_text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"_m_{k}") for k, p in patterns.items()]
    rows = rows.select("doc_id", "_text", *found)
    base = [F.filter(located(BASE[k], F.col(f"_m_{k}"), i), fulfils(k)) for i, k in enumerate(KINDS)]
    rows = rows.select("doc_id", "_text", F.concat(*base).alias("_base"), *[located(p, F.col(f"_m_{g}"), 0).alias(f"_g_{g}") for g, (_, p) in GENERATORS.items()])
    runs = F.flatten(F.transform("_g_digits", stretches)).alias("_g_digits")
    rows = rows.select("doc_id", "_text", "_base", *[runs if g == "digits" else f"_g_{g}" for g in GENERATORS])
    more = [F.filter(F.transform(f"_g_{g}", as_kind(KINDS.index(k))), possible(k)) for g, (kinds, _) in GENERATORS.items() for k in kinds]
    rows = rows.select("doc_id", "_base", F.concat(*more).cast(EMPTY).alias("_more"))
    plain = F.transform("_base", lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "s", "e", "m")]))
    return rows.select("doc_id", plain.alias("_base"), marked(F.col("_base"), F.col("_more")).alias("_more"))


FEATURES = ["kind", "length", "digits", "letters", "separators", "dots", "at", "plus", "longest", "groups", "kinds_of_digit", "before", "after", "calls", "codes", "start", "luhn"]


def features(x: Column) -> Column:
    """Format and context of a candidate, in the order of FEATURES."""
    m = x["m"]
    count = lambda p: F.length(m) - F.length(F.regexp_replace(m, p, ""))
    runs = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    around, after = F.lower(x["b"]), x["a"]
    sort = lambda c: F.when(c.rlike("[A-Za-z]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"[\x20\x09-\x0D]"), 3).when(c == "", 4).otherwise(5)
    values = [
        x["kind"], F.length(m), count("[0-9]"), count("[A-Za-z]"), count(r"[\x20().:/-]"), count(r"\."), count("@"), m.startswith("+").cast("int"), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)),
        F.size(runs), F.size(F.array_distinct(F.split(digits_of(m), ""))), sort(F.right(around, F.lit(1))), sort(after), around.rlike(CALLS).cast("int"), around.rlike(CODES).cast("int"), (x["s"] == 0).cast("int"),
        F.when(x["kind"] == KINDS.index("card"), luhn(digits_of(m)).cast("int")).otherwise(0),
    ]
    return F.array(*[v.cast("double") for v in values])


def same_span(a: Column, b: Column) -> Column:
    return (a["kind"] == b["kind"]) & (a["s"] == b["s"]) & (a["e"] == b["e"])


def as_expression(model) -> Callable[[Column], Column]:
    """The model's probability as a function of the features' column."""

    def tree(node, f: Column) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(F.get(f, F.lit(split.featureIndex())) <= float(split.threshold()), tree(node.leftChild(), f)).otherwise(tree(node.rightChild(), f))

    def score(f: Column) -> Column:
        total = F.lit(0.0)
        for t, w in zip(model.trees, model.treeWeights):
            total = total + tree(t._java_obj.rootNode(), f) * float(w)
        return 1 / (1 + F.exp(-2 * total))

    return score


def train(spans: DataFrame):
    """The score of a candidate's features, and c of each kind; None if the sample has labels of one kind only."""
    more = F.transform("_more", lambda x: F.struct(features(x).alias("f"), x["kind"].alias("kind"), x["s"].alias("s"), x["label"].alias("label")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0

    def rows(docs: DataFrame) -> DataFrame:
        return docs.where(F.size("_more") > 0).select("doc_id", F.explode(more).alias("x")).select("doc_id", "x.*")

    order = F.xxhash64("doc_id", "kind", "s")
    fit = written(rows(spans.where(~held_out)).orderBy(order, "doc_id", "kind", "s", F.col("f").cast("string")).limit(SAMPLE), "candidates")
    fit = fit.select(array_to_vector("f").alias("features"), "label")
    if fit.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxDepth=DEPTH, maxIter=TREES, stepSize=0.3, maxBins=64, seed=SEED).fit(fit)
    score = as_expression(model)
    # sums of integers: the same c in any order of rows
    mean = F.sum(F.round(score(F.col("f")) * 1e9).cast("bigint")) / F.count("*") / 1e9
    c = rows(spans.where(held_out)).where("label = 1").groupBy("kind").agg(mean.alias("c"), F.count("*").alias("n")).collect()  # one row for each kind
    total = sum(r.n for r in c)
    prior = sum(r.c * r.n for r in c) / total if total else None
    return score, {k: prior for k in range(len(KINDS)) if prior is not None} | {r.kind: r.c for r in c}


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (array of kind, s, e, m, by kind and start) of each row of ``docs``."""
    spans = spans_of(docs)
    model = train(spans)
    extra = F.array().cast("array<struct<kind:int,s:int,e:int,m:string>>")
    if model:
        score, c = model
        if c:
            shares = F.create_map(*[F.lit(v) for pair in c.items() for v in pair])
            likely = lambda x: score(features(x)) >= THRESHOLD * F.try_element_at(shares, x["kind"])
            some = F.filter("_more", lambda x: (x["label"] == 0) & F.coalesce(likely(x), F.lit(False)))
            extra = F.transform(some, lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "s", "e", "m")]))
    return spans.select("doc_id", F.col("_base").alias("base"), F.array_sort(F.concat("_base", extra)).alias("spans"))


def written_out(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each stretch covered by spans (sorted or not, overlapping or not) replaced by <kind>, the kind of
    the span that begins first."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    by_place = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def add(acc: Column, x: Column) -> Column:
        kept = F.substr(text, acc["at"] + 1, F.greatest(F.lit(0), x["s"] - acc["at"]))
        out = F.when(x["s"] >= acc["at"], F.concat(acc["out"], kept, F.get(names, x["kind"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(by_place, zero, add, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", of_kind(i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written_out("base"), 256).alias("base_sha256"), written_out("spans").alias("spans"))
