"""Line dedup by a log-template tree, with DataFrame functions only.

A line's tokens are what stands between ASCII white space. Tokens with a digit or an at sign are variable fields and
become one wildcard. The tree has a fixed depth: token count, then the first ``LEADING`` tokens; below, a line's
template is either all of its tokens, or its tokens with one of ``STRETCHES`` equal stretches as a wildcard (so at
least four fifths of the tokens are the template's). The second kind is tried only in leaves with several first ones,
and for lines of at least ``WIDE`` tokens.

A template recurs if it stands in enough different documents: 2 for lines of ``LONG`` tokens or more, 10 for fewer
than ``SHORT``, else 3; templates of the second kind need at least 3. A template has a fixed token at least: lines of
variable fields alone recur by equal text, and a stretch that has all fixed tokens is no wildcard. Documents with the same text count as one, so
that whole copies are left to document dedup. Lines of recurring templates are dropped everywhere but in the
template's first document (smallest doc_id; null last) and its copies; what stood in the variable fields of the other
lines is lost with them.

Null texts stay null; blank lines are kept and never count; repeated rows are treated alike; all other columns are
passed through. Counts go through two aggregations, by template and document and then by template, so a line that
stands in a third of all documents is no task of its own; the join back is one that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.llm.store import read_table, written

BLANK = r"[\x20\x09-\x0D]"
#: A whole token with a digit or an at sign, found from its beginning in one pass.
FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
LEADING, STRETCHES, WIDE = 2, 5, 10
SHORT, LONG = 4, 50
LAST = (1 << 63) - 1


def needed(tokens: Column) -> Column:
    """In how many documents a line of so many tokens must stand."""
    return F.when(tokens >= LONG, 2).when(tokens < SHORT, 10).otherwise(3)


def lines_of(docs: DataFrame) -> DataFrame:
    """d, key (of the document and its text), pos, n (tokens), leaf, th (template), s0.. (stretches) and rest (is there a
    fixed token outside of each) of each line that isn't blank."""
    parted = docs.select(F.col("doc_id").cast("bigint").alias("d"), F.xxhash64("text").alias("key"), F.split("text", "\n").alias("parts"))
    rows = parted.select("d", "key", F.posexplode("parts").alias("pos", "line"))  # a line carries the key, not the text
    masked = F.when(F.col("line").rlike("[0-9@]"), F.regexp_replace("line", FIELD, "<*>")).otherwise(F.col("line"))
    tokens = F.filter(F.split(masked, BLANK + "+"), lambda x: x != "")
    rows = rows.select("d", "key", "pos", "line", tokens.alias("t")).withColumn("n", F.size("t")).where("n > 0")
    rows = rows.withColumn("fixed", F.array_size(F.array_remove("t", "<*>")))
    plain = F.filter(F.split("line", BLANK + "+"), lambda x: x != "")  # no template without a fixed token
    rows = rows.withColumn("t", F.when(F.col("fixed") > 0, F.col("t")).otherwise(plain))
    step = F.ceil(F.col("n") / STRETCHES).cast("int")
    parts = [F.slice("t", 1 + step * k, step) for k in range(STRETCHES)]
    cuts = [F.when((F.col("n") >= WIDE) & (F.col("fixed") > 0), F.hash(p)).alias(f"s{k}") for k, p in enumerate(parts)]
    rest = [F.size(F.array_remove(p, "<*>")) < F.col("fixed") for p in parts]
    held = F.when((F.col("n") >= WIDE) & (F.col("fixed") > 0), F.array(*rest)).alias("rest")
    th = F.xxhash64("t", F.col("fixed") > 0)
    return rows.select("d", "key", "pos", "n", F.xxhash64("n", F.slice("t", 1, LEADING)).alias("leaf"), th.alias("th"), *cuts, held)


def spread(rows: DataFrame, by: str) -> DataFrame:
    """by, n, docs (different documents) and first (key of the first document) of each value of ``by``."""
    each = rows.groupBy(by, "key").agg(F.min("d").alias("d"), F.max("n").alias("n"))
    return each.groupBy(by).agg(F.max("n").alias("n"), F.count("*").alias("docs"), F.min_by("key", "d").alias("first"))


def recurring(lines: DataFrame) -> DataFrame:
    """th, firsts: for each template whose lines are dropped, the keys of the documents that keep them."""
    rows = lines.withColumn("d", F.coalesce("d", F.lit(LAST)))
    same = spread(rows, "th").where(F.col("docs") >= needed(F.col("n"))).select("th", "first")

    kinds = lines.where("s0 is not null").groupBy("th").agg(F.min("leaf").alias("leaf"), *[F.min(f"s{k}").alias(f"s{k}") for k in range(STRETCHES)], F.min("rest").alias("rest"))
    crowded = kinds.groupBy("leaf").agg(F.count("*").alias("m")).where("m > 1").select("leaf")
    kinds = kinds.join(crowded, "leaf", "left_semi")
    wild = [F.when(F.get("rest", F.lit(k)), F.xxhash64("leaf", F.lit(k), *[f"s{j}" for j in range(STRETCHES) if j != k])) for k in range(STRETCHES)]
    kinds = written(kinds.select("th", F.explode(F.array(*wild)).alias("g")).where("g is not null"), "templates")
    several = kinds.groupBy("g").agg(F.min("th").alias("x"), F.max("th").alias("y")).where("x < y").select("g")
    kinds = kinds.join(several, "g", "left_semi")
    varied = spread(rows.select("th", "key", "d", "n").join(kinds, "th"), "g").where(F.col("docs") >= F.greatest(F.lit(3), needed(F.col("n"))))
    alike = kinds.join(varied.select("g", "first"), "g").select("th", "first")
    return same.unionByName(alike).groupBy("th").agg(F.collect_set("first").alias("firsts"))  # at most 1 + STRETCHES


def dropped_lines(docs: DataFrame) -> DataFrame:
    """d, key, gone: the places of the lines to drop, for each document that has any."""
    lines = written(lines_of(docs), "lines")
    known = written(recurring(lines), "recurring")
    hit = lines.select("d", "key", "pos", "th").join(known, "th").where(F.exists("firsts", lambda f: f != F.col("key")))
    return hit.groupBy("d", "key").agg(F.collect_set("pos").alias("gone"))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the text that is left, and _lines and _dropped: how many lines there were and how many went."""
    gone = written(dropped_lines(docs), "gone")
    keyed = docs.withColumn("_key", F.xxhash64("text")).hint("merge")  # the other side grows with the corpus
    match = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))
    both = keyed.join(gone.select(F.col("d").alias("_d"), F.col("key").alias("_k"), F.col("gone").alias("_gone")), match, "left")
    parts = F.split("text", "\n")
    both = both.withColumn("_parts", parts).withColumn("_lines", F.coalesce(F.size("_parts"), F.lit(0))).withColumn("_dropped", F.coalesce(F.size("_gone"), F.lit(0)))
    places = F.array_except(F.sequence(F.lit(0), F.col("_lines") - 1), "_gone")  # by hash sets, in order
    left = F.array_join(F.transform(places, lambda i: F.get("_parts", i)), "\n")
    return both.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left)).drop("_key", "_d", "_k", "_gone", "_parts")


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, and the SHA-256 of the text that is left, of each document."""
    out = drop_recurring_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("_lines")).cast("bigint").alias("n_lines"), F.col("_dropped").cast("bigint").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
