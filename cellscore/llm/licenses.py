"""License scans through a positional index of rare words, with DataFrame functions only.

A template is a run of words that names or grants a license, with a key phrase that must be there whole. One pass over
all texts counts in how many the templates' words occur. The ``ANCHORS`` words of highest inverse document frequency of
each template are indexed with their offset in it. In the second pass each text's places of such words are looked up;
a place less the offset is where the template would begin, and a beginning that two of the template's words agree on
is a candidate (base phrases: their rarest word is enough). A candidate is verified word by word: its key phrase
completely, and words of at least ``COVERAGE`` of the template's total weight (inverse document frequencies).

The counts are of the templates' own words only, so what reaches the driver is as large as the templates. Null texts
count as empty; repeated rows each get their row; only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.llm.store import read_table

ANCHORS, COVERAGE = 3, 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrase, label.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Words of the license or its notice, key phrase within them, label.
TEMPLATES = [
    ("under the apache license version 2 0", "apache license version 2 0", "apache-2.0"),
    ("the gnu general public license version 2", "general public license version 2", "gpl-2.0"),
    ("the gnu general public license version 3", "general public license version 3", "gpl-3.0"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license", "gpl"),
    ("gnu lesser general public license", "gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "gnu affero general public license", "agpl"),
    ("gnu free documentation license", "gnu free documentation license", "gfdl"),
    ("cc by nc", "cc by nc", "cc-by-nc"),
    ("cc by sa", "cc by sa", "cc-by-sa"),
    ("cc by nd", "cc by nd", "cc-by-nd"),
    ("cc by nc sa", "cc by nc sa", "cc-by-nc-sa"),
    ("cc by nc nd", "cc by nc nd", "cc-by-nc-nd"),
    ("creative commons attribution", "creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "attribution noncommercial", "cc-by-nc"),
    ("creative commons zero", "creative commons zero", "cc0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "without warranty of any kind", "warranty-disclaimer"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted", "isc"),
    ("subject to the terms of the mozilla public license", "mozilla public license", "mpl"),
    ("eclipse public license", "eclipse public license", "epl"),
    ("this is free and unencumbered software released into the public domain", "free and unencumbered software", "unlicense"),
    ("all rights reserved", "all rights reserved", "all-rights-reserved"),
]


def words_of(text: Column) -> Column:
    """The words of ``text``, A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda x: x != "")


def vocabulary() -> list[str]:
    return sorted({w for t in [*BASE, *TEMPLATES] for w in t[0].split()})


def literals(items: list) -> Column:
    return F.array(*[F.lit(x) for x in items])


def weights(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each word of the templates over all of ``docs``."""
    own = F.array_intersect(words_of(F.col("text")), literals(vocabulary()))
    counts = docs.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    seen = {r.w: r.n for r in counts.collect()}  # one row for each word of the templates, one for all texts
    total = seen.get("", 0)
    return {w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 1.0 for w in vocabulary()}


def indexed(words: list[str], idf: dict[str, float], k: int) -> list[tuple[str, int]]:
    """The ``k`` rarest different words with their first offset (ties: the earlier in the alphabet)."""
    return [(w, words.index(w)) for w in sorted(set(words), key=lambda w: (-idf[w], w))[:k]]


def begins(word: str, offset: int) -> Column:
    """Where a template with ``word`` at ``offset`` would begin."""
    return F.transform(F.filter("_at", lambda p: F.get("_words", p) == word), lambda p: p - offset)


def stands(start: Column, words: list[str], offset: int = 0) -> Column:
    """Whether ``words`` stand at ``start`` + ``offset``."""
    return (start >= 0) & (F.slice("_words", start + (1 + offset), len(words)) == literals(words))


def places(words: list[str], idf: dict[str, float]) -> Column:
    """All beginnings of a phrase, found by its rarest word."""
    (word, offset), *_ = indexed(words, idf, 1)
    return F.filter(begins(word, offset), lambda s: stands(s, words))


def best_coverage(words: list[str], key: list[str], idf: dict[str, float]) -> Column:
    """The largest share of the template's weight over its candidates with the key phrase; null if there is none."""
    found = [begins(w, o) for w, o in indexed(words, idf, ANCHORS)]
    pairs = [F.array_intersect(a, b) for i, a in enumerate(found) for b in found[i + 1 :]]
    candidates = F.array_distinct(F.concat(*pairs)) if pairs else found[0]
    at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
    whole = sum(idf[w] for w in words)
    template = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), F.lit(idf[w] / whole).alias("x")) for i, w in enumerate(words)])

    def share(s: Column) -> Column:
        def add(total: Column, t: Column) -> Column:
            place = s + t["i"]
            same = (place >= 0) & F.coalesce(F.get("_words", place) == t["w"], F.lit(False))
            return total + F.when(same, t["x"]).otherwise(0.0)

        return F.aggregate(template, F.lit(0.0), add)

    return F.array_max(F.transform(F.filter(candidates, lambda s: (s + at >= 0) & stands(s + at, key)), share))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (label -> word places), templates (label, coverage) of each row of ``docs``."""
    docs = docs.select("doc_id", "text")
    idf = weights(docs)
    anchors = sorted({w for t in BASE for w, _ in indexed(t[0].split(), idf, 1)} | {w for t in TEMPLATES for w, _ in indexed(t[0].split(), idf, ANCHORS)})
    rows = docs.select("doc_id", words_of(F.col("text")).alias("_words"))
    marked = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(anchors), i)), lambda p: p.isNotNull())
    rows = rows.withColumn("_at", F.when(F.arrays_overlap("_words", literals(anchors)), marked))
    base = [F.struct(F.lit(label).alias("label"), places(p.split(), idf).alias("at")) for p, label in BASE]
    named = [F.struct(F.lit(label).alias("label"), best_coverage(t.split(), key.split(), idf).alias("coverage")) for t, key, label in TEMPLATES]
    some = F.col("_at").isNotNull()
    return rows.select(
        "doc_id",
        F.size("_words").cast("bigint").alias("n_words"),
        F.when(some, F.filter(F.array(*base), lambda x: F.size(x["at"]) > 0)).alias("base"),
        F.when(some, F.filter(F.array(*named), lambda x: x["coverage"] >= COVERAGE)).alias("templates"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score is the largest coverage of a verified template; a base phrase covers itself."""
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    at = F.flatten(F.transform("base", lambda x: x["at"]))
    labels = F.transform("base", lambda x: x["label"])
    others = F.transform("templates", lambda x: x["label"])
    text = lambda x: F.coalesce(F.array_join(F.array_sort(F.array_distinct(x)), ","), F.lit(""))
    covered = F.coalesce(F.array_max(F.transform("templates", lambda x: x["coverage"])), F.lit(0.0))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.least(F.lit(1.0), covered))
    return found.select(
        "doc_id", "n_words", F.coalesce(F.size(at), F.lit(0)).cast("bigint").alias("n_base"), F.array_min(at).cast("bigint").alias("first_word"), F.array_max(at).cast("bigint").alias("last_word"),
        text(labels).alias("base_labels"), text(F.concat(labels, others)).alias("labels"), score.alias("score"),
    )
