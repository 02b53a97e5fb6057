"""Secret scans: a generator of candidates and a random forest that removes false positives.

Candidates are runs of at least ``SHORTEST`` characters of the kind keys are made of that hold a digit, and quoted
values assigned to a name that speaks of secrets. The forest (the ML library's) judges each by its length, by how its
characters follow each other compared with all of the corpus, by how much of it words of the corpus cover, by the path
(the column ``path``, here the documents' source) and by the words and signs around it.

It is trained on labelled findings, equal ones as one with their count as weight, at most ``SAMPLE``: half of them of
each label, those with the smallest hashes, weighted so that each label keeps its share. Where none are given they are
made by rules: a quoted value with letters and digits assigned to a secret's name is one; digits alone, runs that words
cover, and values called a hash, id or version are not; all others have no label. If the findings have labels of one
kind only, every candidate gets that label.

The corpus's character transitions and frequent words are counted over all rows, in tables of fixed size. Null texts
count as empty; null paths as "". Repeated rows each get their row. Places are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellscore.llm import arrow
from cellscore.llm.arrow import SYMBOLS, Words, flat, slices, summed
from cellscore.llm.store import read_table, written

SHORTEST, SAMPLE, TREES, DEPTH, THRESHOLD, SEED = 12, 20_000, 20, 5, 0.5, 11
WORDS = 1 << 18
SIGNS = 64

RUN = re.compile(r"[A-Za-z0-9_+/~-]{%d,}={0,2}" % SHORTEST)
ASSIGNED = re.compile(r"""(?i:token|secret|passw(?:or)?d|pwd|api_?key|access_?key|private_?key|auth|credential)[A-Za-z0-9_]{0,20}\W{0,4}[=:]\W{0,4}["']([^"'\s]{6,200})["']""")
NAMES = re.compile(r"(?i)token|secret|passw|pwd|key|auth|credential|bearer")
OTHERS = re.compile(r"(?i)\b(?:sha\d*|hash|md5|commit|digest|checksum|uuid|guid|id|isbn|order|invoice|version|phone|tel)\b")
DUMMY = re.compile(r"(?i)test|example|sample|fixture|docs?\b|mock")


def _signs() -> np.ndarray:
    """Each byte's sign: letters one by one, then digits, some marks, all others, bytes beyond ASCII."""
    out = np.full(256, 61)
    out[97:123], out[65:91], out[48:58], out[128:] = np.arange(26), np.arange(26, 52), 52, 62
    for i, c in enumerate(b'_-+/=. "'):
        out[c] = 53 + i
    return out


SIGN = _signs()


def statistics(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of a sign after another, and which buckets of word hashes hold frequent words."""

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        data, _ = flat(batch.column("text"))
        signs = SIGN[data]
        total[: SIGNS * SIGNS] += np.bincount(signs[:-1] * SIGNS + signs[1:], minlength=SIGNS * SIGNS)
        np.add.at(total, SIGNS * SIGNS + bucket(Words(batch.column("text"), SYMBOLS).hash), 1)

    total = summed(docs.select("text"), SIGNS * SIGNS + WORDS, count)
    pairs = total[: SIGNS * SIGNS].reshape(SIGNS, SIGNS) + 0.1
    words = total[SIGNS * SIGNS :]
    return np.log(pairs / pairs.sum(axis=1, keepdims=True)), words >= max(10, 4 * words.mean())


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 18)).astype(np.int64)


def coverage(raw: np.ndarray, frequent: np.ndarray) -> float:
    """Share of the bytes covered by frequent words of 3 to 10 letters."""
    n = len(raw)
    low = arrow.LOWER[raw]
    arrow._grow(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(arrow.TABLE[low] * arrow._powers[:n], out=sums[1:])
    letters = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
    edge = np.zeros(n + 1, dtype=np.int64)
    for k in range(3, min(10, n) + 1):
        hit = frequent[bucket(arrow.mix((sums[k:] - sums[:-k]) * arrow._inverses[: n - k + 1]))] & (letters[k:] - letters[:-k] == k)
        edge[: n - k + 1] += hit
        edge[k:] -= hit
    return float((np.cumsum(edge)[:n] > 0).mean()) if n else 0.0


def candidates(text: str) -> dict[tuple[int, int], bool]:
    """(start, end) -> whether it is a quoted value of a secret's name."""
    out = {m.span(): False for m in RUN.finditer(text) if any(c.isdigit() for c in m[0])}
    for m in ASSIGNED.finditer(text):
        out[m.span(1)] = True
    return out


FEATURES = ["length", "entropy", "digits", "capitals", "small", "turns", "transitions", "words", "different", "hexadecimal", "numeric", "quoted", "sign_before", "sign_after", "named", "other_name", "assigned", "words_before", "path_dummy", "path_depth", "path_hash"]


def features(text: str, s: int, e: int, path: str, likely: np.ndarray, frequent: np.ndarray) -> list[float]:
    value, before, after = text[s:e], text[max(0, s - 40) : s], text[e : e + 2]
    raw = np.frombuffer(value.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(value)
    counts = Counter(value)
    p = np.array(list(counts.values())) / n
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    signs = SIGN[raw]
    sort = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in "\"'" else 5
    return [
        n, float(-(p * np.log2(p)).sum()), kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        float(likely[signs[:-1], signs[1:]].mean()) if len(signs) > 1 else 0.0, coverage(raw, frequent), len(counts), float(not set(value.lower()) - set("0123456789abcdef")), float(value.isdigit()),
        float(before[-1:] in "\"'" and before != "" and after[:1] in "\"'" and after != ""), sort(before[-1:]), sort(after[:1]), float(bool(NAMES.search(before))), float(bool(OTHERS.search(before))),
        float(bool(re.search(r"[=:]\W{0,4}$", before))), len(before.split()), float(bool(DUMMY.search(path))), path.count("/"), xxhash.xxh3_64_intdigest(path) % 16,
    ]


def rule(value: str, assigned: bool, f: dict[str, float]) -> int | None:
    """The label of a finding by rule: 1, 0 or none."""
    if f["numeric"] or f["words"] >= 0.8 or f["other_name"] and not f["named"]:
        return 0
    if assigned and len(value) >= 16 and any(c.isalpha() for c in value) and f["digits"]:
        return 1
    return None


FOUND = "struct<s: bigint, e: bigint, label: int, f: array<double>>"


def found_in(docs: DataFrame, likely: np.ndarray, frequent: np.ndarray) -> DataFrame:
    """doc_id, key (of the text) and found: the candidates of each row of ``docs`` (doc_id, key, path, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((likely, frequent))
    kind = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("label", pa.int32()), ("f", pa.list_(pa.float64()))])

    def run(batches):
        likely, frequent = shared.value
        for batch in slices(batches):
            out = []
            for text, path in zip(batch.column("text").to_pylist(), batch.column("path").to_pylist()):
                own = []
                for (s, e), assigned in sorted(candidates(text or "").items()):
                    f = features(text, s, e, path or "", likely, frequent)
                    own.append({"s": s, "e": e, "label": rule(text[s:e], assigned, dict(zip(FEATURES, f))), "f": f})
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("key"), pa.array(out, pa.list_(kind))], ["doc_id", "key", "found"])

    return docs.mapInArrow(run, f"doc_id bigint, key bigint, found array<{FOUND}>")


def forest(findings: DataFrame):
    """The probability that a finding is a secret, as a function of its features' column, learnt from (f, label)."""
    findings = written(findings.groupBy("f", "label").agg(F.count("*").alias("n")), "findings")
    totals = {r.label: r.n for r in findings.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    labels = sorted(totals)
    if len(labels) < 2:
        return lambda f: F.lit(float(labels[0]) if labels else 0.0)
    order = [F.xxhash64(F.col("f").cast("string")), F.col("f").cast("string")]
    some = [findings.where(F.col("label") == k).orderBy(*order).limit(SAMPLE // 2) for k in labels]
    fit = written(some[0].unionByName(some[1]).coalesce(1), "fit")
    shares = {r.label: totals[r.label] / r.n for r in fit.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    weight = F.col("n") * F.when(F.col("label") == 1, shares[1]).otherwise(shares[0])
    fit = fit.select(array_to_vector("f").alias("features"), F.col("label").cast("double").alias("label"), weight.alias("weight"))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=SEED, weightCol="weight").fit(fit)

    def tree(node, f: Column) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            no, yes = list(node.impurityStats().stats())
            return F.lit(yes / (no + yes))
        split = node.split()
        return F.when(F.get(f, F.lit(split.featureIndex())) <= float(split.threshold()), tree(node.leftChild(), f)).otherwise(tree(node.rightChild(), f))

    def score(f: Column) -> Column:
        return sum((tree(t._java_obj.rootNode(), f) for t in model.trees), F.lit(0.0)) / len(model.trees)

    return score


def scan_secrets(docs: DataFrame, path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, found (s, e, score of each candidate, by place) of each row of ``docs``.

    ``labelled``: findings (doc_id, s, e, label) judged by people, in place of those made by rules.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col(path).cast("string").alias("path"), "text")
    rows = written(found_in(docs, *statistics(docs)), "candidates")
    each = rows.select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.*")
    if labelled is None:
        findings = each.where("label is not null").select("f", "label")
    else:
        findings = each.drop("label").join(labelled.select("doc_id", "s", "e", "label").where("label in (0, 1)"), ["doc_id", "s", "e"]).select("f", "label")
    score = forest(findings)
    return rows.select("doc_id", F.transform("found", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), score(x["f"]).alias("score"))).alias("found"))


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_candidates, n_secrets, and the places of the secrets (start:end, comma-joined)."""
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    kept = F.filter("found", lambda x: x["score"] >= THRESHOLD)
    places = F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return found.select("doc_id", F.size("found").cast("bigint").alias("n_candidates"), F.size(kept).cast("bigint").alias("n_secrets"), places.alias("spans"))
