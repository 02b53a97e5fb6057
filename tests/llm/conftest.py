import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def frame(spark, texts, extra=()):
    """Documents with ids from 0, and columns named like those the operators make."""
    schema = T.StructType([*DOCS.fields, *[T.StructField(c, T.LongType()) for c in extra]])
    rows = [(i, t, None if i % 3 else "en", f"src{i % 2}" if i % 5 else None, len(t) if t else None, *[7] * len(extra)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    return ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(300)]


@pytest.fixture(scope="session")
def odd_texts(words):
    """Nulls, empty texts, blanks of all kinds, very long ones, copies, near copies, chains of near copies."""
    r = random.Random(9)
    base = [" ".join(r.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 5, 12, 40, 80, 200)]
    near = []
    for t in base[-3:]:
        w = t.split(" ")
        for _ in range(12):
            w = list(w)
            w[r.randrange(len(w))] = r.choice(words)
            near.append(" ".join(w))
    return [
        None, "", " ", "\t\n\x0b\x0c\r ", "a", "a", "A a A a", *base, *base, None, *near,
        *[t.upper() for t in base[-2:]], base[-1].replace(" ", "\n", 50), "x" * 70_000, "the " * 4000, " ".join(r.choice(words) for _ in range(9000)),
        "\x00 nul \x1c sep \x85 next\xa0line 　 wide", "\U0001f600 emoji ́ accent", "Ünï ünï",
    ]
