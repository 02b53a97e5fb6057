import hashlib
import math
import re

from pyspark.sql import functions as F

from cellscore.llm.lines import drop_recurring_lines, op9_line_templates

from .conftest import frame


def template(line):
    tokens = [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
    return tuple("<*>" if re.search("[0-9@]", x) else x for x in tokens)


def classes(t):
    out = [("same", t)]
    if len(t) >= 10:
        step = math.ceil(len(t) / 5)
        for k in range(5):
            out.append((len(t), t[:2], k, t[: step * k], t[step * (k + 1) :]))
    return out


def brute(rows):
    """rows: (doc_id, text). Returns (doc_id, lines, dropped, text left)."""
    docs, kinds = {}, {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if t := template(line):
                for c in classes(t):
                    docs.setdefault(c, {}).setdefault(text, []).append(d)
                    kinds.setdefault(c, set()).add(t)
    out = []
    for d, text in rows:
        left = []
        parts = text.split("\n") if text is not None else []
        for line in parts:
            gone = False
            for c in classes(template(line)) if template(line) else []:
                n = len(template(line))
                need = 2 if n >= 50 else 10 if n < 4 else 3
                if c[0] != "same":
                    need = max(3, need)
                    if len(kinds[c]) < 2:
                        continue
                if len(docs[c]) >= need:
                    first = min(docs[c], key=lambda x: min(docs[c][x]))
                    gone |= first != text
            if not gone:
                left.append(line)
        out.append((d, len(parts), len(parts) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r._lines if r.text is not None else 0, r._dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in df.collect())


def test_templates(spark, odd_texts, words):
    long = " ".join(words[:60])
    wide = " ".join(words[60:80])
    texts = [*odd_texts, f"own one\n{long}\nmore", f"own two\n{long}", f"copy\n{long}", f"copy\n{long}", "\n\n", "short line", *["short line"] * 3]
    texts += [f"x{i}y text {words[i]}\nUser {i} logged in at 10:0{i} from a@b{i}.example here" for i in range(6)]
    texts += [f"{words[100 + i]}\n" + wide.replace(words[70], words[200 + i]) for i in range(5)] + [f"tail\r\n{wide}\r\nend {words[3]}"]
    docs = frame(spark, texts, ("key", "d", "pos", "th", "n", "first"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    out = drop_recurring_lines(docs)
    assert got(out) == want and sum(r[2] for r in want) > 12
    assert set(out.columns) == {*docs.columns, "_lines", "_dropped"} and out.where("key <> 7").isEmpty()
    assert got(drop_recurring_lines(docs.limit(0))) == []


def test_null_ids_and_repeated_rows(spark, words):
    long = " ".join(words[:60])
    docs = frame(spark, [f"a\n{long}", f"b\n{long}"])
    docs = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("text", F.concat(F.lit("c"), "text")))
    out = sorted(((r.doc_id, r.text) for r in drop_recurring_lines(docs).collect()), key=str)
    assert out == sorted([(0, f"a\n{long}")] * 2 + [(1, "b")] * 2 + [(None, "ca"), (None, "cb")], key=str)


def test_test_table(spark):
    sf = "/root/testdata/sf0.01"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert sum(r[2] for r in want) > 50
    assert sorted(map(tuple, op9_line_templates(spark, sf).collect())) == want


def test_lines_without_a_fixed_token_recur_by_equal_text(spark):
    texts = ["own a\n2019 12.4 8 77", "own b\n2020 9.1 3 5", "own c\n1998 7.7 6 2", *[f"own {x}\n1 2  3 4" for x in "def"]]
    wide = "1 2 3 4 5 6 7 8 9 10 11"
    texts += [f"own {x}\n{wide} {x}{x} end" for x in ("g", "h", "i")]
    texts += [f"own {x}\n{i} 2 3 4 5 6 7 8 9 {x}" for i, x in enumerate("jkl")]
    out = {r.doc_id: r.text for r in drop_recurring_lines(frame(spark, texts)).collect()}
    assert [out[i] for i in (0, 1, 2, 3)] == texts[:4] and [out[4], out[5]] == ["own e", "own f"]
    assert [out[i] for i in (6, 7, 8)] == [texts[6], "own h", "own i"]
    assert [out[i] for i in (9, 10, 11)] == texts[9:]


def test_documents_of_very_many_lines(spark, words):
    """Time and memory follow the lines, not the lines times the text or the dropped lines."""
    many = "\n".join(f"{words[i % 300]} {words[i // 300 % 300]} {words[i % 7]} line" for i in range(100_000))
    docs = frame(spark, [many, "own\n" + many, many + "\nlast", "short"])
    out = {r.doc_id: r for r in drop_recurring_lines(docs).collect()}
    assert [out[i]._lines for i in range(4)] == [100_000, 100_001, 100_001, 1]
    assert (out[0]._dropped, out[0].text) == (0, many) and (out[1]._dropped, out[1].text) == (100_000, "own") and out[2].text == "last"
