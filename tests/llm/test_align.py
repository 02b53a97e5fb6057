import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cellscore.llm import align as module
from cellscore.llm.align import align, align_corpus, op13_token_alignment, shared_cuts

from .conftest import frame


@pytest.fixture(scope="module")
def sides():
    a, b = Tokenizer.from_file(P.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    return a, b, byte_of


def grouped(text, sides):
    """[(A ids, B ids)] of each group, by one merge of the ends."""
    a, b, byte_of = sides
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
    want = (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return []
    out, i, j, end_a, end_b, own_a, own_b = [], 0, 0, 0, 0, [], []
    while i < len(ids_a) or j < len(ids_b):
        if end_a <= end_b and i < len(ids_a):
            own_a.append(ids_a[i])
            end_a += len(bytes_a[i])
            i += 1
        else:
            own_b.append(ids_b[j])
            end_b += len(bytes_b[j])
            j += 1
        if end_a == end_b:
            out.append((own_a, own_b))
            own_a, own_b = [], []
    return out


def brute(rows, sides):
    groups = [(i, grouped(t, sides)) for i, t in rows]
    count = Counter((x[-1], y[-1]) for _, g in groups for x, y in g)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for i, g in groups:
        links = [(x[-1], y[-1]) for x, y in g]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 90)), st.sets(st.integers(1, 90))), max_size=6))
def test_cuts_are_the_common_ends(texts):
    a, b, first_a, first_b = [], [], [0], [0]
    for n, (x, y) in enumerate(texts):
        if x and y:
            a += sorted(100 * n + v for v in x | {91})
            b += sorted(100 * n + v for v in y | {91})
        first_a.append(len(a))
        first_b.append(len(b))
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    at_a, at_b = shared_cuts(a, b, np.array(first_a), np.array(first_b))
    assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_long_interval_without_cuts():
    """Windows double, so 400,000 ends without one in common take few steps."""
    a, b = np.append(np.arange(0, 400_000, 2), 400_001), np.append(np.arange(1, 400_000, 2), 400_001)
    at_a, at_b = shared_cuts(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
    assert at_a.tolist() == [len(a) - 1] and at_b.tolist() == [len(b) - 1]


ODD = ["<|endoftext|> x <s> </s> <unk> <0x41>", "▁a ▁ b", "tab\tand\r\nlines\n\n", "a  b   c ", "你好世界 \U0001f600\U0001f600", "é ﬁ ½ ① 　", "I'll we've don't"]


def test_odd_texts(spark, odd_texts, sides):
    texts = [*odd_texts, *ODD, *ODD]
    docs = frame(spark, texts, ("pairs", "links", "n_a", "groups"))
    want = brute(enumerate(texts), sides)
    assert got(align_corpus(docs)) == want and sum(r[7] == "" for r in want) >= 3 and any(r[5] < r[4] for r in want)
    assert got(align_corpus(docs.limit(0))) == []
    text = {r.doc_id: r.groups for r in align(docs).collect()}
    assert all(hashlib.sha256(text[r[0]].encode()).hexdigest() == r[7] for r in want if r[7])


def test_parts_and_blocks(spark, sides, words, monkeypatch):
    """Texts cut at single spaces, parts forgotten, counts in several blocks, sums that tasks pass on early."""
    r = random.Random(7)
    texts = [r.choice((" ", "  ", "\n", " x ", ".")).join(r.choice(words) for _ in range(r.randint(1, 200))) for _ in range(60)]
    want = brute(enumerate(texts), sides)
    tokenizers = module.Tokenizers(*(open(P.path(n), "rb").read() for n in (module.BYTE_LEVEL, module.PIECES)))
    assert tokenizers.cuttable
    for t in [*texts, *ODD, " lead", "trail ", "a \n b", "a\n \nb", "x\x1c  y", "x\x1c \x1dy", "  "]:
        whole = module.Aligned(tokenizers, [t])
        assert whole.groups()[0].decode() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in grouped(t, sides)), t
    assert max(len(tokenizers.parts(t)) for t in texts) > 100
    for name, value in (("REMEMBERED", 50), ("TOGETHER", 7), ("HELD_IDS", 900)):
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(module, "BLOCK_PAIRS", 300)
    monkeypatch.setattr(module, "HELD_PAIRS", 64)
    assert got(align_corpus(frame(spark, texts))) == want


def test_test_table(spark, sides):
    sf = "/root/testdata/sf0.01"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], sides)
    assert sum(r[3] for r in want) > 100_000 and got(op13_token_alignment(spark, sf)) == want
