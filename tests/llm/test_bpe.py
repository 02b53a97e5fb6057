import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cellscore.llm.bpe import RANKS, Encoder, PerfectHash, decode, encode, op1_byte_bpe, read_ranks

from .conftest import frame

PATH = public_tokenizers.path(RANKS)
TOKENS = read_ranks(PATH)
WANT = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})
OWN = Encoder(TOKENS, PerfectHash(TOKENS), public_tokenizers.PATTERN)


def ids(text):
    return np.array(WANT.encode_ordinary(text or ""), "<u4").tobytes()


def row(i, text):
    x = ids(text)
    return i, len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash(n):
    keys = [str(i).encode() for i in range(n)]
    h = PerfectHash(keys)
    assert [h.get(k) for k in keys] == list(range(n)) and sorted(h.slots) == list(range(n))
    assert h.get(b"no key") == -1


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60) | st.text("ab '\nét,1", max_size=80))
def test_same_ids_as_the_library(text):
    assert OWN.encode(text) == ids(text)
    assert OWN.decode(OWN.encode(text)) == text.encode()


def test_odd_texts(spark, odd_texts):
    docs = frame(spark, [*odd_texts, "<|endoftext|>", "\n" * 3000, "!?" * 2000], ("ids", "decoded", "n"))
    got = {r.doc_id: (bytes(r.ids), bytes(r.decoded), r.n) for r in decode(encode(docs, PATH), PATH).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == (ids(r.text), (r.text or "").encode(), 7)
    assert encode(docs.limit(0), PATH).count() == 0


def test_test_table(spark):
    sf = "/root/testdata/sf0.01"
    want = sorted(row(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, op1_byte_bpe(spark, sf).collect())) == want
