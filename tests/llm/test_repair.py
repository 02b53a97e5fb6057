import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellscore.llm.repair import TOKENIZER, ShardReader, WordEncoder, compress, frequent_pairs, op3_token_id_repair, pack, read_documents, write_shards

from .conftest import frame

PATH = public_tokenizers.path(TOKENIZER)
OWN = WordEncoder(PATH)
WANT = Tokenizer.from_file(PATH)
WANT.encode_special_tokens = True


def ids(text):
    return np.array(WANT.encode(text or "", add_special_tokens=False).ids, "<u4")


def brute(rows):
    out, start = [], 0
    for i, t in rows:
        x = np.append(ids(t), 1).astype("<u4")
        out.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    return out


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect())


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60) | st.text("ab '\n\t ̧́eéç,1Σς", max_size=80))
def test_same_ids_as_the_library(text):
    got, n = OWN.encode(pa.array([text, None, text]), 7)
    want = [*ids(text).tolist(), 7]
    assert got.tolist() == [*want, 7, *want] and n.tolist() == [len(want), 1, len(want)]
    assert OWN.encode(pa.array([text]))[0].tolist() == want[:-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3) | st.just(1), max_size=60), max_size=12), st.integers(1, 4))
def test_round_trip_and_random_access(docs, times):
    docs = docs * times
    flat = np.array([x for d in docs for x in d], dtype=np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs], dtype=np.int64)))
    r = ShardReader(pack(flat, starts, 4))
    assert r.starts.tolist() == starts.tolist() or not len(docs)
    assert [r.document(k).tolist() for k in range(len(docs))] == docs
    for a in range(0, len(flat), 7):
        n = min(9, len(flat) - a)
        assert r.ids(a, n).tolist() == flat[a : a + n].tolist()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 6), st.integers(1, 5))
def test_no_frequent_pair_is_left(seed, terminals, docs):
    """Whatever the hash does with rare pairs: in the symbols of a shard no pair is left that would be replaced."""
    r = np.random.default_rng(seed)
    parts = [r.integers(0, terminals, r.integers(1, 400)) for _ in range(docs)]
    flat, starts = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    x, left, right, lengths, begin = compress(flat, starts, terminals)
    new = np.zeros(len(x), bool)
    new[begin[begin < len(x)]] = True
    assert frequent_pairs(x, new) == 0
    assert lengths.tolist() == [sum(1 if v < terminals else lengths[v - terminals] for v in pair) for pair in zip(left, right)]


def test_nonterminals_nest_as_deep_as_repeats_need():
    flat = np.tile(np.arange(7, dtype=np.uint32), 4096)
    lengths = compress(flat, np.array([0, len(flat)]), 7)[3]
    assert lengths.max() >= 1000


def test_repeated_ids_get_smaller():
    flat = np.tile(np.arange(50, dtype=np.uint32), 2000)
    assert len(pack(flat, np.array([0, len(flat)]), 50)) < flat.nbytes / 10


def test_odd_texts(spark, odd_texts, tmp_path):
    texts = [*odd_texts, "<|endoftext|> x", "don't STOP"]
    docs = frame(spark, texts, ("start", "part", "shard"))
    for n in (50, 1 << 19):
        shards = write_shards(docs, str(tmp_path / f"s{n}"), PATH, shard_ids=n)
        assert got(read_documents(shards)) == brute(enumerate(texts))
    assert got(read_documents(write_shards(docs.limit(0), str(tmp_path / "none"), PATH))) == []


def test_test_table(spark):
    sf = "/root/testdata/sf0.01"
    want = brute(sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()))
    assert got(op3_token_id_repair(spark, sf)) == want


def test_special_tokens_as_the_library_by_default(spark, tmp_path):
    plain = Tokenizer.from_file(PATH)
    texts = ["x <|endoftext|> y", "X <|EndOfText|> y", "ab<|endoftext|>cd!<|startoftext|>", "é<|endoftext|>É <|endoftext|><|endoftext|>", "<|endoftext|", "<|endoftext|>", None, "x y", "ŁĄ<|STARTOFTEXT|> <|startoftext|>."]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == [343, 49407, 344]
    own = WordEncoder(PATH, special=True)
    for _ in range(2):
        assert [own.encode(pa.array([t], pa.string()))[0].tolist() for t in texts] == want
        assert own.encode(pa.array(texts))[0].tolist() == sum(want, [])
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in op3_token_id_repair(spark, str(tmp_path)).collect())
    assert rows == [(i, len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for i, x in enumerate(want)]
