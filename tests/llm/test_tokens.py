"""Token ids, offsets, decoding and counts against the libraries themselves."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frames import frame  # noqa: F401
from tabforge.llm.bpe import ByteDecoder, ByteEncoder, byte_characters, decode_ids, encode_texts, read_ranks
from tabforge.llm.queries import QUERIES
from tabforge.llm.token_counts import TokenCounter, count_tokens, split_safely

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
TEXTS = ["", "a", "  two  spaces \n\n x", "naïve 漢字 👩‍👩‍👧 \u0085  end", "it's 123abc'll <|endoftext|> <|endoftext|>", "x" * 3000,
         "ab " * 2000, "\t\n ", "a\x00b", "Ünïcödé​" * 50]


@pytest.fixture(scope="module")
def reference():
    ranks = read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_byte_table():
    table = byte_characters()
    assert len(set(table.values())) == 256 and table[ord("a")] == "a" and table[0] == "Ā" and table[ord(" ")] == "Ġ"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("ab '\n1é漢s", max_size=60))
def test_any_text_as_the_library(text):
    enc = _encoder()
    assert enc[0].encode([text])[0] == enc[1](text)
    assert enc[2].count([text])[0] == len(enc[3].encode(text, add_special_tokens=False))


_made = []


def _encoder():
    if not _made:
        ranks = read_ranks(RANKS)
        _made.extend([ByteEncoder(RANKS, P.PATTERN),
                      tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary,
                      TokenCounter(JSON, P.PATTERN), Tokenizer.from_file(JSON)])
    return _made


def test_round_trip_and_offsets(spark, frame, reference):
    df = frame([(i, t) for i, t in enumerate([None, *TEXTS])]).withColumn("ids", F.lit("clash"))
    encoded = encode_texts(df, RANKS, P.PATTERN, offsets=True)
    assert encoded.columns == ["doc_id", "ids", "starts", "ends"]
    for r in decode_ids(encoded, RANKS).collect():
        text = ["", *TEXTS][r.doc_id]
        assert list(r.ids) == reference(text) and bytes(r.decoded) == text.encode()
        data = text.encode()
        table = ByteDecoder(RANKS).table
        at = 0
        for i, s, e in zip(r.ids, r.starts, r.ends):
            n = len(table[i].as_py())
            before, after = data[:at].decode("utf-8", "ignore"), data[:at + n].decode("utf-8", "replace")
            assert s == len(before) and e == len(after)
            at += n


def test_decode_split_and_null(spark):
    ids = ByteEncoder(RANKS, P.PATTERN).encode(["漢"])[0]
    df = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, None), (4, [])], "k int, ids array<int>").withColumn("decoded", F.lit(1))
    got = {r.k: None if r.decoded is None else bytes(r.decoded) for r in decode_ids(df, RANKS).collect()}
    assert got[1] == "漢".encode() and got[3] is None and got[4] == b""
    assert got[2] == ByteDecoder(RANKS).table[ids[0]].as_py()
    assert decode_ids(df.limit(0), RANKS).count() == 0 and encode_texts(df.select("k", F.lit("x").alias("t")).limit(0), RANKS, P.PATTERN, "k", "t").count() == 0


def test_one_task_gives_ids_offsets_and_bytes(spark, frame):
    df = frame([(i, t) for i, t in enumerate([None, *TEXTS, TEXTS[3]])])
    both = encode_texts(df, RANKS, P.PATTERN, offsets=True, decoded=True)
    assert both.columns == ["doc_id", "ids", "starts", "ends", "decoded"]
    apart = decode_ids(encode_texts(df, RANKS, P.PATTERN, offsets=True), RANKS)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, apart.collect()))
    assert encode_texts(df, RANKS, P.PATTERN, decoded=True).columns == ["doc_id", "ids", "decoded"]
    assert encode_texts(df.limit(0), RANKS, P.PATTERN, offsets=True, decoded=True).count() == 0


def test_memory_of_words_starts_anew(reference, monkeypatch):
    monkeypatch.setattr("tabforge.llm.bpe.MEMO_BYTES", 1000)
    monkeypatch.setattr("tabforge.llm.token_counts.MEMO_BYTES", 1000)
    encoder, counter = ByteEncoder(RANKS, P.PATTERN), TokenCounter(JSON, P.PATTERN)
    library, most = Tokenizer.from_file(JSON), 0
    for i in range(200):
        text = f"word{i} {'é' * i} again " * 3
        assert encoder.encode([text, ""]) == [reference(text), []]
        assert counter.count([text]) == [len(library.encode(text, add_special_tokens=False))]
        most = max(most, len(encoder._memo)) if i > 190 else most
    assert most < 20


def offsets_of(table, text, ids):
    """Character ranges of tokens, one byte at a time."""
    data, at, starts, ends = text.encode(), 0, [], []
    first = [i for i, b in enumerate(data) if b & 0xC0 != 0x80]
    char_at = {}
    for n, i in enumerate(first):
        for b in range(i, (first[n + 1:] or [len(data)])[0]):
            char_at[b] = n
    for i in ids:
        n = len(table[i])
        starts.append(char_at[at]), ends.append(char_at[at + n - 1] + 1)
        at += n
    return starts, ends


def test_query_offsets_over_the_whole_table(spark, sf_dir, reference):
    table = {i: t for t, i in read_ranks(RANKS).items()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(d.doc_id, *offsets_of(table, d.text or "", reference(d.text or ""))) for d in docs]
    want = spark.createDataFrame(rows, "doc_id long, starts array<int>, ends array<int>").select("doc_id", F.xxhash64("starts", "ends").alias("h"))
    got = QUERIES["op1_byte_bpe"](spark, sf_dir).select("doc_id", "offsets_xxhash64")
    assert {tuple(r) for r in want.collect()} == {tuple(r) for r in got.collect()}


def test_split_safely_keeps_counts():
    library, counter = Tokenizer.from_file(JSON), TokenCounter(JSON, P.PATTERN)
    for text in TEXTS + ["word  \n\n x,  y " * 300]:
        parts = split_safely(text, 40)
        assert "".join(parts) == text
        assert sum(counter.count(parts)) == len(library.encode(text, add_special_tokens=False))
    assert max(map(len, split_safely("word " * 1000, 40))) < 60


def test_count_tokens(spark, frame):
    library = Tokenizer.from_file(JSON)
    df = frame([(1, None), (1, None), *enumerate(TEXTS, 2)]).withColumn("n_tokens", F.lit("clash"))
    got = sorted(tuple(r) for r in count_tokens(df, JSON, P.PATTERN, limit=100).collect())
    want = [(i, t.encode(), len(library.encode(t, add_special_tokens=False))) for i, t in [(1, ""), (1, ""), *enumerate(TEXTS, 2)]]
    assert got == sorted((i, len(d), n, n > 100) for i, d, n in want)
    assert count_tokens(df.limit(0), JSON, P.PATTERN).count() == 0


def test_queries_over_whole_tables(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    one = {r.doc_id: r for r in QUERIES["op1_byte_bpe"](spark, sf_dir).collect()}
    four = {r.doc_id: r for r in QUERIES["op4_token_counts"](spark, sf_dir).collect()}
    library = Tokenizer.from_file(JSON)
    for d in docs:
        text = d.text or ""
        ids = reference(text)
        assert one[d.doc_id][1:4] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                      hashlib.sha256(text.encode()).hexdigest())
        n = len(library.encode(text, add_special_tokens=False))
        assert four[d.doc_id][1:4] == (len(text.encode()), n, n > 512)
    assert len(one) == len(four) == len(docs)
