"""Byte-level BPE against the library whose results it has to equal, and back."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from skein.llm import byte_bpe
from skein.llm.queries import QUERIES


@pytest.fixture(scope="module")
def plain():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANK_FILE))
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op11(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for doc_id, text in docs:
        ids = plain.encode_ordinary(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(plain.decode_bytes(ids))))
    got = QUERIES["op11_byte_bpe"](spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)


#: Runs, contractions, white space of every kind, characters of one to four bytes, joined and combining ones.
PARTS = [" ", "  ", "\n", "\t", "\r\n", "\x85", " ", "=", "-", "x", "ab", "'s", "'ll", "é", "é", "語", "한글", "😀", "👩‍👩‍👧", "١٢", "1", "0", "...", "<|endoftext|>", "\x00", "�", "\U000e0041"]


def odd_texts(n):
    pick = random.Random(7)
    return ["".join(pick.choice(PARTS) * pick.choice([1, 1, 1, 2, 3, 40]) for _ in range(pick.randint(0, 12))) for _ in range(n)]


def test_odd_texts_and_offsets(spark, plain):
    texts = [None, "", " ", *odd_texts(3000), "long " * 300_000]
    docs = spark.createDataFrame([(k, t, "clash", [1]) for k, t in enumerate(texts)], "doc_id long, text string, ids string, starts array<int>")
    for row in byte_bpe.encode(docs, offsets=True).collect():
        text = texts[row.doc_id] or ""
        ids = plain.encode_ordinary(text)
        assert row.ids == ids
        if len(text) > 10_000:
            continue
        # characters of the bytes before and in each token
        strings, at, inside = plain.decode_tokens_bytes(ids), 0, 0
        for s, a, b in zip(strings, row.starts, row.ends, strict=True):
            data = text.encode()
            inside += data[at] & 0xC0 == 0x80
            assert a == sum(c & 0xC0 != 0x80 for c in data[: at + 1]) - 1
            at += len(s)
            assert b == sum(c & 0xC0 != 0x80 for c in data[:at])
        assert row.n_inside == inside


def test_decode_split_characters(spark, plain):
    texts = ["", "😀", "한글 and 語́", *odd_texts(300)]
    rows = [(k, plain.encode_ordinary(t)) for k, t in enumerate(texts)]
    split = 0
    for row in byte_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), pieces=True).collect():
        assert row.text == texts[row.doc_id] == "".join(row.token_texts)
        assert bytes(row.data) == texts[row.doc_id].encode()
        split += "" in row.token_texts
    assert split > 20


def test_decode_odd_ids(spark, plain):
    first = plain.encode_ordinary("😀")[0]  # part of a character
    rows = [(1, None), (2, []), (3, [-1, 10**6]), (4, [None]), (5, [first]), (None, plain.encode_ordinary("a"))]
    got = {r.doc_id: (bytes(r.data), r.text) for r in byte_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    mark = "�"
    assert got[1] == got[2] == (b"", "")
    assert got[3] == (2 * mark.encode(), 2 * mark) and got[4] == (mark.encode(), mark)
    assert got[5] == (plain.decode_bytes([first]), mark) and got[None] == (b"a", "a")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(docs, offsets=True), pieces=True).collect() == []


def test_own_ranks_with_runs(spark, tmp_path):
    """Tokens that overlap themselves, and one that no merge reaches."""
    import base64

    ranks = [bytes([b]) for b in range(256)] + [b"xx", b"xxx", b"xyx", b"yx", b"xy", b"xxxx", b"qrs"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(ranks)))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(ranks)}, special_tokens={})
    pick = random.Random(3)
    texts = ["qrs", *("".join(pick.choice("xxy q") for _ in range(pick.randint(1, 20))) for _ in range(2000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in byte_bpe.encode(docs, ranks=str(path)).collect():
        assert row.ids == plain.encode_ordinary(texts[row.doc_id])
