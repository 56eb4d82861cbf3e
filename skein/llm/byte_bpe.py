"""Byte-level BPE from a rank file: ids with offsets, and back to bytes and text.

A rank file lists byte strings with a rank each. The tokenizers library works on characters, so each byte
is written as one printable character, the model gets every split of a token into two tokens as a merge, in
the order of the tokens' ranks, and a whole match of the pattern that is a token itself is taken as it is.
Of two splits of one token the one with the longer left part comes first, which is the leftmost merge in a
run of equal bytes. Decoding looks each id up in the table of byte strings and joins the bytes before it
reads characters, so a character that several tokens share comes out whole.

Defined results: a null text counts as empty and has no ids; rows stay one for one whatever repeats among
them; an empty table gives an empty result; further columns are ignored. In decoding, null ids give empty
bytes and an id outside the table, or a null among ids, gives the bytes of U+FFFD; bytes that are no UTF-8 give
U+FFFD in ``text`` and stay as they are in ``data``.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import textscan, tokens

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Bytes that byte-level vocabularies write as the Latin-1 character of the same number; others follow from 256 on.
PRINTED = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))


def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    printed = textscan.byte_class(*PRINTED)
    number = np.where(printed, np.arange(256), 255 + np.cumsum(~printed))
    return [chr(n) for n in number]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def token_strings(ranks: dict[bytes, int]) -> list[bytes]:
    strings = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        strings[rank] = token
    return strings


class RankEncoder(tokens.PieceEncoder):
    """The library's encoder for a rank file."""

    def __init__(self, path: str, cache_pieces: int = tokens.CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks, characters = read_ranks(path), byte_characters()
        written = {token: "".join(map(characters.__getitem__, token)) for token in ranks}
        merges = [
            (written[token[:k]], written[token[k:]])
            for token in sorted(ranks, key=ranks.__getitem__)
            for k in range(len(token) - 1, 0, -1)
            if token[:k] in ranks and token[k:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        # the library's own pattern is the one of the public vocabularies
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.special: list[bytes] = []
        self.n_bytes = np.array([len(s) for s in token_strings(ranks)], dtype=np.int64)
        self.cache_pieces = cache_pieces
        self._clear()


@lru_cache(maxsize=2)
def encoder(path: str) -> RankEncoder:
    """One encoder for each Python worker."""
    return RankEncoder(path)


class RankDecoder:
    """The byte string of every id, and one string more: what an unknown id decodes to."""

    def __init__(self, path: str):
        self.strings = pa.array([*token_strings(read_ranks(path)), "\ufffd".encode()], pa.large_binary())

    def bytes_of(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all bytes, where each id's bytes begin and end)."""
        unknown = len(self.strings) - 1
        number = ids.fill_null(unknown).to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.where((number < 0) | (number > unknown), unknown, number)
        _, offsets, data = self.strings.take(pa.array(number)).buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[: len(number) + 1] if len(number) else np.zeros(1, dtype=np.int64)
        return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8), bounds


@lru_cache(maxsize=2)
def decoder(path: str) -> RankDecoder:
    return RankDecoder(path)


def _places(text: pa.Array, lengths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first character, character after the last, whether it begins inside a character) of every token, counted in its row."""
    offsets, data = textscan.string_buffers(text)
    data = data[offsets[0] : offsets[-1]]
    leads = np.cumsum((data & 0xC0) != 0x80)
    after = np.cumsum(lengths)
    begin = after - lengths
    rows = np.append(0, leads)[offsets[:-1] - offsets[0]]
    rows = np.repeat(rows, np.diff(ends))
    if not len(begin):
        return rows, rows, np.zeros(0, dtype=bool)
    return leads[begin] - 1 - rows, leads[after - 1] - rows, (data[begin] & 0xC0) == 0x80


Batches = Iterator[pa.RecordBatch]


def _encoding(path: str, offsets: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        own = encoder(path)
        for batch in batches:
            for lo, hi, ids, ends in own.encode(batch["text"]):
                first, after, inside = _places(batch["text"].slice(lo, hi - lo), own.n_bytes[ids], ends)
                bounds = pa.array(ends, pa.int32())
                columns = {
                    "doc_id": batch["doc_id"].slice(lo, hi - lo),
                    "ids": pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int32())),
                    "n_inside": pa.array(np.diff(np.append(0, np.cumsum(inside))[ends])),
                }
                if offsets:
                    columns["starts"] = pa.ListArray.from_arrays(bounds, pa.array(first, pa.int32()))
                    columns["ends"] = pa.ListArray.from_arrays(bounds, pa.array(after, pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def encode(docs: DataFrame, *, offsets: bool = False, ranks: str | None = None) -> DataFrame:
    """Ids of every text of ``docs(doc_id, text)``: ``doc_id, ids, n_inside``.

    ``n_inside`` counts tokens that begin inside a character. With ``offsets``, ``starts`` and ``ends`` give the
    first character of each token and the one after its last, as places in the text.
    """
    run = _encoding(ranks or tokens.vocabulary_path(RANK_FILE), offsets)
    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, n_inside long" + ", starts array<int>, ends array<int>" * offsets)


def _token_texts(strings: list[bytes]) -> list[str]:
    """Text of each token; a character that several tokens share stands with the one that completes it."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    return [reader.decode(s, final=k + 1 == len(strings)) for k, s in enumerate(strings)]


def _slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, few at a time where their lists are long."""
    ends = np.cumsum(batch[column].value_lengths().fill_null(0).to_numpy())
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _decoding(path: str, text: bool, pieces: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        own = decoder(path)
        for batch in (part for whole in batches for part in _slices(whole, "ids")):
            lists = batch["ids"]
            data, bounds = own.bytes_of(lists.flatten())
            ends = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())).astype(np.int64)
            raw, at = data.tobytes(), bounds[ends]
            whole = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = {"doc_id": batch["doc_id"], "ids": lists, "data": pa.array(whole, pa.binary())}
            if text:
                columns["text"] = pa.array([s.decode("utf-8", "replace") for s in whole], pa.string())
            if pieces:
                cut = bounds.tolist()
                split = [[raw[cut[k] : cut[k + 1]] for k in range(a, b)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns["token_texts"] = pa.array([_token_texts(s) for s in split], pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def decode(encoded: DataFrame, *, pieces: bool = False, ranks: str | None = None) -> DataFrame:
    """Bytes and text of every list of ids of ``encoded(doc_id, ids)``: ``doc_id, ids, data, text``.

    With ``pieces``, ``token_texts`` gives the text of each token; joined they are ``text``.
    """
    run = _decoding(ranks or tokens.vocabulary_path(RANK_FILE), True, pieces)
    ids = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return ids.mapInArrow(run, "doc_id long, ids array<int>, data binary, text string" + ", token_texts array<string>" * pieces)


def round_trip(docs: DataFrame, *, ranks: str | None = None) -> DataFrame:
    """``doc_id, ids, data``: texts encoded and their ids decoded again, by one worker a task."""
    path = ranks or tokens.vocabulary_path(RANK_FILE)
    there, back = _encoding(path, False), _decoding(path, False, False)
    return _texts(docs).mapInArrow(lambda batches: back(there(batches)), "doc_id long, ids array<int>, data binary")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ids = F.coalesce(F.array_join("ids", ","), F.lit(""))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
