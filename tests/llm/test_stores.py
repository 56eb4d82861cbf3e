"""Token ids of special strings, the layout of token files, and odd rows of stores and archives."""

from __future__ import annotations

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skein.llm import tokens
from skein.llm.minhash import near_duplicates
from skein.llm.token_store import read_token_store, with_checksum, write_token_store
from skein.llm.warc_audit import read_archive, to_records, write_archive

SPECIAL = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n x", "plain text", "", "<|endo", "ftext|>", None, "é<|endoftext|>é", " two  spaces "]


def plain(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_special_tokens_are_the_librarys():
    encoder = tokens.PieceEncoder(tokens.vocabulary_path())
    found = [ids[a:b].tolist() for _, _, ids, ends in encoder.encode(pa.array(SPECIAL)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert found == plain(SPECIAL) and 50256 in found[0]


SHAPE = "doc_id long, text string, part long, ids string, start int"


def test_token_store_of_odd_rows(spark, tmp_path):
    long = "word " * 50_000
    rows = [(3, "b a"), (None, "x"), (1, None), (3, "b a"), (3, "a"), (2, long), (4, SPECIAL[1])]
    write_token_store(spark.createDataFrame([(d, t, 7, "ids", 7) for d, t in rows], SHAPE), f"{tmp_path}/odd")
    found = read_token_store(spark, f"{tmp_path}/odd").orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [(r.doc_id, r.ids) for r in found] == [(d, [*ids, 2]) for (d, _), ids in zip(order, plain([t for _, t in order]), strict=True)]
    assert [r.start for r in found] == np.cumsum([0, *[len(r.ids) for r in found[:-1]]]).tolist()
    write_token_store(spark.createDataFrame([], SHAPE), f"{tmp_path}/none")
    assert with_checksum(read_token_store(spark, f"{tmp_path}/none")).collect() == []


def test_layout_of_token_files(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_store(docs, f"{tmp_path}/store", parts=1, row_group_bytes=64 << 10, page_bytes=8 << 10)
    (path,) = glob.glob(f"{tmp_path}/store/tokens/*.parquet")
    meta = pq.ParquetFile(path).metadata
    assert meta.num_row_groups > 1
    columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    ids = next(c for name, c in columns.items() if name.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings)
    for name in ("doc_id", "start_in_part", "n_tokens"):
        assert "DELTA_BINARY_PACKED" in columns[name].encodings
        assert columns[name].has_offset_index and columns[name].has_column_index
    # metadata alone is read without the ids
    plan = read_token_store(spark, f"{tmp_path}/store", "doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("Physical Plan")[1]


def test_documents_that_share_an_id_keep_all_links(spark):
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(7, one), (7, two), (8, one + " tail"), (9, two + " tail"), (10, "else"), (None, one), (11, None)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2, percent=80).collect()
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == {7: 7, 8: 7, 9: 7, 10: 10, 11: 11}


@pytest.mark.parametrize("hub", [True, False])
def test_large_groups_and_blocks(spark, monkeypatch, hub):
    """Groups over several blocks: near copies of one text, and a chain in which only neighbours are near."""
    from skein.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    monkeypatch.setattr(minhash, "SHORT_LIST", 3)
    base = [f"w{k}" for k in range(100)]
    if hub:
        texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(80)]
    else:
        every = [f"w{k}" for k in range(700)]
        texts = [" ".join(every[8 * k : 8 * k + 100]) for k in range(75)]
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2, percent=80).collect()
    assert {r.component_id for r in found} == {1000 - len(texts) + 1}


def test_archive_of_odd_pages(spark, tmp_path):
    boundary = "x\r\n\r\nWARC/1.1\r\ny"
    rows = [(1, None, None, 5), (2, "http://a\r\nb", boundary, 5), (2, "http://a", "é" * 3000, 5), (None, "", "", 5), (2, "http://a", "é" * 3000, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file long")
    write_archive(to_records(pages, file_bytes=4000), f"{tmp_path}/w")
    found = read_archive(spark, f"{tmp_path}/w").collect()
    assert sorted((r.page_id or 0) for r in found) == [0, 1, 2, 2, 2] and len({r.file for r in found}) > 2
    for file in {r.file for r in found}:
        own = sorted((r.offset, r.length) for r in found if r.file == file)
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist()
    write_archive(to_records(pages.limit(0)), f"{tmp_path}/none")
    assert to_records(pages.limit(0)).collect() == []
