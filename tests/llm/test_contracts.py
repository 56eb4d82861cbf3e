"""Each query against a plain, slow version of what it has to return."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from skein.llm.queries import ORACLE_SQL, QUERIES


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").toPandas()


def texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").sort_values("doc_id")
    return [(int(d), t or "") for d, t in zip(docs.doc_id, docs.text, strict=True)]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return out


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def test_op1(spark, sf_dir, tokenizer):
    want, start = [], 0
    for doc_id, text in texts(spark, sf_dir):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert rows(QUERIES["op1_token_store"](spark, sf_dir), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_op2(spark, sf_dir):
    data = table(spark, sf_dir, "embeddings").sort_values("vec_id")
    ids = data.vec_id.tolist()
    x = np.stack([np.asarray(v, dtype=np.float64) for v in data.embedding])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    links = {(ids[a], ids[b]) for a, b in near}
    found = QUERIES["op2_near_vectors"](spark, sf_dir).toPandas().sort_values("vec_id")
    assert found.vec_id.tolist() == ids
    count = defaultdict(int)
    for pair in links:
        for v in pair:
            count[v] += 1
    want = np.array([count[v] for v in ids])
    assert (found.n_links.to_numpy() <= want).all()
    assert found.n_links.sum() >= 0.9 * want.sum()
    group = components(ids, links)
    assert np.mean([group[v] == c for v, c in zip(ids, found.component_id, strict=True)]) >= 0.9
    assert (found.kept == (found.vec_id == found.component_id)).all()


def test_op3(spark, sf_dir):
    docs = [(d, t.encode()) for d, t in texts(spark, sf_dir)]
    first, want = {}, []
    for doc_id, data in docs:
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], doc_id)
    for doc_id, data in docs:
        gone = np.zeros(len(data) + 1, dtype=bool)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < doc_id:
                gone[k : k + 50] = True
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        want.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert rows(QUERIES["op3_repeats"](spark, sf_dir), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_op4(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(ORACLE_SQL["op4_line_dedup"]).fetch_df()
    got = QUERIES["op4_line_dedup"](spark, sf_dir).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))


def test_op6(spark, sf_dir):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = []
    for doc_id, text in texts(spark, sf_dir):
        words = word.findall(text.translate(low))
        hits = [(k, label) for phrase, label in phrases.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in hits]
        want.append((doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    found = QUERIES["op6_licenses"](spark, sf_dir)
    assert sorted(map(tuple, found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=lambda r: r[0]) == want
    for r in found.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def shingle_groups(docs, size, percent):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, holders = {}, defaultdict(list)
    for doc_id, text in docs:
        words = word.findall(text.translate(low))
        sets[doc_id] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
        for s in sets[doc_id]:
            holders[s].append(doc_id)
    shared = defaultdict(int)
    for members in holders.values():
        for k, a in enumerate(members):
            for b in members[k + 1 :]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    return sets, components(list(sets), links)


def test_op9(spark, sf_dir):
    sets, group = shingle_groups(texts(spark, sf_dir), 2, 80)
    want = [(d, len(sets[d]), group[d], group[d] == d) for d in sorted(sets)]
    assert rows(QUERIES["op9_near_duplicates"](spark, sf_dir), "doc_id", "n_shingles", "component_id", "kept") == want


def test_op10(spark, sf_dir, tokenizer):
    want = []
    for doc_id, text in texts(spark, sf_dir):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        first, piece, start = (len(ids) - 1) % 2048 + 1, 0, 0
        for end in range(first, len(ids) + 1, 2048):
            want.append((doc_id, piece, start, end - start, crc(ids[start:end])))
            piece, start = piece + 1, end
    found = QUERIES["op10_pack"](spark, sf_dir).cache()
    assert rows(found, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want)
    filled = defaultdict(list)
    for r in found.collect():
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert len(filled) <= 1.01 * -(-sum(w[3] for w in want) // 2048) + 1
