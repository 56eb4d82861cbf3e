"""What a worker holds at once while it fits and scores."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from skein.llm import textscan, toxicity


def peak(made):
    tracemalloc.start()
    made()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_words_of_a_text_batch_are_made_some_at_a_time():
    textscan._powers.clear()
    batch = pa.RecordBatch.from_pydict({"text": ["one three seventeen and others " * 100] * 1_500})  # 4.6 MB
    assert peak(lambda: [None for _ in toxicity.word_rows(batch["text"])]) < 40 << 20
    assert len(textscan._powers["up"]) <= 2 * textscan.POWER_STEP


def test_a_fit_holds_its_entries_as_small_numbers():
    """Two million entries: 16 MB as they come; every array of theirs with 64 bits would be as large again."""
    n, each = 4_000, 500
    own = np.sort(np.random.default_rng(1).choice(np.iinfo(np.int64).max, 2_000, replace=False))
    word = np.concatenate([np.sort(own[(k * 7 + np.arange(each)) % len(own)]) for k in range(n)])
    table = pa.table({"words": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * each), pa.array(word))})
    label = (np.arange(n) % 3 == 0).astype(float)
    assert peak(lambda: toxicity.fit(toxicity._numbered(table, own), label, np.zeros((n, 0)), iterations=2)) < 64 << 20
    rows = toxicity._numbered(table.slice(1_500), own)
    assert rows.n == 2_500 and (own[rows.word] == word[1_500 * each :]).all() and (rows.row == np.repeat(np.arange(2_500), each)).all()
    assert toxicity._numbered(table, own[:0]).n == n and not len(toxicity._numbered(table, own[:0]).row)


def test_a_text_batch_is_hashed_some_at_a_time_and_powers_stay_few():
    textscan._powers.clear()
    column = pa.array(["one three seventeen and others " * 100] * 1_500)  # 4.6 MB

    def hashed():
        for _, _, offsets, data in textscan.chunks(column):
            starts, ends, _ = textscan.words(offsets, data, textscan.SPACED)
            textscan.prime_hashes(data, starts, ends), textscan.span_hashes(data, starts, ends)

    assert peak(hashed) < 64 << 20
    assert sum(x.nbytes for x in textscan._powers.values()) < 32 << 20


def test_words_of_the_vocabulary_travel_as_places():
    batch = pa.RecordBatch.from_pydict({"text": ["one three", None, "others", "three others three"]})
    every = np.unique(np.concatenate([rows.word for _, _, rows in toxicity.word_rows(batch["text"])]))
    vocabulary = every[::2]
    (told,) = toxicity._batches_of_words(batch, [], vocabulary)
    (whole,) = toxicity._batches_of_words(batch, [])
    assert told["words"].type.value_type == pa.int32()
    known = set(vocabulary.tolist())
    assert [[int(vocabulary[k]) for k in row] for row in told["words"].to_pylist()] == [[w % 2**64 for w in row if w % 2**64 in known] for row in whole["words"].to_pylist()]
