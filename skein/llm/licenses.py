"""Licence scan: Aho-Corasick over normalised words, and licence expressions by shunting-yard.

A text is lower-cased (A-Z only) and cut into words of digits, letters and non-ASCII characters. One
automaton run over the words finds every notice phrase and every identifier tag. Where a tag stands,
the expression after it is parsed: operators ``with``, ``and``, ``or`` in falling precedence, with
parentheses. The expression's value is how freely its text may be used, from 0 to 1: ``or`` offers the
freer side, ``and`` demands the stricter one. A document's score is its strictest notice.

Defined results: null and empty texts have no words, no labels, score 0 and null positions; a broken
expression gives the label ``unparsed`` and its known identifiers; repeated rows are scanned like any
other; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import textscan

#: The phrases every scan looks for.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Further notice phrases.
NOTICE_PHRASES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "cc0": "cc0",
    "public domain": "public-domain",
    "unlicense": "unlicense",
    "isc license": "isc",
    "proprietary and confidential": "proprietary",
    "copyright": "copyright",
}
#: Words of an identifier tag; an expression follows.
TAG_PHRASES = ("spdx license identifier", "license identifier")
#: How freely texts under a family may be used; the longest prefix of a label counts.
FREEDOM = {
    "cc0": 1.0,
    "public-domain": 1.0,
    "unlicense": 1.0,
    "mit": 0.95,
    "isc": 0.95,
    "bsd": 0.9,
    "apache": 0.9,
    "cc-by": 0.8,
    "mpl": 0.7,
    "epl": 0.65,
    "lgpl": 0.6,
    "cc-by-sa": 0.55,
    "gpl": 0.5,
    "agpl": 0.4,
    "cc-by-nd": 0.3,
    "cc-by-nc": 0.25,
    "copyright": 0.2,
    "reserved": 0.1,
    "proprietary": 0.05,
}
UNKNOWN_FREEDOM = 0.3
SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

_TAG = re.compile(r"license-identifier\s*:\s*([^\r\n]*)", re.IGNORECASE)
#: An expression ends with its comment, its sentence or its quotation.
_END = re.compile(r"-->|--%>|\*/|\*\)|#\}|\.(?=\s|$)|[;,\"'<>]")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9](?:[A-Za-z0-9.+:\-]*[A-Za-z0-9+])?")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_NORMAL = bytes(int(b) if textscan.LEXICAL[b] else 32 for b in textscan.LOWER)


def freedom(label: str) -> float:
    family = max((k for k in FREEDOM if label == k or label.startswith(k + "-")), key=len, default=None)
    return UNKNOWN_FREEDOM if family is None else FREEDOM[family]


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the expression's tokens with each operator behind its operands; None if broken."""
    out: list[str] = []
    held: list[str] = []
    operand_due = True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _PRECEDENCE:
            if operand_due:
                return None
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[low]:
                out.append(held.pop())
            held.append(low)
            operand_due = True
        elif token == "(":
            if not operand_due:
                return None
            held.append(token)
        elif token == ")":
            if operand_due:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand_due:
                return None
            out.append(low)
            operand_due = False
    if operand_due or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: str) -> tuple[set[str], float]:
    """(licence labels, freedom) of an expression, up to where its comment or sentence ends."""
    expression = _END.split(expression, maxsplit=1)[0]
    postfix = to_postfix(expression)
    if postfix is None:
        known = {t.lower() for t in _TOKEN.findall(expression) if freedom(t.lower()) != UNKNOWN_FREEDOM}
        return known | {"unparsed"}, min(map(freedom, known), default=0.0)
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            stack.append(({token}, freedom(token)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if token == "with":  # an exception widens what its licence allows
            stack.append(({f"{'+'.join(sorted(left))}-with-{'+'.join(sorted(right))}"}, a + (1 - a) / 4))
        else:
            stack.append((left | right, max(a, b) if token == "or" else min(a, b)))
    return stack[0]


@lru_cache(maxsize=4)
def automaton(extra: tuple[tuple[str, str], ...] = ()):
    """All phrases with a space on either side; each value holds (key length, base label, own label, tag)."""
    import ahocorasick

    found: dict[str, list] = {}
    for phrase, label in BASE_PHRASES.items():
        found.setdefault(phrase, [None, None, False])[0] = label
    for phrase, label in (*NOTICE_PHRASES.items(), *extra):
        found.setdefault(phrase, [None, None, False])[1] = label
    for phrase in TAG_PHRASES:
        found.setdefault(phrase, [None, None, False])[2] = True
    machine = ahocorasick.Automaton()
    for phrase, value in found.items():
        key = f" {phrase} ".encode().decode("latin-1")
        machine.add_word(key, (len(key), *value))
    machine.make_automaton()
    return machine


def scan_text(text: bytes, machine) -> tuple:
    """(words, base places, first, last, base labels, labels, score) of one UTF-8 text."""
    words = text.translate(_NORMAL).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places, base, labels, tagged = [], set(), set(), False
    for end, (length, base_label, own_label, tag) in machine.iter(line):
        tagged |= tag
        if base_label:
            places.append(end - length + 1)
            base.add(base_label)
        if own_label:
            labels.add(own_label)
    values = [freedom(x) for x in base | labels]
    labels |= base
    if tagged:
        for expression in _TAG.findall(text.decode("utf-8", "replace")):
            if expression.strip():
                names, value = evaluate(expression)
                labels |= names
                values.append(value)
    first = last = None
    if places:
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
        first, last = (int(np.searchsorted(spaces, p)) for p in (min(places), max(places)))
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(values, default=0.0)


def scan_licenses(docs: DataFrame, extra_phrases: dict[str, str] | None = None) -> DataFrame:
    """One row for each document of ``docs(doc_id, text)``."""
    extra = tuple(sorted((extra_phrases or {}).items()))
    names = [c.split()[0] for c in SCANNED.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(extra)
        for batch in batches:
            for lo, hi, offsets, data in textscan.chunks(batch["text"]):
                view, ends = data.tobytes(), offsets.tolist()
                rows = [scan_text(view[a:b], machine) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                columns = [batch["doc_id"].slice(lo, hi - lo), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SCANNED)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
