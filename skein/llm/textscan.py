"""Array-at-a-time scanning of text batches: bytes, words, hashes.

Everything here works on the UTF-8 buffer behind an Arrow string column, so a batch of documents is
handled by a few numpy passes and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are scanned at once: arrays of eight bytes a character are made from them.
CHUNK_BYTES = 1 << 19
#: Powers are kept by every worker as long as it lives, so as many as its longest text needs, in steps of so many.
POWER_STEP = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is True inside the given inclusive byte ranges."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Words of the near-duplicate operators: everything but ASCII white space.
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of the lexical operators: digits, lower-case letters and every non-ASCII character.
LEXICAL = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = -(-n // POWER_STEP) * POWER_STEP
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: (first row, row after the last, offsets, bytes)."""
    offsets, data = string_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


def words(offsets: np.ndarray, data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of word bytes; runs end with their document."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = table[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    ends[edges - 1] = inside[edges - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(offsets, first, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Primes below 2**31 and a base for each, so products of two remainders fit into 64 bits.
_PRIMES = ((2147483647, 1103515249), (2147483629, 843314861))


def _prime_powers(n: int) -> list[tuple[np.uint64, np.ndarray, np.ndarray]]:
    """(prime, powers of its base, powers of the base's inverse), ``n`` of them at least."""
    if len(_powers.get("up0", ())) < n:
        size = -(-n // POWER_STEP) * POWER_STEP
        for k, (prime, base) in enumerate(_PRIMES):
            for key, step in ((f"up{k}", base), (f"down{k}", pow(base, -1, prime))):
                out = np.ones(size, dtype=np.uint64)
                done = 1
                while done < size:
                    more = min(done, size - done)
                    out[done : done + more] = out[:more] * np.uint64(pow(step, done, prime)) % np.uint64(prime)
                    done += more
                _powers[key] = out.astype(np.uint32)  # kept by every worker, as long as the longest text
    return [(np.uint64(prime), _powers[f"up{k}"], _powers[f"down{k}"]) for k, (prime, _) in enumerate(_PRIMES)]


def prime_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span from two polynomials modulo primes.

    Modulo a power of two, as in ``span_hashes``, some texts of a few thousand characters are equal for every base.
    """
    out = (ends - starts).astype(np.uint64)
    raw = data.astype(np.uint64) + np.uint64(1)
    for prime, up, down in _prime_powers(len(data) + 1):
        terms = raw * up[: len(data)]
        if len(data) > 1 << 24:  # the sum would pass 64 bits
            terms %= prime
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(terms, out=total[1:])
        value = (total[ends] - total[starts]) % prime * down[starts] % prime
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + value)
    return out


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` bytes."""
    starts = np.arange(max(0, len(data) - width + 1))
    return span_hashes(data, starts, starts + width)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[k : n + k])
    return out
