"""Hashes of words, shingles and byte windows, vectorised over the bytes of an Arrow column of texts.

Everything rests on prefix sums of a polynomial in the bytes, modulo 2^64: the hash of any stretch is one subtraction and one
multiplication by an inverse power, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
# a worker's working arrays take some hundred times as many bytes
CHUNK = 1 << 18
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


PLAIN = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
LOWERED = PLAIN.copy()
LOWERED[65:91] = PLAIN[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True

_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse for i below n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """H with H[i] the hash of the first i bytes; a stretch [s, e) hashes to (H[e] - H[s]) * BASE^-s."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(table[data] * powers(len(data))[0], out=out[1:])
    return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts (or binaries), one after the other, and where each begins (one more entry)."""
    if texts.type != pa.large_binary():
        texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, beginnings) of about CHUNK bytes each, so that working arrays stay small."""
    data, at = bytes_of(texts)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, side="right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and where each text's begin. Words are runs of other bytes than white space, A-Z lowered;
    a text of fewer than k words has one shingle of all its words, a text without words none."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=U64), np.zeros(len(at), dtype=np.int64)
    solid = ~SPACE[data]
    inner = np.zeros(n + 1, dtype=bool)  # bytes that a text begins with
    inner[at] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | inner[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | inner[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    h = prefix(data, LOWERED)
    words = mix((h[e] - h[s]) * powers(n)[1][s] + (e - s).astype(U64))
    first = np.searchsorted(s, at)  # each text's first word
    m = len(words)
    weights = [U64((BASE * (2 * j + 3) * 0x2545F4914F6CDD1D + 2 * j + 1) % (1 << 64) | 1) for j in range(k)]
    sums = np.zeros(m, dtype=U64)
    for j in range(k):
        if m > j:
            sums[: m - j] += words[j:] * weights[j]
    counts = np.diff(first)
    shingled = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    shingled[short] = 1
    begins = np.concatenate([[0], np.cumsum(shingled)])
    out = np.empty(begins[-1], dtype=U64)
    text = np.repeat(np.arange(len(counts)), shingled)
    out[:] = sums[first[text] + np.arange(len(out)) - begins[text]]
    for i in short:
        a, c = first[i], counts[i]
        out[begins[i]] = np.add.reduce(words[a : a + c] * np.array(weights[:c], dtype=U64)) ^ mix(np.array([c], dtype=U64))[0]
    return mix(out), begins


def distinct_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for _, data, at in chunks(texts):
        h, begins = shingles(data, at, k)
        for i in range(len(begins) - 1):
            x = np.sort(h[begins[i] : begins[i + 1]])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x


def set_key(x: np.ndarray) -> int:
    """A signed 64-bit name of a set: equal sets have equal names."""
    if not len(x):
        return 0
    a = np.add.reduce(mix(x ^ U64(0xA0761D6478BD642F))) ^ np.bitwise_xor.reduce(x) ^ U64(len(x) * BASE % (1 << 64))
    return int(mix(np.array([a], dtype=U64)).astype(np.int64)[0])
