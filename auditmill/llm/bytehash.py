"""Hashes of words, word shingles and byte windows, computed over whole Arrow blocks with numpy.

Windows have a polynomial over bytes, modulo 2**64 with an odd base and a fixed random value for each byte, then mixed; all of a block come from one
running sum. Such a hash is linear in the bytes, and colliding strings can be written down: it only brings candidates together. Words are
hashed eight bytes at a time through a mixer that is not linear, from a seed that the caller draws for each run, so that nobody can prepare words that collide.
Hashes depend on nothing but the bytes and the seed: every task, and every retry of a task, computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text that are hashed together; a longer text is a block of its own.
BLOCK_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise: spreads every bit of a 64-bit hash over all others."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The first k bytes of a little-endian word.
_FIRST = np.array([2 ** (8 * k) - 1 for k in range(9)], U64)
#: Words of more bytes are hashed one by one.
_LONG = 64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least; kept for the next block."""
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
                p = np.full(n, U64(base % 2**64))
                p[0] = 1
                _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0], _powers[1]


def blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about BLOCK_BYTES, each with its texts' bytes and offsets (n + 1 of them); a null text has no bytes."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not pa.types.is_large_binary(col.type):
            col = col.cast(pa.large_binary())
        if not len(col):
            continue
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))
        end = np.cumsum(size)
        at = 0
        while at < len(col):
            before = int(end[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(end, before + BLOCK_BYTES, side="right")))
            part = col.slice(at, to - at)
            data = np.frombuffer(b"".join(x or b"" for x in part.to_pylist()), dtype=np.uint8)
            offsets = np.concatenate([[0], np.cumsum(size[at:to])]).astype(np.int64)
            yield batch.slice(at, to - at), data, offsets
            at = to


def words(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word [^\\x20\\x09-\\x0D]+ of a block, A-Z as a-z, and for each text the number of its first word (n + 1 of them)."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    starts[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    ends[last] = inside[last]
    s, size = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    size -= s
    low = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    # the eight bytes from each place on
    eight = np.ndarray((n,), "<u8", buffer=low, strides=(1,))
    secret = mix(np.array([seed % 2**64], U64) + U64(BASE))[0]
    h = mix(size.astype(U64) * U64(0xD1B54A32D192ED03) ^ secret)
    open_, at = np.arange(len(s)), s
    for k in range(0, _LONG, 8):
        left = size[open_] - k
        h[open_] = mix((h[open_] ^ (eight[at] & _FIRST[np.minimum(left, 8)])) * U64(0x2545F4914F6CDD1D) + secret)
        more = left > 8
        open_, at = open_[more], at[more] + 8
        if not len(open_):
            break
    for w in np.flatnonzero(size > _LONG).tolist():
        h[w] = xxhash.xxh3_64_intdigest(low[s[w] : s[w] + size[w]].tobytes(), int(secret))
    return h, np.searchsorted(s, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, as sorted 64-bit hashes end to end, and where each text's begin (n + 1 of them).

    A text of fewer words has its whole sequence as one shingle; one without words has none."""
    h, first = words(data, offsets, seed)
    n_words = np.diff(first)
    per = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(per)])
    # one shingle starts at each of a text's first `per` words
    text = np.repeat(np.arange(len(per)), per)
    at = first[:-1][text] + np.arange(begin[-1]) - begin[:-1][text]
    length = np.minimum(n_words[text], k)
    padded = np.concatenate([h, np.zeros(k, U64)])
    out = length.astype(U64)
    for j in range(k):
        out = np.where(j < length, mix(out * U64(0x2545F4914F6CDD1D) + padded[at + j]), out)
    parts, sizes = [], np.zeros(len(per) + 1, np.int64)
    for i in range(len(per)):
        own = out[begin[i] : begin[i + 1]]
        if len(own) > 1:
            own = np.unique(own)
        parts.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.cumsum(sizes)
