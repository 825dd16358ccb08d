"""Words of whole Arrow batches as arrays: places and 64-bit hashes, without a loop over words.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D. Its hash is a polynomial over a
random table of its bytes, taken from prefix sums, then mixed; equal words have equal hashes,
and two of a million different words share one with a chance of about 3e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 17
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=U)
_UPPER = np.arange(256)
_UPPER[65:91] += 32
_LOWER_TABLE = _TABLE[_UPPER]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others (a bijection)."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        p = np.full(n, b, U)
        p[0] = 1
        return np.cumprod(p)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


_POWERS = _powers(1)


def _hash_span(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends], all inside data."""
    global _POWERS
    if len(_POWERS[0]) < len(data) + 1:
        _POWERS = _powers(max(len(data) + 1, _STEP))
    up, down = _POWERS
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def bytes_and_offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its len + 1 offsets; null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each text (len + 1)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= word[cuts]
    last[cuts - 1] |= word[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, words before each text, bytes, starts, ends) of a string array."""
    data, offsets = bytes_and_offsets(texts)
    starts, ends, before = word_spans(data, offsets)
    out = np.empty(len(starts), U)
    values = _LOWER_TABLE if lower else _TABLE
    i = 0
    while i < len(starts):  # spans of a few MB of whole words, to bound memory
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _STEP, "right")))
        s = starts[i]
        out[i:j] = _hash_span(data[s : ends[j - 1]], starts[i:j] - s, ends[i:j] - s, values)
        i = j
    return out, before, data, starts, ends


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words (len - k + 1 of them), made by doubling."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out, have, power, size, at = None, hashes, 1, k, 0
    while True:  # binary parts of k, lowest first
        if size & 1:
            part = have[at : at + n]
            out = part.copy() if out is None else mix(out + U(power)) + part * U(_BASE)
            at += power
        size >>= 1
        if not size:
            return mix(out + U(k))
        m = len(have) - power
        have = mix(have[:m] + U(power)) + have[power:] * U(_BASE)
        power *= 2


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that no piece's texts have many more bytes than most_bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column_at = batch.schema.get_field_index(column)
        texts = batch.column(column_at)
        size = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, size[i] + most_bytes, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    pa.default_memory_pool().release_unused()  # workers live on between tasks


def shingle_sets(batch: pa.RecordBatch, text: str, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row's text."""
    hashes, before, *_ = hash_words(batch.column(batch.schema.get_field_index(text)), lower=True)
    full = rolling(hashes, size)
    for s, e in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if e - s >= size:
            yield np.unique(full[s : e - size + 1])
        else:
            yield rolling(hashes[s:e], e - s) if e > s else np.empty(0, U)


def class_of(s: np.ndarray) -> int:
    """A set's 64-bit key."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
