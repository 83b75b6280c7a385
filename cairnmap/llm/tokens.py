"""Vectorised word hashing shared by the Arrow-based operators.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; A-Z fold to a-z.  Words are hashed with a
polynomial over Z/2^64 followed by a finaliser, straight from the Arrow data buffer, so no Python string is made.
Work memory follows ``BLOCK`` (or the longest single word), not the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += 32
_LOW += 1
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        step = np.full(max(n, BLOCK + 4096), base, np.uint64)
        step[0] = 1
        have = _powers[str(base)] = np.multiply.accumulate(step)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every input bit reaches every output bit)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and the n+1 offsets of the texts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cut(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where no word is split."""
    nxt = np.searchsorted(offsets, at)
    limit = int(offsets[nxt]) if nxt < len(offsets) else len(data)
    while at < limit:
        hit = np.flatnonzero(_SPACE[data[at : min(limit, at + 65536)]])
        if len(hit):
            return at + int(hit[0])
        at = min(limit, at + 65536)
    return limit


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """Yields (block start, block bytes, word starts, word ends); starts and ends count from the block start."""
    lo, n = 0, len(data)
    while lo < n:
        hi = n if n - lo <= BLOCK else _cut(data, offsets, lo + BLOCK)
        b = data[lo:hi]
        inside = ~_SPACE[b]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        inner = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        inner = inner[inner < len(b)]
        first[inner] = inside[inner]
        before = inner[inner > 0] - 1
        last[before] = inside[before]
        yield lo, b, np.flatnonzero(first), np.flatnonzero(last) + 1
        lo = hi


def word_hashes(texts: pa.Array, prefix: int = 0):
    """(hash of each word, offsets of the texts in it[, hash of each word's first ``prefix`` bytes, 0 for shorter words])."""
    data, offsets = buffer_of(texts)
    hashes, heads, places = [], [], []
    for lo, b, start, end in word_spans(data, offsets):
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_LOW[b] * _power(_P, len(b))[: len(b)], out=sums[1:])
        back = _power(_PINV, len(b))[start]
        hashes.append(mix((sums[end] - sums[start]) * back))
        if prefix:
            long = end - start > prefix
            head = mix((sums[np.minimum(start + prefix, len(b))] - sums[start]) * back + np.uint64(77))
            heads.append(np.where(long, head, np.uint64(0)))
        places.append(start + lo)
    none = np.zeros(0, np.uint64)
    found = np.concatenate(hashes) if hashes else none
    words = np.searchsorted(np.concatenate(places) if places else np.zeros(0, np.int64), offsets)
    if prefix:
        return found, words, (np.concatenate(heads) if heads else none)
    return found, words


_INNER = np.ones(256, bool)
_INNER[[b for b in range(128) if not chr(b).isalnum()]] = False


def bare_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word from its first letter or digit on, offsets of the texts in them, number of each in all words of its
    text).  Words without letter or digit are none; whatever is not ASCII counts as a letter."""
    data, offsets = buffer_of(texts)
    hashes, places, numbers, before = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for lo, b, start, end in word_spans(data, offsets):
        inner = np.flatnonzero(_INNER[b])
        place = np.searchsorted(inner, start)
        real = np.flatnonzero(place < np.searchsorted(inner, end))
        first, last = inner[place[real]], end[real]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_LOW[b] * _power(_P, len(b))[: len(b)], out=sums[1:])
        hashes.append(mix((sums[last] - sums[first]) * _power(_PINV, len(b))[first]))
        places.append(first + lo)
        doc = np.searchsorted(offsets, start + lo, "right") - 1
        # Words of earlier blocks count, too, for a text that began in one.
        opened = np.searchsorted(doc, doc)
        number = np.arange(len(start)) - opened
        if len(doc) and before and before[0] == doc[0]:
            number[doc == doc[0]] += before[1]
        if len(doc):
            before = (int(doc[-1]), int(number[-1]) + 1)
        numbers.append(number[real])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets), np.concatenate(numbers)


def chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive items (one for each start that has k items)."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(_P) + hashes[j : j + n]
    return mix(out)


def shingle_sets(hashes: np.ndarray, words: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; with fewer words, the whole sequence as one; without words, none."""
    all_runs, sets = chain(hashes, k), []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
        if b - a >= k:
            sets.append(np.unique(all_runs[a : b - k + 1]))
        else:
            sets.append(chain(hashes[a:b], b - a) if b > a else hashes[:0])
    return sets


def slices(n_bytes: np.ndarray, most: int = 8 << 20):
    """Row ranges of a batch, each of about ``most`` bytes of text at most (one row at least)."""
    lo, total = 0, 0
    for i, x in enumerate(n_bytes.tolist()):
        if i > lo and total + x > most:
            yield lo, i
            lo, total = i, 0
        total += x
    if len(n_bytes) > lo:
        yield lo, len(n_bytes)


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
