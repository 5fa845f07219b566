"""Vectorised word hashing over the UTF-8 bytes of many texts at once (numpy, no Python loop over words)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken in slices of about so many bytes, so that memory doesn't follow the batch.
SLICE_BYTES = 1 << 19

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def series(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    start = (seed * 0xD1342543DE82EF95 + 1) & _MASK
    with np.errstate(over="ignore"):
        return mix(_U(start) + np.arange(1, n + 1, dtype=_U) * _U(_ODD))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the given inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Blanks: space, and tab to carriage return.
BLANK = byte_set((0x20, 0x20), (0x09, 0x0D))
#: Everything in ASCII but letters and digits.
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = series(11, 256)[_LOWER] | _U(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Cache(dict):
    """Powers made so far; it travels to workers empty."""

    def __reduce__(self):
        return _Cache, ()


_powers = _Cache()


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, SLICE_BYTES)
        got = np.full(size, base, _U)
        got[0] = 1
        with np.errstate(over="ignore"):
            got = np.cumprod(got, dtype=_U)
        _powers[base] = got
    return got[:n]


def _hash_slice(data: np.ndarray, bounds: np.ndarray, blank: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if n == 0:
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, _U), np.zeros(len(bounds), np.int64)
    is_blank = blank[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([True], is_blank[:-1])) | edge[:n]
    after = np.concatenate((is_blank[1:], [True])) | edge[1:]
    starts = np.flatnonzero(~is_blank & before)
    ends = np.flatnonzero(~is_blank & after) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[data] * _power(_BASE, n), dtype=_U, out=total[1:])
        back = _power(_INVERSE, n)[starts]
        hashes = mix((total[ends] - total[starts]) * back + (ends - starts).astype(_U) * _U(_ODD))
        if prefixes:
            columns = [hashes]
            for size in prefixes:
                part = mix((total[np.minimum(starts + size, n)] - total[starts]) * back - _U(size * 2 + 1))
                columns.append(np.where(ends - starts > size, part, _U(0)))
            hashes = np.stack(columns, axis=1)
    return hashes, np.searchsorted(starts, bounds)


def _long(data: np.ndarray, blank: np.ndarray, prefixes: tuple[int, ...]) -> np.ndarray:
    """Word hashes of one text longer than a slice, window by window, cut at blanks."""
    parts, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + SLICE_BYTES)
        while end < n:
            cut = np.flatnonzero(blank[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
                break
            end = min(n, end + SLICE_BYTES)
        parts.append(_hash_slice(data[at:end], np.array([0, end - at]), blank, prefixes)[0])
        at = end
    return np.concatenate(parts)


def hashed_words(texts: pa.Array, blank: np.ndarray = BLANK, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (index of the first text, word hashes, offsets of the texts in them), slice by slice.

    Words are maximal runs of bytes outside ``blank``, with A-Z lower-cased; a
    null text has no words. With ``prefixes`` (sizes in bytes) each word gives a
    row: its hash, then the hash of each prefix shorter than the word, else 0.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1
        j = min(n, max(j, i + 1))
        part = data[offsets[i] : offsets[j]]
        if j == i + 1 and len(part) > SLICE_BYTES:
            hashes = _long(part, blank, prefixes)
            yield i, hashes, np.array([0, len(hashes)])
        else:
            yield (i, *_hash_slice(part, offsets[i : j + 1] - offsets[i], blank, prefixes))
        i = j


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles of each text: (sorted hashes, offsets).

    A text with fewer words has its whole sequence as the one shingle; a text
    without words has none.
    """
    weights = series(23, width)
    counts = np.diff(offsets)
    out, ends = [], [0]
    with np.errstate(over="ignore"):
        if len(hashes) >= width:
            m = len(hashes) - width + 1
            rolled = np.zeros(m, _U)
            for j in range(width):
                rolled += hashes[j : j + m] * weights[j]
            rolled = mix(rolled)
        for k, c in enumerate(counts):
            at = int(offsets[k])
            if c >= width:
                got = np.unique(rolled[at : at + c - width + 1])
            elif c:
                got = mix((hashes[at : at + c] * weights[:c]).sum(dtype=_U, keepdims=True) + _U(int(c)))
            else:
                got = np.zeros(0, _U)
            out.append(got)
            ends.append(ends[-1] + len(got))
    return (np.concatenate(out) if out else np.zeros(0, _U)), np.array(ends, np.int64)
