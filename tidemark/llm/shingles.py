"""Word shingles of whole texts as 64-bit fingerprints, computed with numpy over Arrow buffers.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D after A-Z became a-z (UTF-8 continuation
bytes are 0x80 and above, so this equals the regular expression ``[^\\x20\\x09-\\x0D]+`` over code points).
A text's shingles are its runs of ``width`` words; a text with fewer words has one shingle, the whole sequence; a text
without words has none.  Two different shingles share a fingerprint with a chance of about 2**-64 per pair.

Texts are handled in chunks of a few megabytes, so memory is bounded by the chunk or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
CHUNK_BYTES = 2 << 20

_MASK = (1 << 64) - 1


def _splitmix_stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers from the splitmix64 generator."""
    out, state = [], seed
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


_BYTE = _splitmix_stream(1, 256)
_LETTER = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD = np.uint64(0xD6E8FEB86659FD93)
_COUNT = np.uint64(0xA0761D6478BD642F)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def string_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows whose texts hold about ``chunk_bytes``; null texts are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()) if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else column.cast(pa.large_string()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + chunk_bytes, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint of each word, first byte of each word, index of the first word of each text and the total)."""
    size = len(data)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    fresh = np.empty(size, dtype=bool)
    fresh[0] = True
    np.logical_not(solid[:-1], out=fresh[1:])
    fresh[offsets[:-1][offsets[:-1] < size]] = True
    starts = np.flatnonzero(fresh & solid)
    per_text = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, per_text
    spans = np.diff(np.append(starts, size))
    place = np.arange(starts[0], size) - np.repeat(starts, spans)
    inside = solid[starts[0] :]
    # what follows a word up to the next one is white space or, at a text's start, nothing
    value = _BYTE[_LOWER[data[starts[0] :]]]
    value *= powers(_LETTER, int(spans.max()))[place]
    value[~inside] = 0
    h = np.add.reduceat(value, starts - starts[0])
    return mix(h), starts, per_text


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all runs of ``width`` words, across text borders too; entry i begins at word i."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = powers(_WORD, width)
    h = words[:n] * factor[0]
    for j in range(1, width):
        h += words[j : j + n] * factor[j]
    return mix(h + np.uint64(int(_COUNT) * width & _MASK))


def shingle_sets(column: pa.Array, width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
    """For each row the sorted distinct fingerprints of its shingles (uint64)."""
    for _, data, offsets in string_chunks(column, chunk_bytes):
        words, _, first = word_table(data, offsets)
        h = runs(words, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(h[a : b - width + 1])
            elif b > a:
                yield runs(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)
