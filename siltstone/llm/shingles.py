"""Word shingles of whole texts as 64-bit hashes, computed by numpy for a whole Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: white space of the word pattern [^\x20\x09-\x0D]+
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_SEED = np.random.default_rng(20240501)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_factors: dict[int, np.ndarray] = {}
#: texts are hashed in parts of so many bytes (or one text): this bounds a worker's memory at about 60 times that
PART = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factor(n: int, family: int) -> np.ndarray:
    """An independent odd factor for each of n places of a word."""
    known = _factors.get(family)
    if known is None or len(known) < n:
        known = mix(np.arange(max(n, 1 << 12), dtype=np.uint64) + np.array([family + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        if n <= PART:
            _factors[family] = known
    return known[:n]


def multilinear(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes that begins at one of the starts (the first is 0) and ends at the next."""
    lengths = np.diff(starts, append=len(data))
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(_BYTE[data] * _factor(int(lengths.max()), 0)[place], starts))


def shingles(texts: pa.Array, width: int, family: int = 0) -> Iterator[list[np.ndarray]]:
    """For each part of the texts, in order: each text's sorted distinct shingle hashes.

    A word's hash is the sum of its bytes' numbers, each times its place's own factor (multilinear, so no structure of
    the words makes two of them equal); families have independent factors.

    A-Z are lower-cased; words are runs without ASCII white space. A text with 1 to width - 1 words has one shingle,
    the whole sequence, that equals no full shingle; one without words (or null) has none.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PART, "right")) - 1)
        yield _part(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width, family)
        first = last


def _part(data: np.ndarray, offsets: np.ndarray, width: int, family: int) -> list[np.ndarray]:
    none = np.zeros(0, np.uint64)
    n_texts = len(offsets) - 1
    if not len(data):
        return [none] * n_texts
    text = _LOWER[data]
    blank = _BLANK[text]
    start = ~blank
    start[1:] &= blank[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    start[inner] = ~blank[inner]
    starts = np.flatnonzero(start)
    if not len(starts):
        return [none] * n_texts
    lengths = np.diff(starts, append=len(data))
    place = np.arange(len(data) - starts[0]) - np.repeat(starts - starts[0], lengths)
    value = np.where(blank, np.uint64(0), _BYTE[text])
    value[starts[0] :] *= _factor(int(lengths.max()), family)[place]
    words = mix(np.add.reduceat(value, starts))
    bounds = np.searchsorted(starts, offsets)  # words of text i: bounds[i] to bounds[i + 1]
    full = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        full += words[j : j + len(full)] * _PLACES[j]
    full = mix(full)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            h = np.sort(full[a : b - width + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif b > a:
            short = (words[a:b] * _PLACES[: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64) * _PLACES[63]
            out.append(mix(short))
        else:
            out.append(none)
    return out
