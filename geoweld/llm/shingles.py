"""Distinct word shingles of whole texts as sorted 64-bit hashes, batch by batch in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split into words at once.
TEXT_BYTES = 1 << 20


def in_pieces(texts: pa.Array, size: int = TEXT_BYTES) -> Iterator[pa.Array]:
    """Slices of the array that hold about `size` bytes each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + size)))
        yield texts.slice(start, end - start)
        start = end


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `width` words, ASCII letters folded.

    A text with fewer words has one shingle, all its words; one without words,
    or a null one, has none.
    """
    for piece in in_pieces(texts.cast(pa.large_string())):
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(piece, "")))
        coded = pc.dictionary_encode(split.flatten())
        words = coded.dictionary.to_pylist()
        hashes = pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)
        real = np.array([w != "" for w in words], bool)
        at = coded.indices.to_numpy(zero_copy_only=False)
        keep = real[at] if len(at) else np.zeros(0, bool)
        h = hashes[at[keep]]
        bounds = np.concatenate([[0], np.cumsum(keep)])[split.offsets.to_numpy(zero_copy_only=False)]
        joined = _chain(h, width)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                yield np.unique(joined[a : b - width + 1])
            elif b > a:
                yield _chain(h[a:b], int(b - a))[:1]
            else:
                yield np.zeros(0, np.uint64)


def _chain(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    with np.errstate(over="ignore"):
        x = np.full(n, width, np.uint64)
        for k in range(width):
            x = (x ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        return x
