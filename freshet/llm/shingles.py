"""Word shingles as sorted arrays of 64-bit hashes, a batch of texts at a time.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. ``bytes.lower`` and
``bytes.split`` do exactly that on UTF-8.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix finaliser: spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` word hashes, in order; the length takes part."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = out * _MUL + hashes[k : k + m]
    return mix(out)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Distinct ``n``-word shingles, sorted; fewer words are one shingle; none: empty."""
    h = word_hashes(words_of(text))
    return np.unique(ngram_hashes(h, min(n, len(h)))) if len(h) else np.empty(0, np.uint64)


def lists_column(parts: list[np.ndarray]):
    """A ``list<int64>`` Arrow array of unsigned hashes, bit for bit."""
    import pyarrow as pa

    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
