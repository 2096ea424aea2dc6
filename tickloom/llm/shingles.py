"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from tickloom.llm.common import ASCII_LOWER, Rolling, mix

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def word_hashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the bodies, A-Z lower-cased, and where each body's words begin and the last one's end."""
    joined = b" ".join(bodies).translate(ASCII_LOWER)
    data = np.frombuffer(joined, np.uint8)
    word = ~_BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    hashes = mix(Rolling(data).span(starts, ends) + (ends - starts).astype(np.uint64))
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1
    return hashes, np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))


def shingle_sets(bodies: list[bytes], k: int) -> list[np.ndarray]:
    """Each body's distinct k-word shingles, sorted; with fewer words the whole sequence as one, without words none.

    Shingles are told apart by 64 bits, so two different ones are taken for equal about once in 10**19 pairs.
    """
    hashes, at = word_hashes(bodies)
    grams = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        grams += hashes[j : j + len(grams)] * (_FACTORS[j % len(_FACTORS)] + np.uint64(2 * j))
    grams = mix(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                whole = mix(whole * _FACTORS[0] + h)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    h = mix(shingles)
    g = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    return int(h.sum()).to_bytes(8, "big") + int(g.sum() + np.uint64(len(shingles))).to_bytes(8, "big")
