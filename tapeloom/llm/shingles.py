"""Word shingles and sketches in vectorised numpy, a chunk of texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np

from tapeloom.llm.common import joined_bytes, mix

_BASE = 0x9E3779B97F4A7C15 | 1
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the first word of each text (one more at the end)."""
    data, starts = joined_bytes(texts)
    b = np.frombuffer(data.lower(), np.uint8)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    first, end = edge[::2], edge[1::2]
    up, down = powers(len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)])])
    hashes = mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(first, starts)


def shingle_sets(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts, and the offsets of each text's set.

    A text with fewer words than ``size`` has its whole sequence as the one shingle; one without words has none.
    """
    w, at = word_hashes(texts)
    n = np.diff(at)
    odd = mix(np.arange(size, dtype=np.uint64), 5) | np.uint64(1)

    def combined(begin: np.ndarray, length: int) -> np.ndarray:
        out = np.full(len(begin), length, np.uint64)
        for k in range(length):
            out = out + w[begin + k] * odd[k]
        return mix(out, 7)

    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.cumsum(counts)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    text = np.repeat(np.arange(len(texts)), counts)
    begin = at[:-1][text] + (np.arange(len(flat)) - (ends - counts)[text])
    full = n[text] >= size
    flat[full] = combined(begin[full], size)
    for length in range(1, size):
        some = n[text] == length
        flat[some] = combined(begin[some], length)
    for e, c in zip(ends.tolist(), counts.tolist(), strict=True):
        flat[e - c:e].sort()
    new = np.ones(len(flat), bool)
    if len(flat):
        new[1:] = (flat[1:] != flat[:-1]) | (text[1:] != text[:-1])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(texts)))]).astype(np.int64)
    return flat[new], offsets


def set_keys(flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 128-bit key of each sorted set; equal sets have equal keys."""
    raw = flat.tobytes()
    return [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def fast_similarity_sketch(flat: np.ndarray, offsets: np.ndarray, bits: int = 7) -> np.ndarray:
    """Fast similarity sketches (sets x 2^bits coordinates).

    In round i every element is placed by a fresh hash into one bin, with value i plus a hashed fraction; a bin keeps
    its least value. Rounds stop once no bin is empty. From round t = 2^bits on, the round fills one fixed bin, so
    that after 2t rounds every coordinate of a non-empty set is surely filled. Two sets agree in a coordinate with
    probability equal to their Jaccard similarity, and the number of agreements is concentrated as with independent
    coordinates. Empty sets have all coordinates at the greatest value.
    """
    t = 1 << bits
    count = len(offsets) - 1
    sketch = np.full((count, t), _EMPTY)
    sizes = np.diff(offsets)
    owner, h = np.repeat(np.arange(count), sizes), flat
    for i in range(2 * t):
        if not len(h):
            break
        x = mix(h, i + 1)
        where = (x >> np.uint64(64 - bits)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(sketch.reshape(-1), owner * t + where, (np.uint64(i) << np.uint64(55)) | (x & np.uint64((1 << 55) - 1)))
        open_ = np.zeros(count, bool)
        left = np.unique(owner)
        open_[left] = (sketch[left] == _EMPTY).any(axis=1)
        stay = open_[owner]
        owner, h = owner[stay], h[stay]
    return sketch


def minhash_signatures(flat: np.ndarray, offsets: np.ndarray, count: int = 128) -> np.ndarray:
    """Classical MinHash: the least value of each of ``count`` universal hash functions over a set (32 bits each).

    The functions are multiply-shift with odd 64-bit multipliers and 64-bit offsets; an empty set has all ones.
    """
    out = np.full((len(offsets) - 1, count), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        seeds = mix(np.arange(2 * count, dtype=np.uint64), 11)
        for k in range(count):
            values = ((flat * (seeds[2 * k] | np.uint64(1)) + seeds[2 * k + 1]) >> np.uint64(32)).astype(np.uint32)
            out[some, k] = np.minimum.reduceat(values, offsets[:-1][some])
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates, different for every band."""
    bands = sketch.shape[1] // rows
    cells = sketch[:, :bands * rows].astype(np.uint64).reshape(len(sketch), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sketch), bands)).copy()
    for k in range(rows):
        out = mix(out + cells[:, :, k], 23 + k)
    return out.view(np.int64)
