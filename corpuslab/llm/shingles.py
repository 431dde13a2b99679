"""Sets of word shingles as sorted 64-bit hashes, for a whole Arrow batch at a time, and their min-hash signatures.

Words are runs of anything but U+0020 and U+0009 to U+000D, after A-Z are lower-cased. A document's set is its distinct
``n``-word shingles; with fewer words, the whole sequence is the one member; without words it is empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
"""Bytes hashed at once; a longer word alone exceeds it."""
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WEIGHTS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(2 * PIECE, 1 << (n - 1).bit_length())
    if size not in _powers:
        one = np.ones(size, np.uint64)
        up, down = one.copy(), one.copy()
        up[1:], down[1:] = BASE, INVERSE
        if size > 2 * PIECE:  # rare; not kept
            return np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def _word_hashes(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in ``data`` (bytes); ``first`` marks bytes at which a document starts."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1] | first[1:]
    ends = ~space
    ends[:-1] &= space[1:] | first[1:]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return s, mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * WEIGHTS[8])


def sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """The sorted set of each text of a string array; null is empty."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low:high]
    at = offsets - low
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    begin = 0
    while begin < len(raw):
        end = min(len(raw), begin + PIECE)
        while end < len(raw):  # to a cut between words
            stop = raw[end : end + 4096]
            cut = np.flatnonzero((stop == 32) | ((stop >= 9) & (stop <= 13)) | first[end : end + len(stop)])
            if len(cut):
                end += int(cut[0])
                break
            end += len(stop)
        s, h = _word_hashes(raw[begin:end], first[begin:end])
        starts.append(s + begin)
        hashes.append(h)
        begin = end
    start, word = np.concatenate(starts), np.concatenate(hashes)
    bound = np.searchsorted(start, at)  # words before each document's start
    count = len(word) - n + 1
    window = np.zeros(max(count, 0), np.uint64)
    for k in range(n):
        window += word[k : k + count] * WEIGHTS[k] if count > 0 else np.uint64(0)
    window = mix(window)
    out = []
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    for i, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)):
        if not valid[i] or a == b:
            out.append(np.zeros(0, np.uint64))
        elif b - a < n:
            whole = (word[a:b] * WEIGHTS[: b - a]).sum(keepdims=True, dtype=np.uint64) + WEIGHTS[16 + b - a]
            out.append(mix(whole))
        else:
            out.append(np.unique(window[a : b - n + 1]))
    return out


def fingerprint(members: np.ndarray) -> bytes:
    """128 bits of a whole set."""
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def signatures(members: list[np.ndarray], positions: int, bits: int, seed: int = 1) -> np.ndarray:
    """For each set a row of ``positions`` min-hash values cut to ``bits`` bits; empty sets have zeros."""
    out = np.zeros((len(members), positions), np.int64)
    full = [i for i, m in enumerate(members) if len(m)]
    if not full:
        return out
    every = np.concatenate([members[i] for i in full])
    cuts = np.concatenate([[0], np.cumsum([len(members[i]) for i in full])[:-1]])
    factors = mix(np.arange(1, positions + 1, dtype=np.uint64) * BASE + np.uint64(seed)) | np.uint64(1)
    for j in range(positions):
        least = np.minimum.reduceat(every * factors[j], cuts)
        out[full, j] = (mix(least) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return out
