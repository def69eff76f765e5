"""Parity sketches: XOR words over hashed partitions of a shingle set.

A band holds the sets of ``low < n <= high`` shingles. For a band the shingle space is
hashed into ``high`` parts; the sketch's word of a part is the XOR of the hashes of the
set's shingles there, so two words differ only if the symmetric difference touches that
part: the number of differing words is at most the size of the symmetric difference.
Sets of similarity ``t`` differ in at most ``(1-t)/(1+t)`` of their joint size, hence by
pigeonhole they agree in many words. A sketch keeps the first ``used`` parts of a band
and drops words without a shingle. In band 0 every shingle is a part of its own and the
``n - ceil(t*n) + 1`` smallest are kept, of which two similar sets must share one.
"""

from __future__ import annotations

import math

import numpy as np

from siltworks.llm.shingles import mix

FIRST = 32  # sets up to this size form band 0


def band_of(n: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(n, FIRST) / FIRST)).astype(np.int64)


def low_of(band: np.ndarray | int):
    """The largest size below a band (0 for band 0)."""
    return np.where(np.asarray(band) > 0, FIRST * 2.0 ** (np.asarray(band) - 1), 0)


def sketch_words(owner: np.ndarray, sh: np.ndarray, n: np.ndarray, t: float, used: int):
    """(text index, band, key) of every sketch word of every set, for its own band and each higher band that may hold a similar set.

    owner, sh: sorted distinct shingles by text; n: sizes."""
    out = []
    own = band_of(n)
    first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    rank = np.arange(len(sh), dtype=np.int64) - first[owner] if len(sh) else np.empty(0, np.int64)
    reach = own.copy()
    for _ in range(64):
        more = (n > 0) & (n >= t * (low_of(reach + 1) + 1))
        if not more.any():
            break
        reach[more] += 1
    for b in range(int(reach[n > 0].max()) + 1 if (n > 0).any() else 0):
        member = (n > 0) & (own <= b) & (b <= reach)
        if not member.any():
            continue
        if b == 0:
            prefix = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1
            pick = member[owner] & (rank < prefix[owner])
            out.append((owner[pick], np.zeros(int(pick.sum()), np.int64), mix(sh[pick] ^ np.uint64(0xA5A5))))
            continue
        parts = np.uint64(FIRST << b)
        pick = np.flatnonzero(member[owner])
        part = (mix(sh[pick] + np.uint64(0x51ED27 * b)) % parts).astype(np.int64)
        inside = part < used
        pick, part = pick[inside], part[inside]
        group = owner[pick] * used + part
        order = np.argsort(group, kind="stable")
        group, pick = group[order], pick[order]
        if not len(group):
            continue
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        word = np.bitwise_xor.reduceat(sh[pick], start)
        o, p = group[start] // used, (group[start] % used).astype(np.uint64)
        out.append((o, np.full(len(o), b, np.int64), mix(word + mix(p + np.uint64(b << 32)))))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def parity_bits(owner: np.ndarray, sh: np.ndarray, n_docs: int, longs: int) -> np.ndarray:
    """A bit sketch of ``64 * longs`` bits for each text: bit i is the parity of the shingles hashed to i."""
    bits = np.uint64(64 * longs)
    at = (mix(sh ^ np.uint64(0xC0FFEE)) % bits).astype(np.int64)
    flips = np.bincount(owner * int(bits) + at, minlength=n_docs * int(bits)).astype(np.uint8) & 1
    return np.packbits(flips.reshape(n_docs, int(bits)), axis=1, bitorder="little").view(np.uint64)


def most_apart(size_sum, t: float):
    """The largest symmetric difference of two sets of similarity t whose sizes add up to size_sum."""
    return np.floor(size_sum * (1 - t) / (1 + t) + 1e-9)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1)


def jaccard_at_least(inter, a, b, t: float):
    return inter >= t * (a + b - inter) - 1e-9
