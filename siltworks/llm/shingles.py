"""Vectorised word and shingle hashing for batches of texts.

Words are maximal runs of a-z and 0-9 in the lower-cased text. A shingle is ``k``
consecutive words; a text of 1..k words is one shingle. All hashes are 64 bit and
depend on nothing but the words, so they agree across tasks and runs.
"""

from __future__ import annotations

import numpy as np

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    member = np.zeros(256, dtype=bool)
    member[list(range(ord("a"), ord("z") + 1)) + list(range(ord("0"), ord("9") + 1))] = True
    value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    value[~member] = 0
    return member, value


_MEMBER, _VALUE = _alphabet()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = _CHUNK_BYTES
    while size < n:
        size *= 2
    if size not in _powers:
        with np.errstate(over="ignore"):
            up = np.full(size, np.uint64(_BASE), dtype=np.uint64)
            up[0] = 1
            down = np.full(size, np.uint64(_INV), dtype=np.uint64)
            down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
        if size > _CHUNK_BYTES:  # a single very long text: not kept
            return up, down
        _powers[size] = (up, down)
    return _powers[size]


def chunks(texts: list[str | None]):
    """Consecutive (first, last) index ranges whose texts stay within the byte budget of one step."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if size and size + n > _CHUNK_BYTES:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of its text), in order of text and position."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    joined = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    inside = _MEMBER[joined]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = _pow_tables(len(joined))
    total = np.cumsum(_VALUE[joined] * up[: len(joined)], dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    hashes = mix((total[ends - 1] - before) * down[starts])
    bounds = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.searchsorted(bounds, starts, side="right")


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle) pairs sorted and distinct, the number of shingles of each text, and a hash of each text's word sequence (0 without words)."""
    n = len(texts)
    h, doc = words(texts)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    with np.errstate(over="ignore"):
        pos = np.arange(len(h), dtype=np.int64) - first[doc] if len(h) else np.empty(0, np.int64)
        weight = mix((pos + 1).astype(np.uint64) * np.uint64(_BASE))
        sequence = np.zeros(n, np.uint64)
        has = count > 0
        if len(h):
            sequence[has] = mix(np.add.reduceat(h * (weight | np.uint64(1)), first[has])) | np.uint64(1)
        full = np.flatnonzero(pos + k <= count[doc]) if len(h) else np.empty(0, np.int64)
        acc = np.zeros(len(full), np.uint64)
        for j in range(k):
            acc = acc * np.uint64(_BASE) + h[full + j]
        owner = doc[full]
        short = np.flatnonzero(has & (count < k))
        if len(short):  # the whole text is one run
            owner = np.concatenate([owner, short])
            acc = np.concatenate([acc, sequence[short]])
        sh = mix(acc)
    order = np.lexsort((sh, owner))
    owner, sh = owner[order], sh[order]
    keep = np.ones(len(sh), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (sh[1:] != sh[:-1])
    owner, sh = owner[keep], sh[keep]
    return owner, sh, np.bincount(owner, minlength=n), sequence
