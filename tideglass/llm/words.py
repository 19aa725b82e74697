"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: Bytes hashed in one step; a longer word is still hashed whole.
STEP = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, dtype=np.uint64)


def byte_set(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


#: Bytes of words ``[^\x20\x09-\x0D]+``, and of words of digits, letters and all characters beyond ASCII.
NOT_SPACE = byte_set(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALPHANUMERIC = byte_set(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1024) - 1, _BASE, np.uint64), dtype=np.uint64)))
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every run of ``inside`` bytes; no run crosses two texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_in = inside[data]
    before, after = np.empty_like(is_in), np.empty_like(is_in)
    before[0], before[1:] = False, is_in[:-1]
    after[-1], after[:-1] = False, is_in[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(is_in & ~before), np.flatnonzero(is_in & ~after) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span's bytes (A-Z as a-z if ``lower``); equal spans have equal hashes."""
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    total = np.cumsum(lengths)
    at = 0
    while at < len(starts):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + STEP, side="right")))
        n = lengths[at:to]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        raw = data[place + np.repeat(starts[at:to], n)]
        value = ((_LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)) * powers(int(n.max()) + 1)[place]
        out[at:to] = np.add.reduceat(value, first)
        at = to
    return mixed(out + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def of_text(text: str, lower: bool = True) -> int:
    """The hash of one word."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]), lower)[0])


def shingles(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows."""
    m = len(word_hashes) - n + 1
    h = np.zeros(max(m, 0), np.uint64)
    for i in range(n):
        h = h * np.uint64(0x2545F4914F6CDD1D) + word_hashes[i : i + len(h)]
    return mixed(h)
