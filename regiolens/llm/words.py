"""Words of UTF-8 texts as 64-bit hashes, and hashes of runs of words.

Both are polynomials modulo 2**64 read off prefix sums: the sum of
``value[j] * BASE**j`` up to each place is kept, and a difference of two prefix
sums times ``BASE**-start`` is the polynomial of the run between them, wherever
the run lies.  A mixer finishes them.  Equal hashes are taken as equal words.
Long buffers are looked at in pieces cut at a separator, so memory is bounded
whatever a text's length (a single word longer than a piece makes one larger).
"""

from __future__ import annotations

from functools import cache

import numpy as np

from regiolens.llm.common import mix64

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_SEED = np.uint64(0xD1B54A32D192ED03)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and BASE**-j for the first 2**bits places."""
    def table(base: int) -> np.ndarray:
        out = np.ones(1 << bits, np.uint64)
        step = base
        for b in range(bits):
            out[1 << b:2 << b] = out[:1 << b] * np.uint64(step)
            step = step * step % (1 << 64)
        return out

    return table(_BASE), table(pow(_BASE, -1, 1 << 64))


def _runs(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _powers(max(10, int(len(values)).bit_length()))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:len(values)], out=sums[1:])
    return mix64((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64) * _SEED)


@cache
def byte_values(lower: bool) -> np.ndarray:
    """A random number for each byte; A-Z count as a-z when ``lower``."""
    v = mix64(np.arange(1, 257, dtype=np.uint64) * _SEED)
    if lower:
        v[65:91] = v[97:123]
    return v


def byte_set(separators: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(separators)] = True
    return mask


def _cuts(raw: np.ndarray, blank: np.ndarray) -> list[int]:
    """Ends of pieces of about PIECE bytes, each just after a separator."""
    cuts, a = [], 0
    while len(raw) - a > PIECE:
        cut = None
        for s in range(a + PIECE, len(raw), 1 << 16):
            hit = np.flatnonzero(blank[raw[s:s + (1 << 16)]])
            if len(hit):
                cut = s + int(hit[0]) + 1
                break
        if cut is None:
            break
        cuts.append(cut)
        a = cut
    return [*cuts, len(raw)]


def words_of(buf: bytes, blank: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of every maximal run of bytes not in ``blank``."""
    raw = np.frombuffer(buf, np.uint8)
    values = byte_values(lower)
    hashes, firsts, ends, a = [], [], [], 0
    for b in _cuts(raw, blank):
        part = raw[a:b]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~blank[part]
        step = np.diff(inside)
        first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        hashes.append(_runs(values[part], first, end))
        firsts.append(first + a)
        ends.append(end + a)
        a = b
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(ends)


def run_hashes(words: np.ndarray, n: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hash of the n words from each place (or each of ``starts``) on."""
    if starts is None:
        starts = np.arange(max(0, len(words) - n + 1))
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    step = 1 << 20  # a block of places, so the tables of powers stay small
    for a in range(int(starts[0]), int(starts[-1]) + 1, step):
        i, j = np.searchsorted(starts, [a, a + step])
        if j > i:
            s = starts[i:j] - a
            out[i:j] = _runs(words[a:a + step + n], s, s + n)
    return out


def window_min(values: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each place on."""
    if len(values) < n:
        return values[:0]
    have, out = 1, values
    while 2 * have <= n:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = n - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out
