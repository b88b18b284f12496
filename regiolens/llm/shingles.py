"""Sets of word shingles as 64-bit hashes, computed on UTF-8 bytes.

Words are runs of characters other than blank and \\x09-\\x0D, with A-Z in lower
case; a text's set holds its distinct runs of five consecutive words (with fewer
words, the whole sequence as one).  Hashes come from ``words``.  Equal hashes are
taken as equal shingles.
"""

from __future__ import annotations

import numpy as np

from regiolens.llm.common import mix64
from regiolens.llm.words import byte_set, run_hashes, words_of

WORDS = 5
CHUNK = 1 << 20  # bytes of short texts looked at together
_BLANK = byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _distinct(s: np.ndarray) -> np.ndarray:
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def sets_of(raws: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def close() -> None:
        words, at, _ = words_of(b"\n".join(group), _BLANK, lower=True)
        cut = np.searchsorted(at, np.cumsum([0, *(len(x) + 1 for x in group)])).tolist()
        runs = run_hashes(words, WORDS)  # those across texts are not taken
        for a, b in zip(cut, cut[1:], strict=False):
            out.append(_distinct(runs[a:b - WORDS + 1].copy()) if b - a >= WORDS else run_hashes(words[a:b], b - a) if b > a else words[:0])
        group.clear()

    for raw in raws:
        group.append(raw or b"")
        size += len(group[-1])
        if size >= CHUNK:
            close()
            size = 0
    if group:
        close()
    return out


def parity_sketch(s: np.ndarray) -> bytes:
    """One parity bit per hash bucket.  Two sets' sketches (folded to the shorter
    one's length) differ in at most as many bits as the sets differ in elements,
    so too many differing bits rule a pair out for certain."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    odd = np.bincount((mix64(s ^ _STEP) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """A lower bound of the sets' symmetric difference."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def fingerprint(s: np.ndarray) -> int | None:
    """One signed 64-bit number for a set; None for the empty set."""
    if not len(s):
        return None
    total = np.array([mix64(s + _STEP).sum(dtype=np.uint64)]) + np.array([len(s)], np.uint64) * _STEP
    return int(mix64(total).view(np.int64)[0])
