"""Words of many texts at once, as arrays: where they are and a hash of each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Characters of text handled at once; a longer text is handled alone.
SLICE = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SEPARATOR = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; what one slice needs is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 2 * SLICE:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def odd_numbers(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Words:
    """raw: all texts' UTF-8 bytes, each followed by a space; text_ends: where the next text begins;
    hashes: of the words in order; first[k] .. first[k + 1]: the words of text k."""

    raw: np.ndarray
    gap: np.ndarray
    text_ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def scan_words(texts: list[str | None], lower: bool = False) -> Words:
    """Words are maximal runs without space, \\t, \\n, \\v, \\f, \\r; ``lower`` folds A-Z only."""
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    data = b" ".join(parts) + b" "
    raw = np.frombuffer(data.translate(_LOWER) if lower else data, np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    gap = _IS_SEPARATOR[raw]
    edge = np.diff(np.concatenate([[True], gap]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    # polynomial hash of each word from running sums
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _power(_BASE, len(raw)), dtype=np.uint64)])
    hashes = mix((sums[end] - sums[start]) * _power(_BASE_INVERSE, len(raw))[start])
    return Words(raw, gap, ends, hashes, np.concatenate([[0], np.searchsorted(start, ends)]))


def slices(texts: list[str | None], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` characters together."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > size:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)
