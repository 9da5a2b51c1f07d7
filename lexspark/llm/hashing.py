"""Hashes of words and shingles in whole batches of texts, with numpy.

Words are cut and hashed in the bytes of a batch at once: two polynomials over random letters modulo two primes of 31
bits, whose prefix sums give the hash of any range, then a mixing step. Modulo primes no regular words fall together, as
they would modulo 2^64. Two different words or shingles that fall together by chance are not told apart: among n of them
some n^2 / 2^63 pairs do.
"""

from __future__ import annotations

import numpy as np

#: Prime moduli and bases; products of two residues fit into 64 bits.
_PRIMES = ((2**31 - 1, 1_102_650_611), (2**31 - 19, 987_654_347))
_LETTERS = np.random.default_rng(20).integers(1, 2**31 - 19, (len(_PRIMES), 256), dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes handled at once; longer texts go in pieces cut at blanks.
PIECE = 1 << 18
_powers = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _PRIMES]


def powers(n: int) -> list[list[np.ndarray]]:
    """For each prime the powers of the base and of its inverse, at least n of them."""
    for k, (prime, base) in enumerate(_PRIMES):
        for i, b in enumerate((base, pow(base, -1, prime))):
            p = _powers[k][i]
            while len(p) < n:  # the next as many are these times the first that lacks
                p = np.concatenate((p, p * np.uint64(pow(b, len(p), prime)) % np.uint64(prime)))
            _powers[k][i] = p
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on all bits of x."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> list[np.ndarray]:
    """For each prime, the sums of letter times power before each byte; at most PIECE terms and a word below 2^31."""
    out = []
    for (prime, _), letters, (p, _) in zip(_PRIMES, _LETTERS, powers(len(data) + 1), strict=True):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * p[: len(data)] % np.uint64(prime), out=sums[1:])
        out.append(sums)
    return out


def range_hash(sums: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = None
    for (prime, _), own, (_, inverse) in zip(_PRIMES, sums, powers(len(sums[0])), strict=True):
        h = (own[end] - own[start]) % np.uint64(prime) * inverse[start] % np.uint64(prime)
        out = h if out is None else out << np.uint64(31) | h
    return mix(out)


def window_hash(sums: list[np.ndarray], size: int) -> np.ndarray:
    """``range_hash`` of every range of ``size`` bytes, in order."""
    out = None
    for (prime, _), own, (_, inverse) in zip(_PRIMES, sums, powers(len(sums[0])), strict=True):
        h = own[size:] - own[:-size]
        h %= np.uint64(prime)
        h *= inverse[: len(h)]
        h %= np.uint64(prime)
        out = h if out is None else out << np.uint64(31) | h
    return mix(out)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word, and its hash with A-Z in lower case."""
    blank = _BLANK[data]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return start, range_hash(prefix_sums(_LOWER[data]), start, end)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of the words of each text, in order."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            data = np.frombuffer(b" ".join(group), np.uint8)
            start, h = _words(data)
            offsets = np.cumsum([0] + [len(t) + 1 for t in group])
            cut = np.searchsorted(start, offsets)
            out.extend(h[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            group.clear()
            size = 0

    for t in texts:
        if len(t) <= PIECE:
            if size + len(t) > PIECE:
                flush()
            group.append(t)
            size += len(t) + 1
            continue
        flush()
        data, parts, a = np.frombuffer(t, np.uint8), [], 0
        while a < len(t):
            b = min(len(t), a + PIECE)
            while b < len(t) and not _BLANK[data[b]]:
                gap = np.flatnonzero(_BLANK[data[b : b + PIECE]])
                b = b + int(gap[0]) if len(gap) else min(len(t), b + PIECE)
            parts.append(_words(data[a:b])[1])
            a = b
        out.append(np.concatenate(parts))
    flush()
    return out


_FACTORS = np.random.default_rng(21).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words make one shingle, none make an empty set."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(size, len(words))
    total = words[: len(words) - k + 1] * _FACTORS[0]
    for i in range(1, k):
        total = total + words[i : len(words) - k + 1 + i] * _FACTORS[i]
    return np.unique(mix(total + np.uint64(k)))
