"""Hashes of all prefixes and suffixes of byte sequences, in batches with numpy.

Each is known by 124 bits: polynomials over random letters modulo four primes of 31 bits, whose running sums give the hash
of any part of a sequence, so that no part is ever copied. Two of n parts fall together by chance with a probability of
some n^2 / 2^125.
"""

from __future__ import annotations

import numpy as np

# The four largest primes below 2^31.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_BASES = (1_102_650_611, 987_654_347, 1_276_543_211, 1_534_567_891)
_LETTERS = np.random.default_rng(31).integers(1, PRIMES[-1], (len(PRIMES), 256), dtype=np.uint64)
_powers = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in PRIMES]


def _grown(n: int) -> list[list[np.ndarray]]:
    """For each prime, at least n powers of its base and of the base's inverse."""
    for k, (prime, base) in enumerate(zip(PRIMES, _BASES, strict=True)):
        for i, b in enumerate((base, pow(base, -1, prime))):
            p = _powers[k][i]
            while len(p) < n:
                p = np.concatenate((p, p * np.uint64(pow(b, len(p), prime)) % np.uint64(prime)))
            _powers[k][i] = p
    return _powers


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scrambling, so that sums of hashes say nothing about sums of what was hashed."""
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def part_hashes(seqs: list[bytes]) -> tuple[np.ndarray, ...]:
    """For each byte of each sequence, end to end: its depth, the two halves of the hash of what is before it, of what is
    before it and itself, and of itself and what is behind it; and whether it is the last one."""
    sizes = np.array([len(s) for s in seqs], np.int64)
    data = np.frombuffer(b"".join(seqs), np.uint8)
    start = np.cumsum(sizes) - sizes
    depth = np.arange(len(data)) - np.repeat(start, sizes)
    end = np.repeat(start + sizes, sizes)
    powers = _grown(int(sizes.max(initial=0)) + 1)
    before, upto, behind = ([] for _ in range(3))
    for prime, letters, (power, inverse) in zip(PRIMES, _LETTERS, powers, strict=True):
        p = np.uint64(prime)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * power[depth] % p, out=sums[1:])
        base = sums[end - np.repeat(sizes, sizes)]
        before.append((sums[:-1] - base) % p)
        upto.append((sums[1:] - base) % p)
        behind.append((sums[end] - sums[:-1]) % p * inverse[depth] % p)
    half = lambda x, i: x[2 * i] << np.uint64(31) | x[2 * i + 1]
    out = [half(x, i) for x in (before, upto, behind) for i in (0, 1)]
    return depth, *out, end - np.arange(len(data)) == 1
