"""Distances between words: adjacent swaps count once, some characters are equal, and rewrite pairs cost nothing.

Equal characters cost nothing; replacing, inserting, deleting a character or swapping neighbours costs one. A rewrite
pair with a target of one or two characters costs nothing where its key stands in the word and its target in the
candidate; up to there from the rewrite before, or from the start, both sides must have equally many characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property, lru_cache
from math import prod

import numpy as np

from ..sources.metadata import Metadata


@lru_cache(100_000)
def base_char(c: str) -> str:
    """The first character of the canonical decomposition."""
    return unicodedata.normalize("NFD", c)[0]


@dataclass(frozen=True)
class Rules:
    """What counts as equal, and the rewrite pairs: (key, target, only at the start, only at the end)."""

    ignore_diacritics: bool = False
    convert_case: bool = False
    equivalent: frozenset[tuple[str, str]] = frozenset()  # (of the word, of the candidate)
    short: tuple[tuple[str, str, bool, bool], ...] = ()  # targets of one or two characters
    long: tuple[tuple[str, str, bool, bool], ...] = ()

    @staticmethod
    def of(m: Metadata) -> Rules:
        pairs = [(k.removeprefix("^").removesuffix("$"), t, k.startswith("^"), k.endswith("$")) for k, t in m.replacement_pairs]
        short = tuple(p for p in pairs if len(p[1]) in (1, 2) and p[0])
        return Rules(m.ignore_diacritics, m.convert_case, frozenset(m.equivalent_chars), short, tuple(p for p in pairs if len(p[1]) > 2 and p[0]))

    def equal(self, x: str, y: str) -> bool:
        """x of the word, y of the candidate."""
        if x == y or (x, y) in self.equivalent:
            return True
        if not self.ignore_diacritics:
            return False
        a, b = base_char(x), base_char(y)
        return a == b or self.convert_case and a.isalpha() and a.islower() != b.islower() and a.lower() == b.lower()

    @cached_property
    def classes(self) -> dict[str, str]:
        """Characters that equivalents join, by the smallest of their class: those that a chain of equivalents connects,
        in either direction."""
        return joined((self._bare(a), self._bare(b)) for a, b in self.equivalent)

    @cached_property
    def knots(self) -> dict[str, str]:
        """Characters that short pairs or equivalents join, by the smallest of their class: all of a key and its target."""
        parts = [(self.classes.get(x, x), self.classes.get(y, y)) for k, t, *_ in self.short for x, y in zip(self._bare(k + t), self._bare(k + t)[1:], strict=False)]
        return joined(parts + [(x, x) for k, t, *_ in self.short for c in self._bare(k + t) if (x := self.classes.get(c, c))])

    @property
    def alike(self) -> bool:
        """Whether characters are equal just where their classes are, and the classes are all that there is."""
        same = {(x, y) for x, a in self.classes.items() for y, b in self.classes.items() if a == b and x != y}
        return not (self.short or self.ignore_diacritics) and same == {p for p in self.equivalent if p[0] != p[1]}

    def _bare(self, word: str) -> str:
        if not self.ignore_diacritics:
            return word
        word = "".join(map(base_char, word))
        return word.lower() if self.convert_case else word

    def folded(self, word: str) -> str:
        """Equal characters fold together, and those that are equal through others."""
        word = self._bare(word)
        return "".join([self.classes.get(c, c) for c in word]) if self.classes else word

    def collapsed(self, word: str) -> str:
        """The folded word with each run of characters of one knot as a single one: words that short pairs turn into one
        another have the same, and one edit changes it in at most two places."""
        out: list[str] = []
        for c in self.folded(word):
            knot = self.knots.get(c)
            if knot is None or not out or out[-1] != knot:
                out.append(knot or c)
        return "".join(out)


def joined(pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Each member of the pairs with the smallest one that a chain of them leads to."""
    least: dict[str, str] = {}

    def find(x: str) -> str:
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        least[b] = a
    return {x: find(x) for x in list(least)}


def _table(word: str, candidate: str, equal) -> list[list[int]]:
    """Costs between all prefixes of both."""
    rows = [list(range(len(candidate) + 1))]
    for i, x in enumerate(word, 1):
        above, row = rows[-1], [i]
        for j, y in enumerate(candidate, 1):
            d = above[j - 1]
            if not equal(x, y):
                d = 1 + min(d, above[j], row[-1])
                if i > 1 and j > 1 and x == candidate[j - 2] and word[i - 2] == y:
                    d = min(d, 1 + rows[i - 2][j - 2])
            row.append(d)
        rows.append(row)
    return rows


def distance(word: str, candidate: str, rules: Rules = Rules(), limit: int | None = None) -> int:
    """The distance, or ``limit`` + 1 if it is larger than that."""
    far = len(word) + len(candidate) + 1 if limit is None else limit + 1
    if not rules.short and abs(len(word) - len(candidate)) >= far:
        return far
    best, points = far, {(0, 0): 0}  # the start and the ends of rewrites, with what it costs to get there
    while points:
        i, j = min(points)
        cost = points.pop((i, j))
        table = _table(word[i:], candidate[j:], rules.equal)
        best = min(best, cost + table[-1][-1])
        for k in range(min(len(word) - i, len(candidate) - j) + 1 if rules.short else 0):
            here = cost + table[k][k]
            if here >= best:
                continue
            a, b = i + k, j + k
            for key, target, start, end in rules.short:
                if (not start or a == 0) and (not end or a + len(key) == len(word)) and word.startswith(key, a) and candidate.startswith(target, b):
                    to = (a + len(key), b + len(target))
                    points[to] = min(here, points.get(to, far))
    return best


def distances(words: list[str], candidates: list[str], rules: Rules, limit: int) -> np.ndarray:
    """``distance`` of many pairs at once, of rules without short pairs whose equal characters are classes: all pairs fill
    the same cell of their tables, and only cells within ``limit`` of the diagonal are filled."""
    n, far = len(words), limit + 1
    out = np.full(n, far, np.int32)
    if not n:
        return out
    a, b = (np.array([len(w) for w in side]) for side in (words, candidates))
    codes = lambda side: np.array(side, dtype=str).view(np.uint32).reshape(n, -1).T.copy()
    x, y = codes(words), codes(candidates)
    fx, fy = (codes([rules.folded(w) for w in side]) for side in (words, candidates)) if rules.classes else (x, y)
    beyond = np.full(n, far, np.int32)
    before: dict[int, np.ndarray] = {}
    above = {j: np.full(n, min(j, far), np.int32) for j in range(min(limit, b.max()) + 1)}
    for i in range(a.max() + 1):
        row = above if i == 0 else {0: np.full(n, i, np.int32)} if i <= limit else {}
        for j in range(max(1, i - limit), min(b.max(), i + limit) + 1) if i else ():
            d = 1 + np.minimum(np.minimum(above.get(j - 1, beyond), above.get(j, beyond)), row.get(j - 1, beyond))
            if i > 1 and j > 1:
                swap = (x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1])
                d = np.where(swap, np.minimum(d, 1 + before.get(j - 2, beyond)), d)
            row[j] = np.minimum(np.where(fx[i - 1] == fy[j - 1], above.get(j - 1, beyond), d), far)
        for j, cell in row.items():
            here = (a == i) & (b == j)
            out[here] = cell[here]
        before, above = above, row
    return out


def rewritten(word: str, pairs: tuple[tuple[str, str, bool, bool], ...], most: int = 6) -> list[str]:
    """The word with any choice of at most ``most`` rewrites applied from left to right; itself comes first.

    At a place where several keys start, the longest are tried. A rewrite that would only repeat its target, which the
    word already has there, is left out.
    """
    out: dict[str, None] = {}

    def walk(done: str, rest: str, left: int, at_start: bool) -> None:
        for i in range(len(rest)):
            here = [p for p in pairs if rest.startswith(p[0], i) and (not p[2] or at_start and i == 0) and (not p[3] or i + len(p[0]) == len(rest))]
            if here and left:
                size = max(len(p[0]) for p in here)
                key = rest[i : i + size]
                walk(done + rest[: i + size], rest[i + size :], left - 1, False)
                whole = done + rest
                for _, target, *_ in [p for p in here if len(p[0]) == size]:
                    at = len(done) + i
                    there = size < len(target) and (whole.startswith(target, at) or at - len(target) + 1 >= 0 and whole.startswith(target, at - len(target) + 1))
                    if not there:
                        walk(done + rest[:i] + target, rest[i + len(key) :], left - 1, False)
                return
        out.setdefault(done + rest)

    walk("", word, most, True)
    return list(out)


def _starting(word: str, i: int, pairs: tuple[tuple[str, str, bool, bool], ...]) -> list[tuple[str, str]]:
    return [(k, t) for k, t, start, end in pairs if word.startswith(k, i) and (not start or i == 0) and (not end or i + len(k) == len(word))]


def choices(word: str, pairs: tuple[tuple[str, str, bool, bool], ...]) -> int:
    """No fewer than ``variants`` finds: the product of what each place may do."""
    return prod(1 + len(_starting(word, i, pairs)) for i in range(len(word))) if pairs else 1


def variants(word: str, pairs: tuple[tuple[str, str, bool, bool], ...]) -> list[str]:
    """The word with any choice of non-overlapping rewrites, at any places; ``choices`` tells how many that may be."""
    out: dict[str, None] = {}

    def walk(done: str, i: int) -> None:
        if i == len(word):
            out.setdefault(done)
            return
        walk(done + word[i], i + 1)
        for key, target in _starting(word, i, pairs):
            walk(done + target, i + len(key))

    walk("", 0)
    return list(out)


def _pieces(size: int, edits: int) -> list[tuple[int, int]]:
    """Start and size of each of ``edits`` + 1 pieces of a string, as even as can be."""
    edges = [i * size // (edits + 1) for i in range(edits + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def stored_keys(word: str, edits: int) -> set[str]:
    """Keys of a word that is looked for: its pieces with their number and its length. A word with fewer letters than
    pieces has what is left after deletions."""
    if len(word) <= edits:
        return {"-" + k for k in deletions(word, edits)}
    return {f"{len(word)},{i},{word[a : a + n]}" for i, (a, n) in enumerate(_pieces(len(word), edits))}


def probing_keys(word: str, edits: int) -> set[str]:
    """Keys of which a word shares one with each word within so many edits, swaps of neighbours among them.

    Of ``edits`` + 1 pieces one is in the other word as it is, moved by no more than the edits, if a swap across a border
    is put down to the piece before it; or its first letter was swapped so, and the letter before stands in its place.
    """
    out = {"-" + k for k in deletions(word, edits)} if len(word) <= 2 * edits else set()
    for size in range(max(edits + 1, len(word) - edits), len(word) + edits + 1):
        more = len(word) - size
        for i, (a, n) in enumerate(_pieces(size, edits)):
            for shift in range(-edits, edits + 1):
                at = a + shift
                if abs(shift) + abs(more - shift) > edits or at < 0 or at + n > len(word):
                    continue
                out.add(f"{size},{i},{word[at : at + n]}")
                if at and i:
                    out.add(f"{size},{i},{word[at - 1]}{word[at + 1 : at + n]}")
    return out


def deletions(word: str, most: int) -> set[str]:
    """All strings left after deleting at most ``most`` characters."""
    out = level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out
