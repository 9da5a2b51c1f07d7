"""Relative encoders: a target form written as an edit of a source form.

A code is one byte, 'A' plus a count, modulo 256. A count of 255 means that the whole source goes. The byte functions
define each encoder; Spark applies them as column expressions (suffix, none) or as Arrow UDFs over distinct bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The count that stands for everything, and the letter of count 0.
ALL, ZERO = 255, 65


def _code(*counts: int) -> bytes:
    return bytes((c + ZERO) & 255 for c in counts)


def _counts(code: bytes, n: int) -> list[int]:
    if len(code) < n:
        raise ValueError(f"a code has at least {n} bytes")
    return [(b - ZERO) & 255 for b in code[:n]]


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def encode_suffix(source: bytes, target: bytes) -> bytes:
    keep = shared_prefix(source, target)
    if len(source) - keep >= ALL:
        return _code(ALL) + target
    return _code(len(source) - keep) + target[keep:]


def decode_suffix(source: bytes, code: bytes) -> bytes:
    (cut,) = _counts(code, 1)
    return (b"" if cut == ALL else source[: len(source) - cut]) + code[1:]


def encode_prefix(source: bytes, target: bytes) -> bytes:
    """The longest run of the source that starts the target, the leftmost of these, less what no code can say."""
    runs = ((shared_prefix(source[i:], target), i) for i in range(min(len(source), ALL)))
    run, at = max(((n, i) for n, i in runs if n and len(source) - i - n < ALL), key=lambda x: (x[0], -x[1]), default=(0, 0))
    rest = len(source) - at - run
    if rest >= ALL:
        return _code(ALL, ALL) + target
    return _code(at, rest) + target[run:]


def decode_prefix(source: bytes, code: bytes) -> bytes:
    start, end = _counts(code, 2)
    return (b"" if ALL in (start, end) else source[start : len(source) - end]) + code[2:]


def encode_infix(source: bytes, target: bytes) -> bytes:
    """Removes an infix at the start, or where source and target first differ, if more of the target is shared then."""
    first = shared_prefix(source, target)
    best, at, size = first, 0, 0
    for i in dict.fromkeys((0, first)):
        for j in range(1, len(source) - i + 1):
            n = shared_prefix(source[:i] + source[i + j :], target)
            if n > best and i < ALL and j < ALL:
                best, at, size = n, i, j
    rest = len(source) - size - best
    if rest == 0 and at + size == len(source):  # the infix is a suffix
        at, size, rest = 0, 0, size
    if max(at, size, rest) >= ALL:
        return _code(0, ALL, ALL) + target
    return _code(at, size, rest) + target[best:]


def decode_infix(source: bytes, code: bytes) -> bytes:
    at, size, rest = _counts(code, 3)
    if ALL in (size, rest):
        return code[3:]
    return source[:at] + source[at + size : len(source) - rest] + code[3:]


def encode_none(source: bytes, target: bytes) -> bytes:
    return target


def decode_none(source: bytes, code: bytes) -> bytes:
    return code


@dataclass(frozen=True)
class Encoder:
    """An encoder by name: its byte functions, how many header bytes a code has, and its column functions."""

    name: str
    encode_bytes: object
    decode_bytes: object
    header: int

    def encode(self, source: Column, target: Column) -> Column:
        """Code of the binary columns; null where either is."""
        if self.name == "none":
            return F.when(source.isNotNull(), target)
        if self.name == "suffix":
            return suffix_code(source, target)
        return _udf(self.encode_bytes)(source, target)

    def decode(self, source: Column, code: Column) -> Column:
        if self.name == "none":
            return F.when(source.isNotNull(), code)
        if self.name == "suffix":
            return suffix_decoded(source, code)
        return _udf(self.decode_bytes)(source, code)


def _udf(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(bytes(x), bytes(y)) for x, y in zip(a, b, strict=True)])

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")


def shared_prefix_length(a: Column, b: Column) -> Column:
    """Bytes that two binary columns share at their start."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.array_min(differs) - 1, n))


def _byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))


def let(value: Column, body) -> Column:
    """``body`` of a column that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def suffix_code(source: Column, target: Column) -> Column:
    def code(keep: Column) -> Column:
        cut = F.octet_length(source) - keep
        head, whole = _byte((cut + ZERO) % 256), _byte(F.lit((ALL + ZERO) % 256))
        return F.when(cut >= ALL, F.concat(whole, target)).otherwise(F.concat(head, F.substring(target, keep + 1, F.octet_length(target))))

    return let(shared_prefix_length(source, target), code)


def suffix_decoded(source: Column, code: Column) -> Column:
    cut = (F.conv(F.hex(F.substring(code, 1, 1)), 16, 10).cast("int") - ZERO + 256) % 256
    kept = F.when(cut == ALL, F.substring(source, 1, 0)).otherwise(F.substring(source, F.lit(1), F.octet_length(source) - cut))
    return F.concat(kept, F.substring(code, F.lit(2), F.octet_length(code)))


BY_NAME = {
    "suffix": Encoder("suffix", encode_suffix, decode_suffix, 1),
    "prefix": Encoder("prefix", encode_prefix, decode_prefix, 2),
    "infix": Encoder("infix", encode_infix, decode_infix, 3),
    "none": Encoder("none", encode_none, decode_none, 0),
}


def register(name: str, encode_bytes, decode_bytes, header: int) -> Encoder:
    """Makes an encoder known by name, to metadata files, too: ``encode(source, target)`` gives a code, ``decode(source,
    code)`` the target. The first ``header`` bytes of a code may be any, later ones never the separator by themselves."""
    if not name or name != name.strip().lower():
        raise ValueError(f"an encoder's name is in lower case, without blanks around it: {name!r}")
    if name in BY_NAME and (BY_NAME[name].encode_bytes, BY_NAME[name].decode_bytes) != (encode_bytes, decode_bytes):
        raise ValueError(f"another encoder is named {name!r}")
    BY_NAME[name] = Encoder(name, encode_bytes, decode_bytes, header)
    return BY_NAME[name]
