"""Charsets whose characters have several bytes, by Python's codecs on Arrow batches.

Spark's own functions know Unicode and Latin-1 only; charsets of one byte go by those and a table. For the others a batch
is coded as one text, cut again at line feeds, which no byte of a longer character is. The marked fallback takes values
one by one where a value has a line feed or cannot be coded.
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def several_bytes(encoding: str) -> bool:
    """Whether characters of the charset may have more than one byte, and Spark doesn't know it."""
    name = codecs.lookup(encoding).name
    if name.startswith("utf") or name in ("ascii", "iso8859-1"):
        return False
    try:
        known = bytes(range(128, 256)).decode(encoding, "ignore")
        return len(known) < 64 or any(len(c.encode(encoding)) > 1 for c in known)
    except (UnicodeError, LookupError):
        return True


def encoded(values: list[str | None], encoding: str) -> list[bytes | None]:
    """Each value in the charset; a character that it lacks becomes a question mark."""
    own = [v for v in values if v is not None]
    parts = "\n".join(own).encode(encoding, "replace").split(b"\n")
    if len(parts) != len(own):  # one by one
        parts = [v.encode(encoding, "replace") for v in own]
    rest = iter(parts)
    return [None if v is None else next(rest) for v in values]


def decoded(values: list[bytes | None], encoding: str) -> list[str | None]:
    """Each value as text; bytes that the charset doesn't know become the replacement character."""
    own = [bytes(v) for v in values if v is not None]
    try:
        parts = b"\n".join(own).decode(encoding).split("\n")
    except UnicodeDecodeError:
        parts = []
    if len(parts) != len(own):  # one by one
        parts = [v.decode(encoding, "replace") for v in own]
    rest = iter(parts)
    return [None if v is None else next(rest) for v in values]


def codable(values: list[str | None], encoding: str) -> list[bool | None]:
    """Whether the charset has all characters of each value."""

    def fits(v: str) -> bool:
        try:
            return v.encode(encoding).decode(encoding) == v
        except UnicodeError:
            return False

    try:
        whole = "\n".join(v for v in values if v is not None)
        all_fit = whole.encode(encoding).decode(encoding) == whole
    except UnicodeError:
        all_fit = False
    return [None if v is None else all_fit or fits(v) for v in values]


def known(values: list[bytes | None], encoding: str) -> list[bool | None]:
    """Whether the charset knows the bytes of each value."""

    def fits(v: bytes) -> bool:
        try:
            v.decode(encoding)
        except UnicodeError:
            return False
        return True

    return [None if v is None else fits(bytes(v)) for v in values]


def column(f, c: Column, encoding: str, kind: str) -> Column:
    """A function of this module on a column."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series(f([None if v is None else v for v in values], encoding), dtype=object)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)(c)
