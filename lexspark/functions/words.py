"""Predicates and conversions over word columns. All are built-in expressions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.metadata import Metadata
from . import charsets


def is_alphabetic(c: Column) -> Column:
    """One code point that is a letter or a letter number."""
    return c.rlike(r"^[\p{L}\p{Nl}]$")


def contains_no_digit(w: Column) -> Column:
    return ~w.rlike(r"\p{Nd}")


def is_all_uppercase(w: Column) -> Column:
    """No lower-case letter, so a number counts."""
    return ~w.rlike(r"\p{Ll}")


def is_not_all_lowercase(w: Column) -> Column:
    """Some letter isn't in lower case."""
    return w.rlike(r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}]")


def is_not_capitalized(w: Column) -> Column:
    return ~w.rlike(r"^\p{Lu}[^\p{Lu}\p{Lt}\p{Lm}\p{Lo}]*$")


def is_not_empty(w: Column) -> Column:
    return F.length(w) > 0


def is_mixed_case(w: Column) -> Column:
    return ~is_all_uppercase(w) & is_not_capitalized(w) & is_not_all_lowercase(w)


def is_camel_case(w: Column) -> Column:
    return is_mixed_case(w) & w.rlike(r"^\p{Lu}\p{Ll}")


def initial_uppercase(w: Column) -> Column:
    """The first character as it is, the others in lower case."""
    return F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, F.lit(2), F.length(w))))


def converted(w: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """All pairs, one after the other, each wherever its key occurs."""
    for a, b in pairs:
        w = F.replace(w, F.lit(a), F.lit(b))
    return w


def in_charset(w: Column, encoding: str) -> Column:
    """Whether every character exists in the dictionary's charset."""
    import codecs

    name = codecs.lookup(encoding).name
    if name.startswith("utf"):
        return w.isNotNull()
    if name == "ascii":
        return ~w.rlike(r"[^\x00-\x7F]")
    if name == "iso8859-1":
        return ~w.rlike(r"[^\x00-\xFF]")
    if charsets.several_bytes(encoding):
        return charsets.column(charsets.codable, w, encoding, "boolean")
    known = "".join(ch for b in range(128, 256) if (ch := bytes([b]).decode(encoding, "ignore")))
    return F.length(F.translate(w, known, "")) == F.length(F.regexp_replace(w, r"[^\x00-\x7F]", ""))


def frequency_class(tag: Column) -> Column:
    """0 to 25 from the last letter of an entry, A to Z."""
    return F.ascii(F.substring(tag, -1, 1)) - 65


def checked(w: Column, options: Metadata, in_dict: Column, lower_in_dict: Column, initial_in_dict: Column) -> Column:
    """Whether ``w`` counts as misspelled, given whether it, its lower-case and its initial-capital form are known."""
    first = is_alphabetic(F.substring(w, 1, 1))
    single = F.length(w) == 1
    wrong = (F.length(w) > 0) & ~in_dict
    if options.ignore_punctuation:
        wrong &= ~single | first
    if options.ignore_numbers:
        wrong &= contains_no_digit(w)
    if options.ignore_camel_case:
        wrong &= ~is_camel_case(w)
    if options.ignore_all_uppercase:
        wrong &= ~((~single | first) & is_all_uppercase(w))
    if options.convert_case:
        wrong &= ~(~is_mixed_case(w) & (lower_in_dict | (is_all_uppercase(w) & initial_in_dict)))
    return wrong


def byte_as_char(b: Column) -> Column:
    """A printable byte as itself and in hexadecimal, others in hexadecimal only."""
    code = F.format_string("0x%02x", b)
    return F.when((b > 32) & (b < 127), F.format_string("%s (%s)", F.char(b), code)).otherwise(code)
