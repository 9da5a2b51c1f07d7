"""Dictionary metadata: a properties file next to the dictionary, parsed into validated options."""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass, field, fields, replace
from pathlib import PurePosixPath

from ..functions.encoders import BY_NAME

PREFIX = "fsa.dict."

# The property of each option, without the common prefix.
PROPERTIES = {
    "separator": "separator",
    "encoding": "encoding",
    "frequency_included": "frequency-included",
    "ignore_numbers": "speller.ignore-numbers",
    "ignore_punctuation": "speller.ignore-punctuation",
    "ignore_camel_case": "speller.ignore-camel-case",
    "ignore_all_uppercase": "speller.ignore-all-uppercase",
    "ignore_diacritics": "speller.ignore-diacritics",
    "convert_case": "speller.convert-case",
    "runon_words": "speller.runon-words",
    "locale": "speller.locale",
    "encoder": "encoder",
    "input_conversion": "input-conversion",
    "output_conversion": "output-conversion",
    "replacement_pairs": "speller.replacement-pairs",
    "equivalent_chars": "speller.equivalent-chars",
    "license": "license",
    "author": "author",
    "created": "created",
}
REQUIRED = ("separator", "encoder", "encoding")
#: Keys of older files and the encoder to name instead.
LEGACY = {"uses-suffixes": "suffix", "uses-prefixes": "prefix", "uses-infixes": "infix"}
_TRUE, _FALSE = ("true", "yes", "on"), ("false", "no", "off")


class MetadataError(ValueError):
    """A property that is missing, unknown or malformed; the message names it."""


@dataclass(frozen=True)
class Metadata:
    """Options of a dictionary. Pairs keep their order; nothing here depends on a session."""

    separator: str
    encoder: str
    encoding: str
    frequency_included: bool = False
    ignore_numbers: bool = True
    ignore_punctuation: bool = True
    ignore_camel_case: bool = True
    ignore_all_uppercase: bool = True
    ignore_diacritics: bool = True
    convert_case: bool = True
    runon_words: bool = True
    locale: str | None = None
    input_conversion: tuple[tuple[str, str], ...] = ()
    output_conversion: tuple[tuple[str, str], ...] = ()
    replacement_pairs: tuple[tuple[str, str], ...] = ()
    equivalent_chars: tuple[tuple[str, str], ...] = ()
    license: str | None = None
    author: str | None = None
    created: str | None = None
    given: frozenset[str] = field(default=frozenset(), compare=False)

    def __post_init__(self) -> None:
        if self.encoder not in BY_NAME:
            raise MetadataError(f"{PREFIX}encoder: {self.encoder!r} is none of {', '.join(BY_NAME)}")
        try:
            codecs.lookup(self.encoding)
        except LookupError:
            raise MetadataError(f"{PREFIX}encoding: unknown charset {self.encoding!r}") from None
        if len(self.separator) != 1 or 0xD800 <= ord(self.separator) <= 0xDFFF or ord(self.separator) > 0xFFFF:
            raise MetadataError(f"{PREFIX}separator: must be one character, not {self.separator!r}")
        try:
            one = len(self.separator.encode(self.encoding)) == 1
        except UnicodeEncodeError:
            one = False
        if not one:
            raise MetadataError(f"{PREFIX}separator: {self.separator!r} is not one byte in {self.encoding}")

    @property
    def separator_byte(self) -> bytes:
        return self.separator.encode(self.encoding)

    def with_(self, **changes) -> Metadata:
        """A copy with other options; takes the place of a builder."""
        return replace(self, **changes)

    def properties(self) -> dict[str, str]:
        """Options that differ from their defaults, and the required ones, as properties."""
        out = {}
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name == "given" or f.name not in REQUIRED and f.name not in self.given and v == f.default:
                continue
            if isinstance(v, tuple):
                v = ", ".join(f"{a.replace(' ', '_')} {b.replace(' ', '_')}" if f.name == "replacement_pairs" else f"{a} {b}" for a, b in v)
            elif isinstance(v, bool):
                v = str(v).lower()
            if v is not None:
                out[PREFIX + PROPERTIES[f.name]] = v
        return out


def parse_properties(text: str) -> dict[str, str]:
    """Java properties: comments, continued lines, ``=`` or ``:`` or blank after the key, and escapes."""
    out, pending = {}, ""
    for raw in re.split(r"\r\n|\r|\n", text):
        line = pending + raw.lstrip(" \t\f")
        pending = ""
        if not line or line[0] in "#!":
            continue
        if (len(line) - len(line.rstrip("\\"))) % 2:
            pending = line[:-1]
            continue
        m = re.match(r"((?:\\.|[^\\=: \t\f])*)[ \t\f]*(?:[=:][ \t\f]*)?(.*)\Z", line, re.S)
        out[_unescape(m[1])] = _unescape(m[2])
    return out


def _unescape(s: str) -> str:
    named = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}
    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.)|\Z)", lambda m: chr(int(m[1], 16)) if m[1] else named.get(m[2] or "", m[2] or ""), s, flags=re.S)


def format_properties(values: dict[str, str]) -> str:
    def escape(s: str, key: bool) -> str:
        s = s.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r").replace("\f", "\\f")
        return re.sub(r"([ =:#!])", r"\\\1", s) if key else re.sub(r"\A([ =:#!])", r"\\\1", s)

    return "".join(f"{escape(k, True)}={escape(v, False)}\n" for k, v in values.items())


def _boolean(key: str, value: str) -> bool:
    v = value.strip().lower()
    if v in _TRUE or v in _FALSE:
        return v in _TRUE
    raise MetadataError(f"{key}: not a boolean: {value!r}")


def _pairs(key: str, value: str) -> list[tuple[str, str]]:
    out = []
    for part in re.split(r",\s*", value.strip()) if value.strip() else []:
        two = part.strip().split(" ")
        if len(two) != 2:
            raise MetadataError(f"{key}: not a pair: {part!r}")
        out.append((two[0], two[1]))
    return out


def from_properties(values: dict[str, str]) -> Metadata:
    by_key = {PREFIX + p: name for name, p in PROPERTIES.items()}
    options: dict = {}
    for key, value in values.items():
        short = key.removeprefix(PREFIX)
        if key.startswith(PREFIX) and short in LEGACY:
            raise MetadataError(f"{key}: no longer supported, use {PREFIX}encoder={LEGACY[short]}")
        if key not in by_key:
            raise MetadataError(f"{key}: unknown property")
        name = by_key[key]
        if isinstance(Metadata.__dataclass_fields__[name].default, bool):
            options[name] = _boolean(key, value)
        elif name == "encoder":
            options[name] = value.strip().lower()
        elif name in ("input_conversion", "output_conversion"):
            pairs = _pairs(key, value)
            if len({a for a, _ in pairs}) < len(pairs):
                raise MetadataError(f"{key}: the same key twice")
            options[name] = tuple(pairs)
        elif name == "replacement_pairs":
            options[name] = tuple((a.replace("_", " "), b.replace("_", " ")) for a, b in _pairs(key, value))
        elif name == "equivalent_chars":
            pairs = _pairs(key, value)
            if any(len(a) != 1 or len(b) != 1 for a, b in pairs):
                raise MetadataError(f"{key}: both sides of a pair must be one character")
            options[name] = tuple(pairs)
        else:
            options[name] = value
    if missing := [PREFIX + PROPERTIES[r] for r in REQUIRED if r not in options]:
        raise MetadataError(f"missing: {', '.join(missing)}")
    return Metadata(**options, given=frozenset(options))


def read_metadata(data: bytes) -> Metadata:
    return from_properties(parse_properties(data.decode("utf-8")))


def write_metadata(metadata: Metadata) -> bytes:
    return format_properties(metadata.properties()).encode("utf-8")


def metadata_path(dictionary: str) -> str:
    """Where the metadata of a dictionary is expected: its name with the last extension replaced by ``info``."""
    p = PurePosixPath(dictionary)
    stem = p.name[: p.name.rfind(".")] if "." in p.name else p.name
    return str(p.with_name(stem + ".info")) if "://" not in dictionary else dictionary[: len(dictionary) - len(p.name)] + stem + ".info"
