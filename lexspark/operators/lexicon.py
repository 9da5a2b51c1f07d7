"""Dictionaries as tables of (word, stem, tag): compiling, scanning, decompiling and looking up.

A packed entry is ``word SEP code [SEP tag]`` in the dictionary's charset; the code turns the word into its stem. Look-up
is an equi-join on the word, and Spark chooses how to join by the sizes that it sees.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import cached_property
from threading import Lock
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import charsets
from ..functions.encoders import BY_NAME
from ..functions.words import converted, in_charset
from ..sources import readers
from ..sources.metadata import Metadata, metadata_path, read_metadata, write_metadata
from ..sources.store import exists, is_folder, remove, written

#: Charsets that Spark decodes itself; others of one byte go through ISO-8859-1 and a table of their upper half, others
#: through Python's codecs.
_NATIVE = {"utf-8": "UTF-8", "ascii": "US-ASCII", "iso8859-1": "ISO-8859-1"}


class SourceError(ValueError):
    """Source rows that make no dictionary."""


def _native(encoding: str) -> str | None:
    import codecs

    return _NATIVE.get(codecs.lookup(encoding).name)


def _upper_half(encoding: str) -> tuple[str, str]:
    pairs = [(chr(b), c) for b in range(128, 256) if len(c := bytes([b]).decode(encoding, "ignore")) == 1]
    return "".join(a for a, _ in pairs), "".join(c for _, c in pairs)


def to_bytes(text: Column, encoding: str) -> Column:
    if name := _native(encoding):
        return F.encode(text, name)
    if charsets.several_bytes(encoding):
        return charsets.column(charsets.encoded, text, encoding, "binary")
    latin, own = _upper_half(encoding)
    return F.encode(F.translate(text, own, latin), "ISO-8859-1")


def to_text(data: Column, encoding: str) -> Column:
    if name := _native(encoding):
        return F.decode(data, name)
    if charsets.several_bytes(encoding):
        return charsets.column(charsets.decoded, data, encoding, "string")
    latin, own = _upper_half(encoding)
    return F.translate(F.decode(data, "ISO-8859-1"), latin, own)


def strict_bytes(text: Column, encoding: str) -> Column:
    """Like ``to_bytes``, but a character that the charset lacks is an error."""
    wrong = F.raise_error(F.concat(F.lit(f"not in {encoding}: "), text)).cast("binary")
    return F.when(text.isNull() | in_charset(text, encoding), to_bytes(text, encoding)).otherwise(wrong)


def strict_text(data: Column, encoding: str) -> Column:
    """Like ``to_text``, but bytes that the charset doesn't know are an error."""
    import codecs

    name, latin = codecs.lookup(encoding).name, F.decode(data, "ISO-8859-1")
    if name == "utf-8":
        known = F.is_valid_utf8(data.cast("string"))
    elif charsets.several_bytes(encoding):
        known = charsets.column(charsets.known, data, encoding, "boolean")
    else:
        free = "".join(chr(b) for b in range(256) if not bytes([b]).decode(encoding, "ignore"))
        known = F.length(F.translate(latin, free, "")) == F.length(latin)
    return F.when(data.isNull() | known, to_text(data, encoding)).otherwise(F.raise_error(F.concat(F.lit(f"not in {encoding}: "), F.hex(data))))


def source_rows(lines: DataFrame, metadata: Metadata, line: str = "line") -> DataFrame:
    """``(base, inflected, tag)`` from ``base SEP inflected [SEP tag]``; further separators stay in the tag."""
    text = F.col(line) if lines.schema[line].dataType.simpleString() == "string" else to_text(F.col(line), metadata.encoding)
    parts = F.split(text, f"\\Q{metadata.separator}\\E", 3)
    return lines.select(F.get(parts, F.lit(0)).alias("base"), F.get(parts, F.lit(1)).alias("inflected"), F.get(parts, F.lit(2)).alias("tag"), (F.length(text) - F.length(F.replace(text, F.lit(metadata.separator), F.lit("")))).alias("separators"))


def source_violations(rows: DataFrame) -> DataFrame:
    """``(separators, rows)`` of source rows: more than one line, or a number other than 1 or 2, makes no dictionary."""
    return rows.groupBy("separators").agg(F.count(F.lit(1)).alias("rows"))


def unsafe_rows(rows: DataFrame, metadata: Metadata) -> DataFrame:
    """Distinct rows ``(base, inflected, tag)`` that a dictionary could not bring back, as the bytes of the base or of the
    inflected form have the separator: a line that is made of the entry would be cut there."""
    sep = F.lit(metadata.separator_byte.decode("latin-1"))
    has = lambda c: F.coalesce(F.contains(F.decode(to_bytes(F.col(c), metadata.encoding), "ISO-8859-1"), sep), F.lit(False))
    return rows.where(has("base") | has("inflected")).select("base", "inflected", "tag").distinct()


def checked_rows(rows: DataFrame) -> DataFrame:
    """Raises on rows that don't have one number of separators, 1 or 2."""
    found = [r[0] for r in source_violations(rows).select("separators").orderBy("separators").limit(3).collect()]
    if any(n not in (1, 2) for n in found) or len(found) > 1:
        raise SourceError(f"every row must have the same number of separators, 1 or 2; found {', '.join(map(str, found))}")
    return rows.drop("separators")


def packed(rows: DataFrame, metadata: Metadata) -> DataFrame:
    """Packed entries ``(seq, word, base, tag, coded, plain)`` of ``(base, inflected, tag)``.

    Without a tag there is no separator before it. An entry is plain if its bytes read back as its own columns: its word
    and base are in the charset and without the separator, and so need not be parsed again.
    """
    m = metadata
    source, target = to_bytes(F.col("word"), m.encoding), to_bytes(F.col("base"), m.encoding)
    sep = F.unhex(F.lit(m.separator_byte.hex()))
    fit = lambda c: in_charset(F.col(c), m.encoding)
    # a byte of a longer character may be the separator's, which is why it's the bytes that are looked at there
    sep_in = lambda b: F.contains(F.decode(b, "ISO-8859-1"), F.lit(m.separator_byte.decode("latin-1")))
    free = lambda c: ~(sep_in(to_bytes(F.col(c), m.encoding)) if charsets.several_bytes(m.encoding) else F.contains(F.col(c), F.lit(m.separator)))
    # entries are told apart before they are encoded, so that equal ones are encoded once
    slim = rows.where("inflected IS NOT NULL AND base IS NOT NULL").select(F.col("inflected").alias("word"), "base", F.coalesce("tag", F.lit("")).alias("tag")).distinct()
    coded = slim.withColumn("coded", BY_NAME[m.encoder].encode(source, target)).withColumn("plain", fit("word") & fit("base") & fit("tag") & free("word") & free("base"))
    tag = F.when(F.length("tag") > 0, F.concat(sep, to_bytes(F.col("tag"), m.encoding))).otherwise(F.unhex(F.lit("")))
    return coded.select(F.concat(source, sep, "coded", tag).alias("seq"), "word", "base", "tag", "coded", "plain")


def unpacked(seqs: DataFrame, metadata: Metadata) -> DataFrame:
    """``(seq, word, stem, tag, coded, visible)`` of packed entries; empty stems and tags are null.

    ``visible`` tells whether look-up finds the entry: an entry ``word SEP`` without more hides the word's others.
    """
    e, sep = BY_NAME[metadata.encoder], F.lit(metadata.separator_byte.decode("latin-1"))
    size = F.octet_length
    # positions are those of bytes, as each is one character of Latin-1
    at = F.instr(F.decode("seq", "ISO-8859-1"), sep)
    rows = seqs.withColumn("at", at).where("at > 0")
    rows = rows.select("seq", F.substring("seq", F.lit(1), F.col("at") - 1).alias("wb"), F.substring("seq", F.col("at") + 1, size("seq")).alias("tail"))
    end = F.locate(metadata.separator_byte.decode("latin-1"), F.decode("tail", "ISO-8859-1"), e.header + 1)
    rows = rows.withColumn("end", end)
    rows = rows.select("seq", "wb", "tail", F.when(F.col("end") > 0, F.substring("tail", F.lit(1), F.col("end") - 1)).otherwise(F.col("tail")).alias("coded"), F.when(F.col("end") > 0, F.substring("tail", F.col("end") + 1, size("tail"))).alias("tb"))
    stem = F.when(size("coded") >= e.header, e.decode(F.col("wb"), F.col("coded")))
    text = lambda c: F.nullif(to_text(c, metadata.encoding), F.lit(""))
    return rows.select("seq", to_text(F.col("wb"), metadata.encoding).alias("word"), text(stem).alias("stem"), text(F.col("tb")).alias("tag"), "coded", (size("tail") > 0).alias("visible"))


#: The columns of a lexicon's table.
ENTRIES = ("seq", "word", "stem", "tag", "coded", "visible")


@dataclass(frozen=True)
class Lexicon:
    """Packed entries and metadata. ``entries`` has a row ``(seq, word, stem, tag, coded, visible)`` for each (word, stem, tag).

    The entries are a Parquet table: look-up reads the columns of it that it needs, and nothing is encoded or parsed
    again. ``table`` has them where they are known already.
    """

    seqs: DataFrame
    metadata: Metadata
    table: DataFrame | None = None

    @staticmethod
    def read(spark: SparkSession, path: str, metadata: str | None = None) -> Lexicon:
        """From a binary dictionary and its metadata file: the one beside it, or the one named."""
        if metadata is None:
            return Lexicon(*readers.read_dictionary_files(spark, path))
        return Lexicon(readers.read_fsa(spark, path), read_metadata(readers.read_bytes(spark, metadata)))

    @staticmethod
    def from_streams(spark: SparkSession, automaton: BinaryIO, metadata: BinaryIO) -> Lexicon:
        """From the bytes of both files, wherever they come from; they pass the driver."""
        content = spark.createDataFrame([(bytearray(automaton.read()),)], "content binary")
        return Lexicon(readers.fsa_sequences(content), read_metadata(metadata.read()))

    @staticmethod
    def compile(rows: DataFrame, metadata: Metadata) -> Lexicon:
        """From source rows ``(base, inflected, tag)``."""
        all_ = written(packed(rows, metadata), "lexicon")
        seen = (F.octet_length("coded") > 0) | (F.length("tag") > 0)
        odd = all_.where(~F.col("plain"))
        clean = odd.isEmpty()  # then no filter is needed, and look-up reads three columns
        entries = (all_ if clean else all_.where("plain")).select("seq", "word", F.nullif("base", F.lit("")).alias("stem"), F.nullif("tag", F.lit("")).alias("tag"), "coded", seen.alias("visible"))
        if not clean:
            entries = entries.unionByName(unpacked(odd.select("seq").distinct(), metadata).select(*ENTRIES))
        return Lexicon(entries.select("seq"), metadata, entries)

    def save(self, path: str, overwrite: bool = False) -> None:
        """As Parquet at ``path``, in any number of files, with the metadata beside it: for lexicons of any size."""
        if self.table is None and not self.bare().isEmpty():
            raise SourceError("sequences without a separator are no entries")
        self.entries.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
        readers.write_bytes(self.entries.sparkSession, metadata_path(path), write_metadata(self.metadata), overwrite)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Lexicon:
        """What ``save`` has written. Look-up reads the columns that it needs."""
        entries = spark.read.parquet(path)
        return Lexicon(entries.select("seq"), read_metadata(readers.read_bytes(spark, metadata_path(path))), entries)

    def save_buckets(self, path: str, buckets: int, overwrite: bool = False) -> None:
        """As Parquet at ``path`` in so many buckets by word, each sorted: for look-ups again and again, which then shuffle
        and sort the probes only."""
        if self.table is None and not self.bare().isEmpty():
            raise SourceError("sequences without a separator are no entries")
        spark, name = self.entries.sparkSession, f"lexicon_{uuid.uuid4().hex}"
        if exists(spark, path):
            if not overwrite:
                raise SourceError(f"{path} exists")
            remove(spark, path)
        self.entries.repartition(buckets, "word").write.format("parquet").bucketBy(buckets, "word").sortBy("word").option("path", path).saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # an external table's files stay
        readers.write_bytes(spark, metadata_path(path), write_metadata(self.metadata), overwrite)

    @staticmethod
    def load_buckets(spark: SparkSession, path: str, buckets: int) -> Lexicon:
        """What ``save_buckets`` has written, with its number of buckets, as a table that this session knows."""
        name = f"lexicon_{hashlib.md5(path.encode()).hexdigest()}_{buckets}"
        columns = ", ".join(f"{c} {t}" for c, t in zip(ENTRIES, ("BINARY", "STRING", "STRING", "STRING", "BINARY", "BOOLEAN"), strict=True))
        at = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (word) SORTED BY (word) INTO {buckets} BUCKETS LOCATION '{at}'")
        entries = spark.table(name)
        return Lexicon(entries.select("seq"), read_metadata(readers.read_bytes(spark, metadata_path(path))), entries)

    def write(self, path: str, version: str = "fsa5", overwrite: bool = False) -> None:
        """As one binary automaton, built by one task, and its metadata file."""
        readers.write_dictionary_files(self.seqs, self.metadata, path, version, overwrite)

    @cached_property
    def entries(self) -> DataFrame:
        return self.table if self.table is not None else written(unpacked(self.seqs, self.metadata), "lexicon")

    def bare(self) -> DataFrame:
        """Sequences without a separator, which are words but no entries."""
        has = F.contains(F.decode("seq", "ISO-8859-1"), F.lit(self.metadata.separator_byte.decode("latin-1")))
        return self.seqs.where(~has)

    def scan(self, decode_stems: bool = True) -> DataFrame:
        """``(word, stem, tag)``, or the codes in place of the stems."""
        return self.entries.select("word", "stem" if decode_stems else F.col("coded").alias("stem"), "tag")

    @cached_property
    def forms(self) -> DataFrame:
        """``(word, stem, tag, seq, coded)`` as look-up sees them: words with an entry that ends at the word see none."""
        if self.metadata.encoder != "none":  # any other code has a byte, so no entry ends at its word
            return self.entries.select("word", "stem", "tag", "seq", "coded")
        hidden = self.entries.where("NOT visible").select("word").distinct()
        return self.entries.join(hidden, "word", "left_anti").select("word", "stem", "tag", "seq", "coded")

    def words(self) -> DataFrame:
        """The known words: the part before the separator, or whole entries if none has a separator."""
        known = self.entries.select("word")
        if self.table is None:
            known = known.union(self.bare().select(to_text(F.col("seq"), self.metadata.encoding)))
        return known.distinct()

    def decompile(self) -> DataFrame:
        """``(line)``: ``stem SEP word [SEP tag]``, with a tag column in all rows if any row has a tag."""
        any_tag = self.entries.agg(F.coalesce(F.bool_or(F.col("tag").isNotNull()), F.lit(False)).alias("tagged"))
        sep = F.lit(self.metadata.separator)
        base = F.concat(F.coalesce("stem", F.lit("")), sep, F.col("word"))
        line = F.when(F.col("tagged"), F.concat(base, sep, F.coalesce("tag", F.lit("")))).otherwise(base)
        return self.entries.crossJoin(F.broadcast(any_tag)).select(line.alias("line"))  # one row is broadcast

    def unsafe_entries(self) -> DataFrame:
        """Entries that a decompiled line could not bring back, as their stem or word has the separator."""
        has = lambda c: F.coalesce(F.contains(F.col(c), F.lit(self.metadata.separator)), F.lit(False))
        return self.entries.where(has("stem") | has("word")).select("word", "stem", "tag")


def with_bytes(found: DataFrame, metadata: Metadata) -> DataFrame:
    """Results with the bytes of word, stem and tag in the dictionary's charset: ``word_bytes``, ``stem_bytes``, ``tag_bytes``."""
    return found.select("*", *(to_bytes(F.col(c), metadata.encoding).alias(f"{c}_bytes") for c in ("word", "stem", "tag")))


class Stemmer:
    """A dictionary as something that transforms tables, and as a lazily opened one that a session knows by name."""

    _known: dict[tuple[int, str], Lexicon] = {}
    _paths: dict[str, str] = {}
    _lock = Lock()

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon

    def transform(self, words: DataFrame, column: str = "word", how: str = "inner") -> DataFrame:
        return lookup(words, self.lexicon, column, how)

    @classmethod
    def register(cls, name: str, path: str) -> None:
        """Names a dictionary: a saved lexicon or a binary one with its metadata; it is opened when first asked for."""
        with cls._lock:
            cls._paths[name] = path
            for key in [k for k in cls._known if k[1] == name]:
                del cls._known[key]

    @classmethod
    def named(cls, spark: SparkSession, name: str) -> Stemmer:
        """The dictionary of this name, opened once in a session, by whichever thread comes first."""
        with cls._lock:
            if name not in cls._paths:
                raise KeyError(f"no dictionary is registered as {name!r}; known: {', '.join(sorted(cls._paths)) or 'none'}")
            key = id(spark), name
            if key not in cls._known:
                path = cls._paths[name]
                cls._known[key] = Lexicon.load(spark, path) if is_folder(spark, path) else Lexicon.read(spark, path)
            return cls(cls._known[key])


#: The probe's form in joins. The library's own columns carry names that no table is likely to have.
_WORD, _BEST = "_lexspark_word", "_lexspark_best"


def free(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of the names that a result is about to add, in whatever case: a result's columns replace
    those of the input, as ``withColumn`` does."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in taken))


def _probes(words: DataFrame, column: str, metadata: Metadata) -> DataFrame:
    """Probes with their converted form, null where the dictionary cannot have it."""
    w = converted(F.col(column), metadata.input_conversion)
    fit = ~F.contains(w, F.lit(metadata.separator)) & in_charset(w, metadata.encoding)
    if charsets.several_bytes(metadata.encoding):  # the separator's byte may be part of a character
        fit &= ~F.contains(F.decode(to_bytes(w, metadata.encoding), "ISO-8859-1"), F.lit(metadata.separator_byte.decode("latin-1")))
    return words.withColumn(_WORD, F.when(fit, w))


def lookup(words: DataFrame, lexicon: Lexicon, column: str = "word", how: str = "inner", with_seq: bool = False) -> DataFrame:
    """Each row of ``words`` with the ``stem`` and ``tag`` of every entry of its word; ``how``: inner, left or anti.

    A null word, one with the separator, or one that the charset lacks finds nothing. Columns stem and tag of ``words``
    give way; others may have any name. ``with_seq`` adds ``seq``, by whose bytes a dictionary orders a word's entries.
    """
    m, own = lexicon.metadata, ("stem", "tag", "seq") if with_seq else ("stem", "tag")
    if how == "anti":
        forms = lexicon.forms.select(F.col("word").alias(_WORD))
        return _probes(words, column, m).join(forms.distinct(), _WORD, "left_anti").drop(_WORD)
    probes = _probes(free(words, *(c for c in own if c != column)), column, m)
    out = probes.join(lexicon.forms.select(F.col("word").alias(_WORD), *own), _WORD, how)
    shown = F.coalesce(converted(F.col(_WORD), m.output_conversion) if m.output_conversion else F.col(_WORD), F.col(column))
    return out.withColumn(column, shown).drop(_WORD)


def synthesize(probes: DataFrame, lexicon: Lexicon, stem: str = "stem", tag: str = "tag") -> DataFrame:
    """Each row of ``probes`` (stem, tag) with every ``word`` that has both."""
    return probes.join(lexicon.forms.select(F.col("stem").alias(stem), F.col("tag").alias(tag), "word"), [stem, tag])


def applied(words: DataFrame, lexicon: Lexicon, column: str = "word", skip_tags: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """``(line)``: ``word => stem tag`` for each result, ``word => [not found]`` without one; empty words are skipped.

    ``order`` has the columns that tell the place of a word: lines come in this order, those of one word in the
    dictionary's, by one sort by ranges.
    """
    found = lookup(words.where(F.length(column) > 0), lexicon, column, "left", with_seq=bool(order))
    if order:
        found = found.orderBy(*order, "seq")
    parts = [F.coalesce("stem", F.lit(""))] + ([] if skip_tags else [F.coalesce("tag", F.lit(""))])
    known = F.col("stem").isNotNull() | F.col("tag").isNotNull()
    return found.select(F.concat(F.col(column), F.lit(" => "), F.when(known, F.concat_ws(" ", *parts)).otherwise("[not found]")).alias("line"))


def frequencies(words: DataFrame, lexicon: Lexicon, column: str = "word") -> DataFrame:
    """Each row with ``frequency``, 0 to 25: the last letter of the word's first entry in byte order, if the flag is on."""
    if not lexicon.metadata.frequency_included:
        return words.withColumn("frequency", F.lit(0))
    first = Window.partitionBy("word").orderBy("seq")
    best = lexicon.forms.withColumn("n", F.row_number().over(first)).where("n = 1")
    letter = F.conv(F.hex(F.substring("seq", -1, 1)), 16, 10).cast("int") - 65
    # the entries' file is much smaller than what they take in the driver's memory, so they aren't left to be broadcast
    best = best.select(F.col("word").alias(_WORD), letter.alias(_BEST)).hint("merge")
    return _probes(words, column, lexicon.metadata).join(best, _WORD, "left").withColumn("frequency", F.coalesce(_BEST, F.lit(0))).drop(_WORD, _BEST)
