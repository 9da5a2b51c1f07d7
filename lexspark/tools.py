"""Command line: fsa_compile, fsa_decompile, fsa_info, dict_compile, dict_decompile, dict_apply.

Exit codes: 0 done, 1 an error, 2 invalid arguments, 3 an existing output that ``--overwrite`` must confirm.
"""

from __future__ import annotations

import argparse
import codecs
import sys
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.lexicon import Lexicon, applied, checked_rows, source_rows, strict_bytes, strict_text
from .sources import readers, store
from .sources.formats import FormatError
from .sources.metadata import MetadataError, metadata_path, read_metadata

DONE, FAILED, INVALID, CONFIRM = 0, 1, 2, 3
ALIASES = {"fsa_build": "fsa_compile", "fsa_dump": "fsa_decompile"}


#: The input that stands for the standard input.
STDIN = "-"


class Unconfirmed(Exception):
    """The output exists."""


class BadPath(Exception):
    """An argument names no such file or folder."""


def _guard(spark: SparkSession, path: str, overwrite: bool) -> None:
    if not overwrite and store.exists(spark, path):
        raise Unconfirmed(f"{path} exists; use --overwrite")


def compile_fsa(spark: SparkSession, source: str, target: str, version: str = "fsa5", overwrite: bool = False, **checks) -> None:
    _guard(spark, target, overwrite)
    readers.write_fsa(readers.read_lines(spark, source, **checks).withColumnRenamed("line", "seq"), target, version, overwrite=overwrite)


def decompile_fsa(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    _guard(spark, target, overwrite)
    readers.write_one(readers.read_fsa(spark, source).orderBy("seq"), target, overwrite)


def fsa_info(spark: SparkSession, source: str) -> DataFrame:
    return readers.fsa_info(spark, source)


def compile_dict(spark: SparkSession, source: str, version: str = "fsa5", overwrite: bool = False, validate: bool = True, target: str | None = None, **checks) -> str:
    """Compiles ``source`` with the metadata next to it into a ``.dict`` file there, and reads it back to compare."""
    metadata = read_metadata(readers.read_bytes(spark, metadata_path(source)))
    target = target or metadata_path(source).removesuffix(".info") + ".dict"
    _guard(spark, target, overwrite)
    rows = checked_rows(source_rows(readers.read_lines(spark, source, **checks), metadata))
    lexicon = Lexicon.compile(rows, metadata)
    readers.write_fsa(lexicon.seqs, target, version, overwrite=True)
    if validate:
        back = readers.read_fsa(spark, target)
        if not back.exceptAll(lexicon.seqs).isEmpty() or not lexicon.seqs.exceptAll(back).isEmpty():
            raise FormatError(f"{target}: what was written differs from the source")
    return target


def decompile_dict(spark: SparkSession, source: str, target: str, overwrite: bool = False, validate: bool = True) -> None:
    _guard(spark, target, overwrite)
    lexicon = Lexicon.read(spark, source)
    if validate and not lexicon.unsafe_entries().isEmpty():
        raise FormatError("entries with the separator in a stem or word could not be compiled again; use --validate false")
    readers.write_one(lexicon.decompile().select(strict_bytes(F.col("line"), lexicon.metadata.encoding)), target, overwrite)


def apply_dict(spark: SparkSession, dictionary: str, source: str, charset: str = "UTF-8", skip_tags: bool = False) -> DataFrame:
    """Looks up each line of ``source``, which is in ``charset``, in the order of the input; empty lines are skipped."""
    lines = readers.read_lines(spark, source, accept_bom=True, accept_cr=True, ignore_empty=True, placed=True)
    words = lines.select(*readers.PLACE, F.regexp_replace(strict_text(F.col("line"), charset), "\r$", "").alias("word"))
    return applied(words, Lexicon.read(spark, dictionary), skip_tags=skip_tags, order=readers.PLACE)


def apply_stream(spark: SparkSession, dictionary: str, stream: BinaryIO, charset: str = "UTF-8", skip_tags: bool = False, batch: int = 100_000) -> Iterator[str]:
    """Looks up the lines of a byte stream such as the standard input, ``batch`` lines at a time, as they come and in their
    order. The stream is the driver's, so its lines pass the driver; files go by ``apply_dict``."""
    lexicon = Lexicon.read(spark, dictionary)
    lines = (line.decode(charset).rstrip("\r\n") for line in stream)
    while part := list(islice(lines, batch)):
        words = spark.createDataFrame([(i, w) for i, w in enumerate(part) if w], "at long, word string")
        yield from (r[0] for r in applied(words, lexicon, skip_tags=skip_tags, order=("at",)).toLocalIterator())


def _charset(text: str) -> str:
    try:
        return codecs.lookup(text).name
    except LookupError:
        raise argparse.ArgumentTypeError(f"unknown charset: {text}") from None


def _boolean(text: str) -> bool:
    if text.lower() not in ("true", "false", "yes", "no", "on", "off"):
        raise argparse.ArgumentTypeError(f"not a boolean: {text}")
    return text.lower() in ("true", "yes", "on")


def _check_paths(spark: SparkSession, a: argparse.Namespace) -> None:
    """Inputs exist, and outputs have a folder to go to."""
    for path in (a.input, getattr(a, "dictionary", None)):
        if path and path != STDIN and not any(c in path for c in "*?[{") and not store.exists(spark, path):
            raise BadPath(f"{path} does not exist")
    if out := getattr(a, "output", None):
        parent = out.rstrip("/").rpartition("/")[0]
        if parent and not store.is_folder(spark, parent):
            raise BadPath(f"{parent} is no folder")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexspark", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str) -> None:
        c = commands.add_parser(name, aliases=[a for a, n in ALIASES.items() if n == name])
        c.add_argument("-i", "--input", required="apply" not in flags, default=STDIN)
        c.add_argument("--exit", type=_boolean, default=True, help="whether the process ends with the exit code")
        if "output" in flags:
            c.add_argument("-o", "--output", required=name in ("fsa_compile", "fsa_decompile", "dict_decompile"))
            c.add_argument("--overwrite", action="store_true")
            c.add_argument("--validate", type=_boolean, default=True)
        if "lines" in flags:
            c.add_argument("-f", "--format", choices=("fsa5", "cfsa2"), default="fsa5", type=str.lower)
            for x in ("--accept-bom", "--accept-cr", "--ignore-empty"):
                c.add_argument(x, action="store_true")
        if "apply" in flags:
            c.add_argument("-d", "--dictionary", required=True)
            c.add_argument("--skip-tags", action="store_true")
            c.add_argument("--input-charset", type=_charset, default="UTF-8")

    command("fsa_compile", "output", "lines")
    command("fsa_decompile", "output")
    command("fsa_info")
    command("dict_compile", "output", "lines")
    command("dict_decompile", "output")
    command("dict_apply", "apply")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(args)
    except SystemExit as e:
        return INVALID if e.code else DONE
    spark = spark or SparkSession.builder.appName("lexspark").getOrCreate()
    name = ALIASES.get(a.command, a.command)
    checks = {k: getattr(a, k) for k in ("accept_bom", "accept_cr", "ignore_empty") if hasattr(a, k)}
    try:
        _check_paths(spark, a)
        if name == "fsa_compile":
            compile_fsa(spark, a.input, a.output, a.format, a.overwrite, **checks)
        elif name == "fsa_decompile":
            decompile_fsa(spark, a.input, a.output, a.overwrite)
        elif name == "fsa_info":
            for row in fsa_info(spark, a.input).collect():
                print("\n".join(f"{k}: {v}" for k, v in row.asDict().items() if v is not None))
        elif name == "dict_compile":
            compile_dict(spark, a.input, a.format, a.overwrite, a.validate, a.output, **checks)
        elif name == "dict_decompile":
            decompile_dict(spark, a.input, a.output, a.overwrite, a.validate)
        elif a.input == STDIN:
            for line in apply_stream(spark, a.dictionary, sys.stdin.buffer, a.input_charset, a.skip_tags):
                print(line)
        else:
            for row in apply_dict(spark, a.dictionary, a.input, a.input_charset, a.skip_tags).toLocalIterator():
                print(row[0])
    except Unconfirmed as e:
        print(e, file=sys.stderr)
        return CONFIRM
    except (MetadataError, BadPath) as e:
        print(e, file=sys.stderr)
        return INVALID
    except Exception as e:  # noqa: BLE001  every failure of a tool is an exit code
        print(e, file=sys.stderr)
        return FAILED
    return DONE


if __name__ == "__main__":
    code = main()
    if "--exit=false" not in sys.argv and not any(a == "--exit" and b.lower() in ("false", "no", "off") for a, b in zip(sys.argv, sys.argv[1:])):
        sys.exit(code)
