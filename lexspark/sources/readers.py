"""Sources and sinks of sequences and dictionaries, over any store that Spark reads.

Lines are bytes: the text source splits them, and nothing decodes them before their charset is known. An automaton is one
file, decoded or built by a single task; dictionaries meant for scale are kept as Parquet instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats, store
from .metadata import Metadata, metadata_path, read_metadata, write_metadata


class InputError(ValueError):
    """Input lines that were not asked for: a byte order mark, carriage returns, empty lines."""


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file, whole, on the driver."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = False) -> None:
    """A small file, through Hadoop's file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, overwrite)
    try:
        out.write(data)
    finally:
        out.close()


BOM = b"\xef\xbb\xbf"


def _starts_with_bom(spark: SparkSession, path: str) -> bool:
    """From the first three bytes of a file."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(b & 255 for b in (stream.read() for _ in range(3)) if b >= 0) == BOM
    finally:
        stream.close()


#: Where a line stands: its file, the part of the file that a task has read, and its place in what the task has read.
PLACE = ("file", "part", "at")


def read_lines(spark: SparkSession, path: str, accept_bom: bool = False, accept_cr: bool = False, ignore_empty: bool = False, placed: bool = False) -> DataFrame:
    """``(line BINARY)``: LF-separated byte lines; the last one may lack its LF. What isn't accepted raises an error.
    ``placed`` adds the columns of ``PLACE``, by which lines sort as they are in their files.

    The text source hands on the bytes of a line as they are, whatever their charset, and reads large files in parts.
    It drops a byte order mark, so that is looked for in the first bytes of each file.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    if not accept_bom:
        for name in text.inputFiles():
            if _starts_with_bom(spark, name):
                raise InputError(f"{name}: a byte order mark; use accept_bom to keep it out of the first line")
    line = F.col("value").cast("binary")
    if not accept_cr:
        line = F.when(F.contains(F.decode(line, "ISO-8859-1"), F.lit("\r")), F.raise_error(F.lit("carriage returns; use accept_cr to keep them")).cast("binary")).otherwise(line)
    if not ignore_empty:
        line = F.when(F.octet_length(line) == 0, F.raise_error(F.lit("an empty line; use ignore_empty to skip them")).cast("binary")).otherwise(line)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at")] if placed else []
    return text.select(line.alias("line"), *place).where(F.octet_length("line") > 0)


def line_violations(spark: SparkSession, path: str) -> DataFrame:
    """``(path, has_bom, cr_lines, empty_lines)`` of uncompressed files that aren't empty, without raising anything.

    No row holds more than a line. The text source drops a byte order mark, so a file that has one is larger by three
    bytes than its lines and their LFs, the last of which may be missing.
    """
    name, bytes_ = F.col("_metadata.file_path").alias("name"), F.octet_length("value")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", name, F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at")).alias("place"),
    )
    seen = lines.groupBy("name").agg(
        (F.count(F.lit(1)) + F.sum(bytes_)).alias("held"), F.count_if(F.contains("value", F.lit("\r"))).alias("cr"), F.count_if(bytes_ == 0).alias("empty"), F.min_by(bytes_, "place").alias("first"),
    )
    files = spark.read.format("binaryFile").load(path).select("path", "length", name).join(seen, "name", "left")
    bom, held = F.col("has_bom"), F.coalesce("held", F.lit(0))
    # a line that holds the mark alone isn't empty
    empty = F.coalesce("empty", F.lit(0)) - (bom & F.coalesce(F.col("first") == 0, F.lit(False))).cast("int")
    return files.withColumn("has_bom", F.col("length") - held >= 2).select("path", "has_bom", F.coalesce("cr", F.lit(0)).alias("cr_lines"), empty.alias("empty_lines"))


def read_fsa(spark: SparkSession, path: str, expect: int | None = None) -> DataFrame:
    """``(seq BINARY)``: all sequences of the automata at ``path``, of any of the three formats."""
    return fsa_sequences(spark.read.format("binaryFile").load(path).select("content"), expect)


def block_array(block: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes."""
    n, size = block.shape
    return pa.Array.from_buffers(pa.binary(size), n, [None, pa.py_buffer(np.ascontiguousarray(block))]).cast(pa.binary())


def fsa_sequences(files: DataFrame, expect: int | None = None) -> DataFrame:
    """``(seq BINARY)``: all sequences of the automata in the column ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                for block in formats.read(content, expect).blocks():
                    yield pa.RecordBatch.from_arrays([block_array(block)], ["seq"])

    return files.select("content").mapInArrow(run, "seq binary")


def fsa_info(spark: SparkSession, path: str) -> DataFrame:
    """One row for each automaton: version, flags, header fields and the totals of its graph."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "path string, version int, flags array<string>, nodes long, arcs long, final_arcs long, sequences long, size long, filler string, annotation string, node_data_length int, goto_length int, label_map string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                a = formats.read(content)
                nodes, arcs, finals, sequences = a.totals()
                h = a.header
                rows.append({
                    "path": name, "version": a.version, "flags": formats.flag_names(a.flags), "nodes": nodes + 1, "arcs": arcs + 1, "final_arcs": finals + 1,
                    "sequences": sequences, "size": len(content), "filler": h.get("filler", b"").decode("latin-1") or None, "annotation": h.get("annotation", b"").decode("latin-1") or None,
                    "node_data_length": h.get("node_data_length"), "goto_length": h.get("goto_length"), "label_map": h["label_map"].hex() if "label_map" in h else None,
                })
            kinds = pa.schema([("path", pa.string()), ("version", pa.int32()), ("flags", pa.list_(pa.string())), *((k, pa.int64()) for k in ("nodes", "arcs", "final_arcs", "sequences", "size")), ("filler", pa.string()), ("annotation", pa.string()), ("node_data_length", pa.int32()), ("goto_length", pa.int32()), ("label_map", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return raw.mapInArrow(run, schema)


def automaton_bytes(seqs: DataFrame, version: str = "fsa5", numbers: bool = False, **options) -> bytes:
    """The minimal automaton of ``(seq BINARY)`` as a file's bytes. Spark removes duplicates and sorts; one task builds."""
    if version not in formats.WRITERS:
        raise ValueError(f"version: {version!r} is none of {', '.join(formats.WRITERS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = formats.WRITERS[version]((s for b in batches for s in b.column("seq").to_pylist()), numbers=numbers, **options)
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["content"])

    one = seqs.select("seq").distinct().coalesce(1).sortWithinPartitions("seq").mapInArrow(run, "content binary")
    return bytes(one.first()[0])


def write_fsa(seqs: DataFrame, path: str, version: str = "fsa5", numbers: bool = False, overwrite: bool = False, **options) -> None:
    write_bytes(seqs.sparkSession, path, automaton_bytes(seqs, version, numbers, **options), overwrite)


def write_lines(seqs: DataFrame, path: str, encoding: str = "utf-8", overwrite: bool = False) -> None:
    """Sequences in byte order, one for each LF line: a folder of text files, or for other charsets a single file."""
    rows = seqs.select("seq").orderBy("seq")
    if encoding.lower().replace("-", "") == "utf8":
        rows.select(F.col("seq").cast("string").alias("value")).write.mode("overwrite" if overwrite else "errorifexists").option("lineSep", "\n").text(path)
    else:
        write_one(rows, path, overwrite)


def write_one(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """The rows of a one-column table of bytes, in their order, as the LF lines of a single file.

    Tasks write the parts, whose bytes are then streamed into one file; no row goes through Python on the driver.
    """
    spark = lines.sparkSession
    parts = f"{store.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    try:
        # a string column hands its bytes to the writer as they are
        lines.select(F.col(f"`{lines.columns[0]}`").cast("string").alias("value")).write.option("lineSep", "\n").text(parts)
        store.concatenated(spark, parts, path, overwrite)
    finally:
        store.remove(spark, parts)


def read_dictionary_files(spark: SparkSession, path: str) -> tuple[DataFrame, Metadata]:
    """Sequences of the automaton at ``path`` and the metadata expected next to it."""
    return read_fsa(spark, path), read_metadata(read_bytes(spark, metadata_path(path)))


def write_dictionary_files(seqs: DataFrame, metadata: Metadata, path: str, version: str = "fsa5", overwrite: bool = False) -> None:
    write_fsa(seqs, path, version, overwrite=overwrite)
    write_bytes(seqs.sparkSession, metadata_path(path), write_metadata(metadata), overwrite)
