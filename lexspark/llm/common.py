"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import checkpointed, release, remove, scratch, shared_folder, written  # noqa: F401  operators take all helpers from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed but lies in the same place as on the driver."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def named(name: str) -> Column:
    """The column of exactly this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        out.append(n)
    return out


def told_apart(make: Callable[[int], DataFrame], key: str, other: str, tries: int = 8) -> tuple[DataFrame, int]:
    """``make(salt)``, written, and the first salt for which no two values of ``other`` share a ``key``.

    ``key`` and ``other`` are independent 64-bit hashes of one thing, the first of which depends on the salt. So things
    are told apart as by 128 bits, and work goes on with 64.
    """
    for salt in range(tries):
        rows = checkpointed(make(salt))
        if rows.groupBy(key).agg(F.min(other).alias("a"), F.max(other).alias("b")).where("a <> b").isEmpty():
            return rows, salt
    raise ValueError(f"{key} is no hash: different things share it whatever the salt")


def draw(*key: Column | str) -> Column:
    """A number from 0 to 2^62 - 1 that depends on the key only, to draw samples by."""
    return F.shiftrightunsigned(F.xxhash64(*key), 2)


def drawn_below(expected: float, of: int) -> int:
    """The number below which ``draw`` leaves about ``expected`` rows of so many."""
    return min(1 << 62, int(expected / max(1, of) * (1 << 62)))


def is_training(doc_id: Column) -> Column:
    """The fold that models may learn from: crc32 of the id's text is no multiple of 5."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def held_out(doc_id: Column) -> Column:
    """True for the evaluation fold; a null id belongs to it, as nothing is learned from such a row."""
    return F.coalesce(~is_training(doc_id), F.lit(True))


def slices(batches: Iterator[pa.RecordBatch], text: str, max_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds at most ``max_chars`` bytes of text, or a single row."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > max_chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)
