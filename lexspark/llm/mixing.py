"""Mixing sources to target weights by systematic sampling.

Within a source, documents stand in order of size, and each is expected to be taken as often as the target is larger
than the source. The running sum of these expectations, moved by one random offset, takes a document once for every
whole number that it passes. The order by size spreads the taken documents over all sizes, so that words, too, come
close to the target.

The running sum needs no sort of a whole source: documents are counted in small cells (source, size class, hash), the
cells get their offsets, and only the documents of one cell are numbered together. A hot source or a frequent size is
spread over 256 cells of each size class.

Style: DataFrame functions only. Nothing but numbers is shuffled, unless the caller carries columns along. Sizes are
written once to the shared folder, at some 60 bytes a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, named, table

WEIGHTS = (5, 2, 1)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``, one row for each source.

    A source whose share by weight exceeds twice its size stops there. Seen in order of size by weight, the stopped
    ones come first, so sums from both ends tell where they end. The windows span the sources only, one row each.
    """
    k = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    lcm = 1
    for w in weights:
        lcm = lcm * w
    weight = F.element_at(F.array(*map(F.lit, weights)), (k % len(weights) + 1).cast("int"))
    s = sources.withColumn("k", k).withColumn("w", weight.cast("long")).withColumn("by_weight", F.col("source_size") * (lcm / F.col("w")).cast("long"))
    order = Window.orderBy("by_weight", "k")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("c", F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("rest", F.sum("w").over(after)).withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    over = 3 * F.col("all") - 4 * F.col("c")
    s = s.withColumn("open", _wide(4 * F.col("source_size")) * _wide(F.col("rest")) >= _wide(over) * _wide(F.col("w")))
    s = s.withColumn("first", F.min(F.when(F.col("open"), F.struct("by_weight", "k", over.alias("over"), "rest"))).over(Window.partitionBy()))
    free = F.col("first").isNotNull() & (F.struct("by_weight", "k") >= F.struct("first.by_weight", "first.k"))
    share = (F.col("w") * F.col("first.over")).cast("double") / (2 * F.col("first.rest")).cast("double")
    return s.select("source", "source_size", F.when(free, share).otherwise((2 * F.col("source_size")).cast("double")).alias("target"))


def _placeable(rows: DataFrame) -> DataFrame:
    """Adds to ``(id, source, size)`` what tells a document's cell: size class ``level``, ``part`` by hash, and ``key`` of the source."""
    binary = F.bin("size")
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    rows = rows.withColumn("level", F.concat(F.lpad(F.length(binary).cast("string"), 2, "0"), F.substring(binary, 2, 3)))
    return rows.withColumn("part", F.substring("h", 1, 2)).withColumn("key", F.coalesce(F.concat(F.lit("v"), "source"), F.lit("n")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)`` for each row, and the columns in ``carry``.

    A null text has no words and is never taken for more than 0 words; a null source is a source of its own, the last
    one; a null id sorts as an empty one. Repeated rows are rows of their own. An empty table, or one without words,
    gives zeros. The offset comes from a hash of the source, so reruns agree.
    """
    slim = [named(id_col).alias("id"), named(source_col).alias("source"), words_in(named(text_col)).alias("size"), F.xxhash64(named(text_col)).alias("tid")]
    numbers = checkpointed(_placeable(docs.select(*slim)))  # the sizes of all texts, so that they are counted once
    kept = [named(c).alias(f"c{i}") for i, c in enumerate(carry)]
    rows = _placeable(docs.select(*slim, *kept)) if carry else numbers

    cells = numbers.groupBy("key", "source", "level", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("cell_size"))
    by_source = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights)
    by_source = by_source.select(F.coalesce(F.concat(F.lit("v"), "source"), F.lit("n")).alias("key"), "source_size", "target")
    ahead = Window.partitionBy("key").orderBy("level", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(by_source, "key")

    placed = rows.join(cells.select("key", "level", "part", "before", "source_size", "target"), ["key", "level", "part"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("key", "level", "part").orderBy("size", "h", "tid")) - 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    shift = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), "key").cast("binary")), 1, 6), 16, 10).cast("double") / 16777216.0
    placed = placed.withColumn("place", place.cast("double")).withColumn("rate", rate).withColumn("shift", shift)
    copies = F.least(F.floor(F.col("rate") * (F.col("place") + 1.0) + F.col("shift")) - F.floor(F.col("rate") * F.col("place") + F.col("shift")), F.lit(2)).cast("long")
    return placed.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"),
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all their columns."""
    names = docs.columns
    inner = docs.select(*(named(c).alias(f"x{i}") for i, c in enumerate(names)), F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("source").alias("_source"))
    out = mix(inner, "_id", "_text", "_source", carry=tuple(f"x{i}" for i in range(len(names))))
    many = out.where("copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return many.select(*(F.col(f"x{i}").alias(c) for i, c in enumerate(names)))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), r AS (
  SELECT *, lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || substr(bin(size), 2, 3) AS level, substr(h, 1, 2) AS part FROM d
), s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM s0
), s2 AS (SELECT *, [5, 2, 1][k % 3 + 1]::BIGINT AS w, source_size * [2, 5, 10][k % 3 + 1] AS by_weight FROM s1
), s3 AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY by_weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS c,
    sum(w) OVER (ORDER BY by_weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS rest, sum(source_size) OVER ()::HUGEINT AS total FROM s2
), f AS (
  SELECT by_weight AS b, k AS fk, 3 * total - 4 * c AS left_over, rest AS left_weight FROM s3
  WHERE 4 * source_size * rest >= (3 * total - 4 * c) * w ORDER BY by_weight, k LIMIT 1
), s AS (
  SELECT source, source_size, CASE WHEN b IS NOT NULL AND (by_weight > b OR (by_weight = b AND k >= fk))
    THEN CAST(w * left_over AS DOUBLE) / CAST(2 * left_weight AS DOUBLE) ELSE CAST(2 * source_size AS DOUBLE) END AS target
  FROM s3 LEFT JOIN f ON true
), p AS (
  SELECT r.doc_id, r.size, s.source_size, s.target,
    CAST(row_number() OVER (PARTITION BY r.source ORDER BY level, part, size, h) - 1 AS DOUBLE) AS place,
    CASE WHEN s.source_size > 0 THEN s.target / CAST(s.source_size AS DOUBLE) ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce('v' || r.source, 'n')), 1, 6) AS BIGINT) AS DOUBLE) / 16777216.0 AS shift
  FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target, CAST(least(floor(rate * (place + 1.0) + shift) - floor(rate * place + shift), 2) AS BIGINT) * size AS taken FROM p
"""
