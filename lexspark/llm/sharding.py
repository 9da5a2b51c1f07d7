"""Sharding by a hierarchical weighted hash tree.

A document descends from the root over region and rack to its shard. At each node it draws a hash for every child and
takes the child with the smallest ``-ln(u) / weight``: each child wins in proportion to its weight, and a changed weight
moves documents only into or out of that child. A further shard becomes a region of its own, so that no weight inside
the old subtrees changes and documents move into the new shard only: the law is ``key``.

Slots count the documents of a shard without gaps, in the order of a hash. They are numbered in cells of the shard that
share the first digits of that hash, whose offsets come from counts. More documents take more digits, so that cells stay
small and no task holds a whole shard.

Style: DataFrame functions only. One shuffle of the slim rows (and of what the caller carries).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import named, table

OVERHEAD = 16
#: Documents for each cell, about; the slots are the same for any number.
CELL = 20_000


@dataclass(frozen=True)
class Tree:
    """Racks of ``per_rack`` shards and regions of ``per_region`` racks for the first ``base`` shards; then one region each."""

    base: int = 40
    per_rack: int = 5
    per_region: int = 4
    weights: tuple[tuple[int, float], ...] = ()  # of shards whose weight isn't 1

    def regions(self, shards: int) -> list[list[list[int]]]:
        first = list(range(min(shards, self.base)))
        racks = [list(range(min(i + self.per_rack, self.base)))[i:] for i in range(0, self.base, self.per_rack)]
        racks = [[s for s in r if s in first] for r in racks]
        grouped = [racks[i : i + self.per_region] for i in range(0, len(racks), self.per_region)]
        return [kept for g in grouped if (kept := [r for r in g if r])] + [[[s]] for s in range(self.base, shards)]

    def weight(self, node) -> float:
        return sum(map(self.weight, node)) if isinstance(node, list) else dict(self.weights).get(node, 1.0)


def _name(node) -> str:
    """A node is named after its first shard, which it keeps when it grows."""
    while isinstance(node, list):
        node = node[0]
    return str(node)


def _draw(key: Column, child: Column) -> Column:
    """-ln(u) / weight, with u over 0 and at most 1 from a hash of the document and the node."""
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), child["name"]).cast("binary")), 1, 12), 16, 10).cast("double") + 1.0) / float(1 << 48)
    return -F.log(u) / child["weight"]


def _children(groups: list[list], level: int, tree: Tree, ids: list[list[int]]) -> Column:
    """Name, weight and id of the children of each node of a level, as a constant."""
    one = lambda n, i: F.struct(F.lit(f"{level}.{_name(n)}").alias("name"), F.lit(float(tree.weight(n))).alias("weight"), F.lit(i).alias("id"))
    return F.array(*(F.array(*(one(n, i) for n, i in zip(g, k, strict=True))) for g, k in zip(groups, ids, strict=True)))


def _drawn(key: Column, children: Column, parent: Column) -> Column:
    return F.array_min(F.transform(F.get(children, parent), lambda c: F.struct(_draw(key, c).alias("d"), c["id"].alias("id"))))["id"]


def located(rows: DataFrame, shards: int, tree: Tree, out: str) -> DataFrame:
    """Adds the shard of each row's ``key`` as the column ``out``, level by level."""
    regions, key = tree.regions(shards), F.col("key")
    racks = [r for region in regions for r in region]
    numbers = iter(range(len(racks)))
    rack_ids = [[next(numbers) for _ in region] for region in regions]
    rows = rows.withColumn(out, _drawn(key, _children([regions], 0, tree, [list(range(len(regions)))]), F.lit(0)))
    rows = rows.withColumn(out, _drawn(key, _children(regions, 1, tree, rack_ids), F.col(out)))
    return rows.withColumn(out, _drawn(key, _children(racks, 2, tree, racks), F.col(out)))


def shard(docs: DataFrame, shards: int = 40, tree: Tree = Tree(), id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for each row, and the columns in ``carry``.

    A null text counts no bytes; a null id is hashed as the word null. Rows with the same id share a shard and have
    slots of their own. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [named(c).alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("crc"), *kept)
    rows = rows.withColumn("key", F.coalesce(F.col("id").cast("string"), F.lit("null")))
    h = F.md5(F.concat("key", F.lit("|slot")).cast("binary"))
    n, digits = docs.count(), 2  # the count is in the files' footers
    while shards * CELL * 16**digits < n:
        digits += 1
    rows = located(rows, shards, tree, "shard").withColumn("h", h).withColumn("part", F.substring("h", 1, digits))

    keys = located(docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("key")), shards, tree, "shard")
    cells = keys.groupBy("shard", F.substring(h, 1, digits).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))

    rows = rows.join(cells, ["shard", "part"])
    slot = F.col("before") + F.row_number().over(Window.partitionBy("shard", "part").orderBy("h", "key", "crc", "size")) - 1
    rows = located(rows.withColumn("slot", slot), shards + 1, tree, "grown")
    return rows.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", F.col("grown").alias("grown_shard"),
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


#: CRC-32 from its rule, and the descent with the default tree's regions, racks and shards; nodes of one level weigh alike but for shard 40.
SQL = r"""
WITH rule AS (
  SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t
), d AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS key, strlen(coalesce(text, ''))::BIGINT + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT doc_id, key, size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(size - 16), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda x, b: xor(t[(xor(x, b) & 255) + 1], x >> 8))) AS text_crc32 FROM d, rule
), r AS (
  SELECT *, list_min(list_transform([0, 20], lambda n: {'d': -ln((('0x' || substr(md5(key || '|0.' || n), 1, 12))::BIGINT + 1)::DOUBLE / 281474976710656.0) / 20, 'n': n})).n AS a,
    list_min(list_transform([0, 20, 40], lambda n: {'d': -ln((('0x' || substr(md5(key || '|0.' || n), 1, 12))::BIGINT + 1)::DOUBLE / 281474976710656.0) / CASE n WHEN 40 THEN 1 ELSE 20 END, 'n': n})).n AS g FROM c
), k AS (
  SELECT * REPLACE (list_min(list_transform([a, a + 5, a + 10, a + 15], lambda n: {'d': -ln((('0x' || substr(md5(key || '|1.' || n), 1, 12))::BIGINT + 1)::DOUBLE / 281474976710656.0), 'n': n})).n AS a,
    CASE g WHEN 40 THEN 40 ELSE list_min(list_transform([g, g + 5, g + 10, g + 15], lambda n: {'d': -ln((('0x' || substr(md5(key || '|1.' || n), 1, 12))::BIGINT + 1)::DOUBLE / 281474976710656.0), 'n': n})).n END AS g) FROM r
), s AS (
  SELECT * REPLACE (list_min(list_transform(range(a, a + 5), lambda n: {'d': -ln((('0x' || substr(md5(key || '|2.' || n), 1, 12))::BIGINT + 1)::DOUBLE / 281474976710656.0), 'n': n})).n AS a,
    CASE g WHEN 40 THEN 40 ELSE list_min(list_transform(range(g, g + 5), lambda n: {'d': -ln((('0x' || substr(md5(key || '|2.' || n), 1, 12))::BIGINT + 1)::DOUBLE / 281474976710656.0), 'n': n})).n END AS g) FROM k
)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, a::INTEGER AS shard, (row_number() OVER (PARTITION BY a ORDER BY md5(key || '|slot'), key, text_crc32, size) - 1)::BIGINT AS slot, g::INTEGER AS grown_shard FROM s
"""
