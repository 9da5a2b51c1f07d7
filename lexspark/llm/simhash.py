"""SimHash near duplicates by pigeonhole blocks, and the components of their links.

A fingerprint has the bits that are set in over half of the hashes of a text's shingles. Fingerprints are cut into blocks;
two that differ in at most ``distance`` bits agree in all blocks but as many, so they share a key for one choice of the
other blocks. A join on these keys proposes pairs and the Hamming distance decides.

A bucket of many fingerprints isn't expanded into pairs. Each of its fingerprints is hung on the points that lie within
half the distance of it and in the bucket; two are close enough if and only if they share such a point, and at most as
many share one as a point has neighbours. All of them are links, and a star of them joins the same components.

Style: fingerprints in an Arrow map, joins and components as DataFrames. Only distinct fingerprints are joined, at 8 bytes
each, so copies cost nothing beyond their own row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, named, slices, table
from .hashing import mix
from .jaccard import components

SEED = 42
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: The bits of each byte, the lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


@dataclass(frozen=True)
class SimHashOptions:
    shingle: int = 3
    distance: int = 2  # even, so that there are points half-way
    blocks: int = 6  # more blocks: longer keys and more of them
    small_bucket: int = 32
    piece: int = 1 << 20  # bytes of a long text that are cut in words at once

    def __post_init__(self) -> None:
        if self.distance % 2 or not 0 <= self.distance < self.blocks:
            raise ValueError(f"distance: {self.distance} must be even and smaller than the number of blocks")


def block_masks(o: SimHashOptions) -> list[int]:
    """For each choice of the blocks that must agree, the bits in them."""
    edges = [round(i * 64 / o.blocks) for i in range(o.blocks + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, o.blocks - o.distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _word_lists(data: bytes, piece: int) -> Iterator[list[bytes]]:
    a = 0
    while a < len(data):
        gap = _BLANK.search(data, a + piece) if a + piece < len(data) else None
        b = gap.start() if gap else len(data)
        yield data[a:b].split()
        a = b


def fingerprint(text: str | None, o: SimHashOptions = SimHashOptions()) -> int:
    """The fingerprint of a text: 0 without words; fewer words than a shingle has are hashed as one."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes, only A-Z change
    ones, total, words = np.zeros(64, np.int64), 0, []

    def count(hashes: list[int]) -> None:
        parts = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        for i in range(8):
            ones[8 * i : 8 * i + 8] += np.bincount(parts[:, i], minlength=256) @ _BITS

    for more in _word_lists(data, o.piece):
        words += more
        if len(words) >= o.shingle:
            joined, at, ends = b" ".join(words), 0, []
            starts = []
            for w in words:
                starts.append(at)
                at += len(w)
                ends.append(at)
                at += 1
            hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[o.shingle - 1 :])]
            count(hashes)
            total += len(hashes)
            words = words[len(words) - o.shingle + 1 :]
    if not total and words:
        count([xxhash.xxh64_intdigest(b" ".join(words), SEED)])
        total = 1
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: SimHashOptions = SimHashOptions()) -> DataFrame:
    """``(id, fp, node)`` for each row: the fingerprint as a signed long, and that one with its bits mixed one to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2_000_000):
            fp = np.array([fingerprint(t, options) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64)), pa.array(mix(fp).view(np.int64))], ["id", "fp", "node"])

    slim = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, fp long, node long")


def _midpoints(fp: Column, mask: Column, distance: int) -> Column:
    """The points within half the distance of ``fp`` that agree with it in ``mask``; those outside the mask are null."""
    flips = [_signed(sum(1 << i for i in c)) for k in range(distance // 2 + 1) for c in combinations(range(64), k)]
    return F.transform(F.array(*map(F.lit, flips)), lambda x: F.when(x.bitwiseAND(mask) == 0, fp.bitwiseXOR(x)))


def close_links(points: DataFrame, options: SimHashOptions = SimHashOptions()) -> DataFrame:
    """Links ``(a, b)`` between nodes of ``points`` (fp, node; distinct), which join what all close pairs would join."""
    o = options
    masks = F.array(*(F.lit(_signed(m)) for m in block_masks(o)))
    keyed = points.select("fp", "node", F.posexplode(masks).alias("choice", "mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    bucket = Window.partitionBy("choice", "key")
    shared = checkpointed(keyed.withColumn("c", F.count(F.lit(1)).over(bucket)).where("c > 1"))
    few, many = shared.where(F.col("c") <= o.small_bucket), shared.where(F.col("c") > o.small_bucket)
    left, right = few.select("choice", "key", F.col("fp").alias("x"), F.col("node").alias("a")), few.select("choice", "key", F.col("fp").alias("y"), F.col("node").alias("b"))
    pairs = left.join(right, ["choice", "key"]).where("a < b").where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= o.distance)
    hung = many.select("choice", "node", F.explode(_midpoints(F.col("fp"), F.col("mask"), o.distance)).alias("point")).where("point IS NOT NULL")
    star = hung.withColumn("a", F.min("node").over(Window.partitionBy("choice", "point"))).select("a", F.col("node").alias("b")).where("a <> b")
    return pairs.select("a", "b").union(star).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: SimHashOptions = SimHashOptions()) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row.

    Null texts, and those without words, have fingerprint zero and are linked like any other. Rows with one fingerprint
    are one component, repeated rows and rows with one id too. Null ids have no say in the smallest id of a component; a
    component of null ids only has a null one. An empty table gives an empty result; other columns are not read, whatever
    their names. Texts are taken whole, long ones in pieces.
    """
    base = checkpointed(fingerprints(docs, id_col, text_col, options))
    points = checkpointed(base.groupBy("fp", "node").agg(F.min("id").alias("least")))
    labels = components(close_links(points.select("fp", "node"), options))
    placed = points.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    component = placed.groupBy("label").agg(F.min("least").alias("component"))
    final = placed.join(component, "label").select("fp", "component")
    out = base.join(final, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


# The five primes of XXH64.
_P = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _xxh64() -> str:
    """XXH64 of the column ``h`` (hexadecimal), of ``n`` bytes, from its rule, as steps of SQL from ``g`` to ``hashed``."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in _P)
    m = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)"
    rot = lambda x, r: f"({m(f'({x}) * {1 << r}::UHUGEINT')} + ({x}) // {1 << (64 - r)}::UHUGEINT)"
    little = lambda at, size: f"('0x' || {' || '.join(f'substr(h, 2 * ({at}) + {2 * i + 1}, 2)' for i in reversed(range(size)))})::UBIGINT::UHUGEINT"
    xor = lambda a, b: f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"
    lane = lambda x: m(f"{rot(m(f'({x}) * {p2}'), 31)} * {p1}")
    # one step of a lane of the long form: acc + x * p2, turned by 31, times p1; a step is split so that nothing is worked out twice
    stripe = lambda k: f"list_transform(range(n // 32), lambda i: {little(f'32 * i + {8 * k}', 8)})"
    step = lambda acc, x: m(f"list_transform([{m(f'{acc} + {x} * {p2}')}], lambda z: {rot('z', 31)})[1] * {p1}")
    start = [m(f"{SEED} + {p1} + {p2}"), m(f"{SEED} + {p2}"), f"{SEED}::UHUGEINT", m(f"18446744073709551616::UHUGEINT + {SEED} - {p1}")]
    lanes = ", ".join(f"list_reduce(list_prepend({start[k]}, {stripe(k)}), lambda acc, x: {step('acc', 'x')}) AS v{k}" for k in range(4))
    merged = "v"
    for k in range(4):
        merged = f"list_transform([{merged}], lambda w{k}: {m(f'''{xor(f'w{k}', f'l{k}')} * {p1} + {p4}''')})[1]"
    eight = f"list_transform([{xor('acc', 'x')}], lambda z: {m(f'{rot('z', 27)} * {p1} + {p4}')})[1]"
    four = f"list_transform([{xor('a', m(f'{little('n // 8 * 8', 4)} * {p1}'))}], lambda z: {m(f'{rot('z', 23)} * {p2} + {p3}')})[1]"
    one = f"list_transform([{xor('acc', m(f'x * {p5}'))}], lambda z: {m(f'{rot('z', 11)} * {p1}')})[1]"
    return f"""
), x0 AS (SELECT g, h, n, {lanes} FROM hexed
), x1 AS (SELECT *, {", ".join(f"{lane(f'v{k}')} AS l{k}" for k in range(4))}, {m(" + ".join(rot(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))))} AS v FROM x0
), x2 AS (SELECT g, h, n, {m(f"(CASE WHEN n >= 32 THEN {merged} ELSE {m(f'{SEED} + {p5}')} END) + n::UHUGEINT")} AS a FROM x1
), x3 AS (SELECT g, h, n, list_reduce(list_prepend(a, list_transform(range(n // 32 * 4, n // 8), lambda i: {lane(little('8 * i', 8))})), lambda acc, x: {eight}) AS a FROM x2
), x4 AS (SELECT g, h, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE a END AS a FROM x3
), x5 AS (SELECT g, list_reduce(list_prepend(a, list_transform(range(n // 4 * 4, n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT::UHUGEINT)), lambda acc, x: {one}) AS a FROM x4
), x6 AS (SELECT g, {m(f"{xor('a', f'a // {1 << 33}::UHUGEINT')} * {p2}")} AS a FROM x5
), x7 AS (SELECT g, {m(f"{xor('a', f'a // {1 << 29}::UHUGEINT')} * {p3}")} AS a FROM x6
), hashed AS (SELECT g, xor(a::UBIGINT, (a // {1 << 32}::UHUGEINT)::UBIGINT) AS x FROM x7"""


#: Hashes of the distinct shingles, bits by count, all pairs of distinct fingerprints, and reachability: for small tables.
SQL = (
    r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM d
), hexed AS (SELECT g, hex(encode(g)) AS h, strlen(g) AS n FROM (SELECT DISTINCT g FROM s)"""
    + _xxh64()
    + f"""
), f AS (
  SELECT doc_id, ({" + ".join(f"CASE WHEN 2 * sum((x >> {i}) & 1) > count(*) THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64))})::UBIGINT AS fp FROM s JOIN hashed USING (g) GROUP BY doc_id
), a AS (SELECT doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM d LEFT JOIN f USING (doc_id)
), p AS (SELECT fp, min(doc_id) AS least FROM a GROUP BY fp
), e AS (SELECT x.fp AS x, y.fp AS y FROM p x JOIN p y ON x.fp <> y.fp AND bit_count(xor(x.fp, y.fp)) <= 2
), r(x, y) AS (SELECT fp, fp FROM p UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
), m AS (SELECT r.x, min(least) AS component_id FROM r JOIN p ON p.fp = r.y GROUP BY r.x)
SELECT doc_id, format('{{:016x}}', fp) AS fingerprint, component_id FROM a JOIN m ON m.x = a.fp
"""
)
