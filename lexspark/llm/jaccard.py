"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

Sets are grouped in bands of size. Within a band, sets that are similar enough differ in at most k elements. The domain
of the elements (64-bit hashes) is cut into k + 1 + spare ranges, so at least 1 + spare ranges hold the same elements in
both sets: the hash of what a range holds is a signature, and similar sets share several. Ranges that hold nothing would
make one signature common to many sets. A set with few empty ranges leaves those out, and as many fewer signatures must
be shared then; only a set with more of them, a rare one, signs them too. Two sets that share too few are no candidates.

Signatures propose, exact intersections decide:

1. each set is compared with one other set of its buckets, the one that shares most buckets with others;
2. links make components; a bucket whose sets are all in one component has nothing left to tell;
3. of the other buckets, each set leaves the most frequent ones out, as many as it may lose and still share one with
   any similar set; in what remains, candidates from different components are compared: small buckets pair by pair, large ones
   as blocks of sets against blocks of those outside the bucket's largest component.

So no link between different texts is lost, and the copies of a large group are never expanded into pairs. Equal sets
count as one from the start.

Style: shingles and signatures in Arrow maps around numpy, joins and components as DataFrames. Sets of the documents
that share a signature, a small part of all, are the only ones ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, named, release, slices, table, told_apart, unused
from .hashing import mix, shingle_set, word_hashes

SPARE, UNSIGNED = 6, 2
BANDS = 64  # the lowest bits of a signature name its band


@dataclass(frozen=True)
class JoinOptions:
    shingle: int = 4
    percent: int = 85  # links need 100 * intersection >= percent * union
    band: float = 1.5  # largest by smallest size of a band
    small_bucket: int = 32
    block: int = 1024  # sets on each side of a block
    block_items: int = 2_000_000  # shingles on each side of a block, or one set
    broadcast_ids: int = 1_000_000  # at 16 bytes each


def band_limits(o: JoinOptions, size: int) -> list[int]:
    """Lower limits of the bands up to the one above ``size``."""
    out = [1]
    while out[-1] <= size:
        out.append(max(out[-1] + 1, int(out[-1] * o.band)))
    out.append(max(out[-1] + 1, int(out[-1] * o.band)))
    return out


def differences(o: JoinOptions, high: int) -> int:
    """Most elements in which similar sets of at most ``high`` elements differ."""
    return 2 * high * (100 - o.percent) // (100 + o.percent)


def spare(k: int) -> tuple[int, int]:
    """Ranges beyond k + 1, and how many empty ones go unsigned."""
    return min(SPARE, k), min(UNSIGNED, min(SPARE, k) // 2)


def ranges_by_band(o: JoinOptions) -> list[int]:
    """Ranges less those that may go unsigned, by band: of these, two sets share all but one for each difference."""
    limits, out = band_limits(o, 10**12), []
    for i in range(BANDS):
        k = differences(o, limits[i + 1] - 1)
        more, unsigned = spare(k)
        out.append(k + 1 + more - unsigned)
    return out


def highest_by_band(o: JoinOptions) -> list[int]:
    """The largest size of a band; the last one that signatures name stands for all above and has none."""
    limits = band_limits(o, 10**12)
    return [limits[i + 1] - 1 for i in range(BANDS - 1)] + [1 << 40]


def signatures(values: np.ndarray, o: JoinOptions, limits: list[int]) -> np.ndarray:
    """Signatures of a sorted set of 64-bit hashes: for its own band, and for the next if a partner may be there."""
    n, out = len(values), []
    if not n:
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values))))
    i = int(np.searchsorted(limits, n, side="right")) - 1
    while o.percent * limits[i] <= 100 * n:
        k = differences(o, limits[i + 1] - 1)
        more, unsigned = spare(k)
        parts = k + 1 + more
        # equal ranges of the domain of 64-bit hashes
        edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
        cut = np.concatenate(([0], np.searchsorted(values, edges), [n]))
        held = sums[cut[1:]] - sums[cut[:-1]]
        sig = mix(held + mix(np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1)))
        sig = (sig & np.uint64(2**64 - BANDS)) | np.uint64(min(i, BANDS - 1))
        empty = cut[1:] == cut[:-1]
        out.append(sig if empty.sum() > unsigned else sig[~empty])
        i += 1
    return np.concatenate(out)


def _sets(texts: list, o: JoinOptions) -> list[np.ndarray]:
    return [shingle_set(w, o.shingle) for w in word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])]


def _set_id(s: np.ndarray, salt: int) -> int:
    """A hash of the whole set: its own mixing, apart from that of the signatures."""
    total = np.add.reduce(mix(s ^ mix(np.array([0xD6E8FEB86659FD93 + salt], np.uint64)))) + np.uint64(len(s))
    return int(mix(np.array([total]))[0].astype(np.int64))


#: The salt of the second hash of a set.
_OTHER = 1 << 32


def _base(docs: DataFrame, o: JoinOptions, salt: int) -> DataFrame:
    """``(id, tid, set_id, other, n)``, with two hashes of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 500_000):
            sets = _sets(b.column("text").to_pylist(), o)
            ids, others = ([_set_id(s, k) if len(s) else None for s in sets] for k in (salt, _OTHER))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tid"), pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(map(len, sets), pa.int64())], ["id", "tid", "set_id", "other", "n"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, tid long, set_id long, other long, n long")


def _signed(docs: DataFrame, o: JoinOptions, salt: int) -> DataFrame:
    """``(set_id, n, sig)`` for each signature; a set that its task has seen before brings none again.

    Signatures take about as much room as the texts, so they are made where they are shuffled and not written before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        limits = band_limits(o, 16)
        for b in slices(batches, "text", 500_000):
            ids, n, sigs = [], [], [np.zeros(0, np.uint64)]
            for s in _sets(b.column("text").to_pylist(), o):
                if not len(s) or (k := _set_id(s, salt)) in seen:
                    continue
                seen.add(k)
                if 100 * len(s) >= o.percent * limits[-2]:  # the bands of all partners, too
                    limits = band_limits(o, 200 * len(s) // o.percent)
                ids.append(k)
                n.append(len(s))
                sigs.append(signatures(s, o, limits))
            many = list(map(len, sigs[1:]))
            columns = [np.repeat(np.array(x, np.int64), many) for x in (ids, n)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate(sigs).view(np.int64))], ["set_id", "n", "sig"])

    return docs.select("text").mapInArrow(run, "set_id long, n long, sig long")


def _loaded(docs: DataFrame, wanted: DataFrame, o: JoinOptions, salt: int) -> DataFrame:
    """``(set_id, n, items)`` of the sets in ``wanted`` (id, tid, set_id), from the texts of one document each.

    Its id and the hash of its text find the document; a null id does, too. Of rows that repeat both, a task reads one.
    """
    few = wanted.count() <= o.broadcast_ids
    w = (F.broadcast(wanted) if few else wanted).select(F.col("id").alias("_id"), F.col("tid").alias("_tid"), "set_id")
    rows = docs.join(w, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tid") == F.col("_tid"))).select("set_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, "text", 500_000):
            new = []
            for k in b.column("set_id").to_pylist():
                new.append(k not in seen)
                seen.add(k)
            b = b.filter(pa.array(new, pa.bool_()))
            if not b.num_rows:
                continue
            sets = _sets(b.column("text").to_pylist(), o)
            keep = [_set_id(s, salt) == k for s, k in zip(sets, b.column("set_id").to_pylist(), strict=True)]
            sets = [s for s, k in zip(sets, keep, strict=True) if k]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array((np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("set_id").filter(pa.array(keep, pa.bool_())), pa.array(map(len, sets), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["set_id", "n", "items"])

    return rows.mapInArrow(run, "set_id long, n long, items array<long>").dropDuplicates(["set_id"])


def _linked(pairs: DataFrame, sets: DataFrame, o: JoinOptions) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough, by their exact intersection."""
    a, b = sets.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia")), sets.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    size = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * o.percent
    both = pairs.join(b, "b").join(a, "a").where(size)
    common = F.size(F.array_intersect("ia", "ib"))
    return both.where(100 * common >= o.percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of a link ``(a, b)``: all nodes of a component get its smallest node.

    Each round hangs every node on its smallest neighbour, twice over, and contracts; edges inside a node vanish. For
    nodes that are hashes, the number of rounds grows with the logarithm of a component's size. Labels and edges are checkpointed every round.
    """
    edges = checkpointed(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = checkpointed(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        up = checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("up")))
        again = up.select(F.col("v").alias("up"), F.col("up").alias("top"))
        up = checkpointed(up.join(again, "up", "left").select("v", F.coalesce("top", "up").alias("up")))
        labels = checkpointed(labels.join(up.withColumnRenamed("v", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        moved = edges.join(up.select(F.col("v").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("v").alias("b"), F.col("up").alias("y")), "b").where("x <> y")
        edges = checkpointed(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels


def _owners(owner: np.ndarray, low: np.ndarray, n: np.ndarray, sets: int, limit: int = 1 << 20) -> np.ndarray:
    """How often each set owns one of the places ``low`` to ``low + n``; about ``limit`` places are held at once."""
    out, upto, i = np.zeros(sets, np.int64), np.cumsum(n), 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + limit, "right")))
        k = n[i:j]
        at = np.repeat(low[i:j] - np.cumsum(k) + k, k) + np.arange(k.sum())
        out += np.bincount(owner[at], minlength=sets)
        i = j
    return out


def _block_links(mixed: DataFrame, sets: DataFrame, o: JoinOptions) -> DataFrame:
    """Links across components in large buckets, of which several with the same largest component are seen together.

    Members in blocks meet the sets outside the largest component in blocks, so that every pair meets once in a task
    that holds a bounded number of sets and of shingles. One link to each component is enough for a set.
    """
    sized = mixed.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = sized.groupBy("sig").agg(F.max_by("label", F.struct("c", "label")).alias("g"))
    rows = mixed.join(largest, "sig").select("g", "set_id", "label", "n").distinct()
    # twice the blocks that an even deal would need, as sets are dealt by their hashes
    blocks = lambda c: F.greatest(F.ceil(F.count_if(c) / o.block), F.ceil(2 * F.sum(F.when(c, F.col("n"))) / o.block_items))
    counts = rows.groupBy("g").agg(blocks(F.lit(True)).alias("mb"), blocks(F.col("label") != F.col("g")).alias("ub"))
    rows = checkpointed(rows.join(counts, "g").withColumn("h", F.xxhash64("set_id")))
    member = rows.select("g", "set_id", "label", F.pmod("h", "mb").alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ub") - 1)).alias("u"), F.lit(False).alias("outside"))
    outside = rows.where("label <> g").select("g", "set_id", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mb") - 1)).alias("m"), F.pmod("h", "ub").alias("u"), F.lit(True).alias("outside"))
    percent = o.percent

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        inner, outer = pdf[~pdf.outside], pdf[pdf.outside]
        found: list[tuple[int, int]] = []
        if len(inner) and len(outer):
            flat, size = np.concatenate(list(inner["items"])), inner["items"].map(len).to_numpy()
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(inner)), size)[order]
            ids, labels = inner.set_id.to_numpy(), inner.label.to_numpy()
            for a, label, items in zip(outer.set_id, outer.label, outer["items"], strict=True):
                low = np.searchsorted(flat, items, "left")
                common = _owners(owner, low, np.searchsorted(flat, items, "right") - low, len(inner))
                like = np.flatnonzero((100 * common >= percent * (size + len(items) - common)) & (labels != label))
                _, first = np.unique(labels[like], return_index=True)
                found += [(a, b) for b in ids[like[first]]]
        return pd.DataFrame(found, columns=["a", "b"])

    held = member.unionByName(outside).join(sets.select("set_id", "items"), "set_id")
    return held.groupBy("g", "m", "u").applyInPandas(run, "a long, b long")


def _order() -> Column:
    """Rows in order: those without id last, and of equal ids by text."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "tid")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: JoinOptions = JoinOptions()) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row.

    A null text, or one without words, has an empty set and is linked with nothing. Rows with the same set are in one
    component, repeated rows too. Null ids have no say in the smallest id of a component; a component of null ids only
    has a null one. An empty table gives an empty result; other columns are not read. Texts are taken whole.
    """
    out = _placed(docs, id_col, text_col, options)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def _placed(docs: DataFrame, id_col: str, text_col: str, o: JoinOptions) -> DataFrame:
    """``(set_id, id, tid, n, label, component)`` for each row: the hash of its text, its component, and that one's smallest id."""
    slim = docs.select(named(id_col).alias("id"), F.xxhash64(named(text_col)).alias("tid"), named(text_col).alias("text"))
    base, salt = told_apart(lambda k: _base(slim, o, k), "set_id", "other")
    by_sig = Window.partitionBy("sig")
    ranges = F.element_at(F.array(*map(F.lit, ranges_by_band(o))), (F.col("band") + 1).cast("int"))

    def need(both: Column) -> Column:
        """Signatures that similar sets share at least, whose sizes add up to ``both``: they differ in no more elements."""
        return F.greatest(ranges - F.floor(both * (100 - o.percent) / (100 + o.percent)), F.lit(1))

    def several(rows: DataFrame) -> DataFrame:
        """Rows of the signatures that more than one set has."""
        shared = rows.withColumn("lo", F.min("set_id").over(by_sig)).withColumn("hi", F.max("set_id").over(by_sig)).where("lo <> hi")
        return shared.select("sig", "set_id", "n").distinct()

    # of the sizes that a partner in the band may have, the largest leaves most room for differences
    highest = F.element_at(F.array(*map(F.lit, highest_by_band(o))), (F.col("band") + 1).cast("int"))
    largest = F.col("n") + F.least(F.floor(F.col("n") * 100 / o.percent), F.greatest(highest, F.col("n")))
    signed = several(_signed(slim, o, salt)).withColumn("band", F.pmod("sig", F.lit(BANDS)))
    rich = signed.withColumn("mine", F.count(F.lit(1)).over(Window.partitionBy("set_id", "band"))).where(F.col("mine") >= need(largest))
    buckets = checkpointed(several(rich).withColumn("band", F.pmod("sig", F.lit(BANDS))))
    release(slim.sparkSession)
    reps = base.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min(_order()).alias("r")).select("set_id", "r.id", "r.tid")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of the candidates (a, b), checkpointed, those that are similar; with the sets of all of them loaded once."""
        members = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
        sets = checkpointed(_loaded(slim, checkpointed(reps.join(members, "set_id", "left_semi")), o, salt))
        return checkpointed(_linked(pairs, sets, o))

    # the set that shares most buckets leads: near an original, its copies differ less from it than from each other
    weight = buckets.withColumn("c", F.count(F.lit(1)).over(by_sig)).groupBy("set_id").agg(F.sum("c").alias("w"))
    led = buckets.join(weight, "set_id").withColumn("lead", F.max(F.struct("w", "set_id", "n")).over(by_sig)).select(F.col("lead.set_id").alias("a"), F.col("set_id").alias("b"), "band", "lead.w", (F.col("lead.n") + F.col("n")).alias("both"))
    led = led.where("a <> b").groupBy("a", "b", "band", "w", "both").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= need(F.col("both")))
    first = checkpointed(led.groupBy("b").agg(F.max(F.struct("c", "w", "a")).alias("x")).select("x.a", "b"))
    links = linked(first)
    labels = components(links)

    # similar sets share ``need`` signatures, so one of them is left when each set drops its most frequent need - 1
    own = Window.partitionBy("set_id", "band")
    rare = buckets.withColumn("c", F.count(F.lit(1)).over(by_sig)).withColumn("mine", F.count(F.lit(1)).over(own))
    rare = rare.withColumn("rank", F.row_number().over(own.orderBy("c", "sig"))).where(F.col("rank") <= F.col("mine") - need(largest) + 1).drop("c", "mine", "rank")
    placed = rare.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    open_ = placed.withColumn("lo", F.min("label").over(by_sig)).withColumn("hi", F.max("label").over(by_sig)).where("lo <> hi")
    mixed = checkpointed(open_.withColumn("c", F.count(F.lit(1)).over(by_sig)).select("sig", "band", "set_id", "n", "label", "c"))
    few, many = mixed.where(F.col("c") <= o.small_bucket), mixed.where(F.col("c") > o.small_bucket)
    x, y = few.select("sig", "band", F.col("set_id").alias("a"), F.col("label").alias("la"), F.col("n").alias("na")), few.select("sig", F.col("set_id").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"))
    close = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * o.percent
    pairs = x.join(y, "sig").where("a < b AND la <> lb").where(close).select("a", "b", "band", (F.col("na") + F.col("nb")).alias("both")).distinct()
    lists = buckets.groupBy("set_id", "band").agg(F.collect_list("sig").alias("sigs"))  # as many as the set has ranges
    for side in ("a", "b"):
        pairs = pairs.join(lists.select(F.col("set_id").alias(side), "band", F.col("sigs").alias(f"sigs_{side}")), [side, "band"])
    pairs = pairs.where(F.size(F.array_intersect("sigs_a", "sigs_b")) >= need(F.col("both")))
    near = checkpointed(pairs.select("a", "b").distinct())
    release(slim.sparkSession)
    more = linked(near)
    if not many.isEmpty():
        members = many.select("set_id").distinct()
        sets = checkpointed(_loaded(slim, checkpointed(reps.join(members, "set_id", "left_semi")), o, salt))
        more = checkpointed(more.unionByName(_block_links(many, sets, o)))
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    all_reps = reps.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    least = all_reps.groupBy("label").agg(F.min("id").alias("component"))
    final = all_reps.join(least, "label").select("set_id", "label", "component")
    return base.select("id", "tid", "set_id", "n").join(final, "set_id", "left")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: JoinOptions = JoinOptions()) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id, of these the one with the smallest
    hash of its text, and any one of the rows that repeat both. Rows without id come last; those without words all stay.
    Columns may have any name.
    """
    found = checkpointed(_placed(docs, id_col, text_col, options).where("set_id IS NOT NULL").select("id", "tid", "label"))
    chosen = found.groupBy("label").agg(F.min(_order()).alias("r")).select(F.col("r.id").alias("x"), F.col("r.tid").alias("y"))
    rows = found.groupBy("id", "tid").agg(F.count(F.lit(1)).alias("rows"))
    marked = rows.join(chosen, F.col("id").eqNullSafe(F.col("x")) & (F.col("tid") == F.col("y")), "left")
    i, t = unused(docs, "own_id", "own_tid")
    marked = marked.select(F.col("id").alias(i), F.col("tid").alias(t), F.col("y").isNull().alias("gone"), "rows")
    marked = checkpointed(marked.where("gone OR rows > 1"))
    same = named(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(named(text_col)) == F.col(t))
    kept = docs.join(marked.select(i, t), same, "left_anti")
    again = marked.where("NOT gone").select(i, t)
    if again.isEmpty():
        return kept
    again = docs.join(again, same).dropDuplicates([i, t])  # within a task first, so a large group is no large task
    return kept.unionByName(again.select(*map(named, docs.columns)))


#: Sets as lists, all pairs that share a shingle, and reachability: for small tables.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' ')) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b
), m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d JOIN m ON m.a = d.doc_id LEFT JOIN n USING (doc_id)
"""
