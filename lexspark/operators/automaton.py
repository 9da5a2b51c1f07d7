"""Automata as tables: sequences, their prefix tree, its merged states, ranks and matches.

An automaton is the set of its sequences. The state behind a prefix is its right language, the set of suffixes; it is
known by their count and two order-free sums of their hashes, so states come from one aggregation with partial sums,
and no task holds the language of the root. Prefixes and suffixes go by hashes and by their place in the sorted set, so
that rows have one size and bytes grow with the sequences' lengths; only results that show a prefix hold its bytes. The
hashes are made in Arrow batches, all else is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.encoders import shared_prefix_length
from ..functions.hashes import mixed, part_hashes
from ..sources.store import checkpointed, numbered, written

#: Bytes whose parts are hashed at once, or one sequence.
AT_ONCE = 1 << 18
#: Bits of a place that hold the depth; a sequence has fewer bytes than that.
DEPTH_BITS = 24
#: Kinds of a match.
EXACT, NO_MATCH, HAS_PREFIX, IS_A_PREFIX = 0, -1, -3, -4


def sequences(df: DataFrame, column: str = "seq") -> DataFrame:
    """The set of the non-null, non-empty values of a column as ``(seq BINARY)``."""
    seq = F.col(column).cast("binary").alias("seq")
    return df.select(seq).where(F.octet_length("seq") > 0).distinct()


def _part(c: Column, start: Column | int, size: Column) -> Column:
    return F.substring(c, start if isinstance(start, Column) else F.lit(start), size)


def prefixes(seqs: DataFrame) -> DataFrame:
    """``(prefix, label, rest, depth)`` for every position of every sequence: the sum of lengths in rows."""
    n = F.octet_length("seq")
    at = seqs.select("seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("depth"))
    d = F.col("depth")
    return at.select(_part(F.col("seq"), 1, d).alias("prefix"), _part(F.col("seq"), d + 1, F.lit(1)).alias("label"), _part(F.col("seq"), d + 2, n).alias("rest"), "depth")


def tree_arcs(seqs: DataFrame) -> DataFrame:
    """Arcs of the unmerged tree: ``(prefix, label, is_final, is_terminal)``."""
    return prefixes(seqs).groupBy("prefix", "label").agg(
        F.bool_or(F.octet_length("rest") == 0).alias("is_final"), F.bool_and(F.octet_length("rest") == 0).alias("is_terminal")
    )


def right_languages(seqs: DataFrame) -> DataFrame:
    """``(prefix, count, state)``: sequences below each prefix, and a key that equal right languages share."""
    suffix = F.concat("label", "rest")
    return (
        prefixes(seqs)
        .groupBy("prefix")
        .agg(F.count(F.lit(1)).alias("count"), F.bit_xor(F.xxhash64(suffix)).alias("x"), F.sum(F.xxhash64(suffix, F.lit(1)).cast("decimal(20,0)")).alias("s"))
        .select("prefix", "count", F.struct("count", "x", "s").alias("state"))
    )


def _positions(seqs: DataFrame) -> DataFrame:
    """For each position of each sequence of ``seqs`` (seq, rank): the prefix ``p`` before it and ``q`` with it, its label,
    hashes of the suffix, what is left of the sequence, and its place, by which prefixes sort: the rank, then the depth."""
    fields = "place long, label binary, p1 long, p2 long, q1 long, q2 long, x long, s long, height int, is_last boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_, ranks = b.column("seq").to_pylist(), b.column("rank").to_numpy()
            sizes = np.array([len(x) for x in all_], np.int64)
            if sizes.max(initial=0) >= 1 << DEPTH_BITS:
                raise ValueError(f"a sequence has more than {(1 << DEPTH_BITS) - 1} bytes")
            at = 0
            while at < len(all_):
                upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), AT_ONCE, "right")) + at)
                part, size = all_[at:upto], sizes[at:upto]
                depth, p1, p2, q1, q2, s1, s2, last = part_hashes(part)
                labels = pa.FixedSizeBinaryArray.from_buffers(pa.binary(1), len(depth), [None, pa.py_buffer(b"".join(part))]).cast(pa.binary())
                long = lambda v: pa.array(v.view(np.int64))
                left = np.repeat(size, size) - depth
                yield pa.RecordBatch.from_arrays(
                    [pa.array((np.repeat(ranks[at:upto], size) << DEPTH_BITS) + depth), labels, *map(long, (p1, p2, q1, q2, mixed(s1, 1) ^ mixed(s2, 2), mixed(s1 ^ mixed(s2, 3)))), pa.array(left.astype(np.int32)), pa.array(last)],
                    ["place", "label", "p1", "p2", "q1", "q2", "x", "s", "height", "is_last"],
                )
                at = upto

    return seqs.mapInArrow(run, fields)


class Graph:
    """The merged automaton of a set of sequences, worked out once: its tree's arcs, prefixes and states."""

    def __init__(self, seqs: DataFrame) -> None:
        self.seqs = numbered(seqs.select("seq").orderBy("seq"), "rank")
        key, few = ["p1", "p2"], self.seqs.rdd.getNumPartitions() < (cores := seqs.sparkSession.sparkContext.defaultParallelism)
        self.tree = written(
            _positions(self.seqs.repartition(cores) if few else self.seqs).groupBy(*key, "label").agg(
                F.bool_or("is_last").alias("is_final"), F.bool_and("is_last").alias("is_terminal"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.count(F.lit(1)).alias("n"),
                F.bit_xor("x").alias("x"), F.bit_xor("s").alias("s"), F.max("height").alias("height"), F.min("place").alias("place"),
            ), "arcs",
        )
        below = self.tree.groupBy(*key).agg(F.sum("n").alias("count"), F.bit_xor("x").alias("x"), F.bit_xor("s").alias("s"), F.max("height").alias("height"), F.min("place").alias("place"))
        below = below.select(*key, "count", "height", "place", F.struct("count", "x", "s").alias("state"))
        first = below.groupBy("state").agg(F.min("place").alias("name"))  # a state may have any number of prefixes
        self.prefixes = written(below.join(first, "state"), "prefixes")

    @cached_property
    def states(self) -> DataFrame:
        """``(state, at, count, height)``; ``at`` is the place of the state's first prefix in byte order."""
        return self.prefixes.where("place = name").select("state", F.col("name").alias("at"), "count", "height")

    @cached_property
    def arcs(self) -> DataFrame:
        """``(src, label, dst, is_final, is_terminal)``, states by place; no dst if terminal."""
        own = self.prefixes.where("place = name").select("p1", "p2", F.col("name").alias("src"))
        target = self.prefixes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("name").alias("dst"))
        return self.tree.drop("place").join(own, ["p1", "p2"]).join(target, ["q1", "q2"], "left").select("src", "label", "dst", "is_final", "is_terminal")

    def shown(self, rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` with places as the bytes of their prefixes; a null one stays null."""
        for i, c in enumerate(columns):
            known = self.seqs.select(F.col("rank").alias(f"_rank{i}"), F.col("seq").alias(f"_seq{i}"))
            rank, depth = F.shiftright(c, DEPTH_BITS), F.col(c).bitwiseAND((1 << DEPTH_BITS) - 1).cast("int")
            rows = rows.join(known, rank == F.col(f"_rank{i}"), "left").withColumn(c, _part(F.col(f"_seq{i}"), 1, depth)).drop(f"_rank{i}", f"_seq{i}")
        return rows


def states(seqs: DataFrame) -> DataFrame:
    """Merged states: ``(state, name, count)``, named after their first prefix in byte order."""
    g = Graph(seqs)
    return g.shown(g.states, "at").select("state", F.col("at").alias("name"), "count")


def merged_arcs(seqs: DataFrame) -> DataFrame:
    """Arcs of the merged automaton: ``(src, label, dst, is_final, is_terminal)``, states by name; no dst if terminal."""
    g = Graph(seqs)
    return g.shown(g.arcs, "src", "dst")


def totals(seqs: DataFrame) -> DataFrame:
    """One row of totals. Nodes, arcs and final arcs count one more than the states have, as for the terminal state."""
    g = Graph(seqs)
    arcs = g.arcs.agg(F.count(F.lit(1)).alias("a"), F.count_if("is_final").alias("f")).crossJoin(g.states.agg(F.count(F.lit(1)).alias("n")))
    tree = g.tree.agg(F.count(F.lit(1)).alias("tree_arcs"))
    sizes = seqs.agg(F.count(F.lit(1)).alias("sequences"), F.max(F.octet_length("seq")).cast("long").alias("longest"))
    return arcs.crossJoin(tree).crossJoin(sizes).select((F.col("n") + 1).alias("nodes"), (F.col("a") + 1).alias("arcs"), (F.col("f") + 1).alias("finals"), "tree_arcs", "sequences", "longest")


def fan_outs(seqs: DataFrame) -> DataFrame:
    """``(fan_out, states)`` for every number of arcs between the smallest and the largest, 0 where no state has it."""
    found = Graph(seqs).arcs.groupBy("src").agg(F.count(F.lit(1)).alias("fan_out")).groupBy("fan_out").agg(F.count(F.lit(1)).alias("states"))
    span = found.agg(F.min("fan_out").alias("a"), F.max("fan_out").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("fan_out"))
    return span.join(found, "fan_out", "left").select("fan_out", F.coalesce("states", F.lit(0)).alias("states"))


def label_counts(seqs: DataFrame) -> DataFrame:
    return Graph(seqs).arcs.groupBy("label").agg(F.count(F.lit(1)).alias("arcs"))


def top_labels(seqs: DataFrame, most: int = 31) -> DataFrame:
    """The labels with most arcs, as a label table of that many entries holds them."""
    return label_counts(seqs).orderBy(F.desc("arcs"), "label").limit(most)


def in_links(seqs: DataFrame) -> DataFrame:
    """``(state, in_links)`` of the states that an arc leads to."""
    g = Graph(seqs)
    return g.shown(g.arcs.where(F.col("dst").isNotNull()).groupBy(F.col("dst").alias("state")).agg(F.count(F.lit(1)).alias("in_links")), "state")


def hot_states(seqs: DataFrame, most: int = 150) -> DataFrame:
    """States with more than two incoming arcs, those with most first."""
    return in_links(seqs).where("in_links > 2").orderBy(F.desc("in_links"), F.desc("state")).limit(most)


#: Most sequences that are numbered together; a cell with more is split by the next two bytes.
CELL, DEEPEST = 100_000, 16


def ranked(seqs: DataFrame, cell: int = CELL) -> DataFrame:
    """``(seq, rank)``: the 0-based rank in byte order.

    Sequences are numbered within cells that share a prefix, after the counts of the cells before; a whole set is never
    sorted in one task. Cells share two bytes, and where more than ``cell`` sequences do, four, six and so on up to
    ``DEEPEST``, so that many sequences with one beginning are no large task.
    """
    levels, parts, open_ = [], [], seqs.select("seq")
    for size in range(2, DEEPEST + 1, 2):
        counts = open_.groupBy(F.substring("seq", 1, size).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        full = checkpointed(counts.where((F.col("n") > cell) & (F.octet_length("cell") == size))) if size < DEEPEST else None
        more = full is not None and not full.isEmpty()
        mine = open_.withColumn("cell", F.substring("seq", 1, size))
        here = mine.join(full.select("cell"), "cell", "left_anti") if more else mine
        parts.append(here.select("seq", "cell"))
        levels.append(here.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
        if not more:
            break
        open_ = mine.join(full.select("cell"), "cell", "left_semi").select("seq")
    rows, counts = reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, levels)
    # a sequence that ends within a cell's prefix is a cell of its own, before those that go on
    before = counts.select("cell", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("seq")) - 1
    return rows.join(before, "cell").select("seq", (F.col("before") + place).alias("rank"))


def _shared(a: Column, b: Column) -> Column:
    """Bytes that both share at their start; 0 if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), shared_prefix_length(a, b)).otherwise(0)


def nearest(probes: DataFrame, seqs: DataFrame) -> DataFrame:
    """``(probe, before, behind)``: for each of the distinct probes the last sequence not after it, and the first one not
    before it, null where there is none.

    Probes and sequences are sorted together by ranges, once. Within a range neighbours come from windows; what the last
    sequence of the ranges before is, and the first one of those behind, comes from a table with a row for each range.
    """
    both = probes.select("probe", F.lit(False).alias("known")).union(seqs.select("seq", F.lit(True)))
    held = checkpointed(both.repartitionByRange("probe").withColumn("range", F.spark_partition_id()))
    entry = F.when(F.col("known"), F.col("probe"))
    edges = held.groupBy("range").agg(F.max(entry).alias("last"), F.min(entry).alias("first"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("range", F.max("last").over(ahead).alias("last"), F.min("first").over(behind).alias("first"))
    up = Window.partitionBy("range").orderBy("probe").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("range").orderBy(F.desc("probe")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = held.withColumn("before", F.max(entry).over(up)).withColumn("behind", F.min(entry).over(down)).where("NOT known")
    return placed.join(edges, "range").select("probe", F.coalesce("before", "last").alias("before"), F.coalesce("behind", "first").alias("behind"))


def matched(probes: DataFrame, seqs: DataFrame, probe: str = "probe") -> DataFrame:
    """``(probe, kind, index)`` for the distinct probes: the longest prefix that a probe shares with any sequence is one
    that it shares with a neighbour in byte order, so that prefixes need not be spread out."""
    p = probes.select(F.col(probe).cast("binary").alias("probe")).where(F.col(probe).isNotNull()).distinct()
    near = nearest(p, seqs)
    n, size = F.octet_length("probe"), F.greatest(_shared(F.col("probe"), F.col("before")), _shared(F.col("probe"), F.col("behind")))
    near = near.withColumn("size", size)
    kind = F.when(F.col("before") == F.col("probe"), EXACT).when(F.col("size") == n, IS_A_PREFIX).when(F.col("size") > 0, HAS_PREFIX).otherwise(NO_MATCH)
    return near.select("probe", kind.alias("kind"), F.when(kind == HAS_PREFIX, F.col("size")).otherwise(0).alias("index"))


def perfect_hash(probes: DataFrame, seqs: DataFrame, probe: str = "probe") -> DataFrame:
    """``(probe, hash)``: the rank of a probe that is a sequence, else the code of its mismatch."""
    kinds = matched(probes, seqs, probe)
    return kinds.join(ranked(seqs).withColumnRenamed("seq", "probe"), "probe", "left").select("probe", F.coalesce("rank", F.col("kind").cast("long")).alias("hash"))


def expanded(starts: DataFrame, seqs: DataFrame, prefix: str = "prefix") -> DataFrame:
    """``(prefix, suffix)``: all continuations of each given prefix, by an equi-join on prefixes of the given lengths."""
    given = starts.select(F.col(prefix).cast("binary").alias("prefix")).where(F.col(prefix).isNotNull()).distinct()
    # one row with the few lengths that prefixes have, so that the cut is a projection and no join of inequalities
    sizes = given.agg(F.collect_set(F.octet_length("prefix")).alias("sizes"))
    fit = F.filter("sizes", lambda n: n < F.octet_length("seq"))
    cut = seqs.crossJoin(F.broadcast(sizes)).select("seq", F.explode(fit).alias("size")).select("seq", "size", _part(F.col("seq"), 1, F.col("size")).alias("prefix"))
    return given.join(cut, "prefix").select("prefix", _part(F.col("seq"), F.col("size") + 1, F.octet_length("seq")).alias("suffix"))


def below(seqs: DataFrame, start: bytes) -> DataFrame:
    """The sequences behind a prefix, less that prefix: the sub-automaton of its state."""
    rest = _part(F.col("seq"), len(start) + 1, F.octet_length("seq"))
    return seqs.where(F.startswith("seq", F.lit(bytes(start))) & (F.octet_length("seq") > len(start))).select(rest.alias("seq")) if start else seqs


def visits(seqs: DataFrame, order: str = "post", stop: DataFrame | None = None) -> DataFrame:
    """``(place, name, count, height)``: each state once, with targets before (``post``) or after (``pre``) their sources.

    Height is the length of the longest suffix, which falls along every arc. ``stop`` has a column name: states whose
    targets aren't visited through them, as when a visitor of the ``pre`` order says no. A visitor of the ``post``
    order stops by a filter on place. Places are counted within heights, so that no task holds all states.
    """
    if order not in ("post", "pre"):
        raise ValueError(f"order: {order!r} is neither post nor pre")
    if stop is None:
        g = Graph(seqs)
        each = g.shown(g.states.withColumnRenamed("at", "name"), "name").select("state", "name", "count", "height")
        return _ordered(each, order)
    high = prefixes(seqs).groupBy("prefix").agg(F.max(F.octet_length("rest") + 1).alias("height"))
    found = right_languages(seqs).join(high, "prefix")
    closed = found.join(found.groupBy("state").agg(F.min("prefix").alias("name")).join(stop.select("name"), "name", "left_semi"), "state", "left_semi").select(F.col("prefix").alias("above"))
    own = found.where(F.octet_length("prefix") > 0).select("prefix", F.explode(F.sequence(F.lit(0), F.octet_length("prefix") - 1)).alias("n"))
    under = own.select("prefix", _part(F.col("prefix"), 1, F.col("n")).alias("above")).join(closed, "above", "left_semi")
    found = found.join(under.select("prefix").distinct(), "prefix", "left_anti")
    each = found.groupBy("state").agg(F.min("prefix").alias("name"), F.first("count").alias("count"), F.max("height").alias("height"))
    return _ordered(each, order)


def _ordered(each: DataFrame, order: str) -> DataFrame:
    """States by height, and of one height by name, with their place."""
    rank = F.col("height") if order == "post" else -F.col("height")
    sizes = each.groupBy("height").agg(F.count(F.lit(1)).alias("n"))  # as many rows as the longest sequence has bytes
    before = sizes.select("height", F.coalesce(F.sum("n").over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("height").orderBy("name")) - 1
    return each.join(before, "height").select((F.col("before") + place).alias("place"), "name", "count", "height")


def dot_lines(seqs: DataFrame, start: bytes = b"") -> DataFrame:
    """``(line)``: the arcs of the merged automaton, or of the part behind a prefix, as statements of a graph description."""

    def shown(c: str) -> Column:
        text = F.decode(c, "ISO-8859-1")
        return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    end = F.when(F.col("dst").isNotNull(), F.concat(F.lit('"'), shown("dst"), F.lit('/"'))).otherwise(F.lit('"."'))
    style = F.when(F.col("is_final"), F.lit(", style=bold")).otherwise(F.lit(""))
    line = F.concat(F.lit('  "'), shown("src"), F.lit('/" -> '), end, F.lit(' [label="'), shown("label"), F.lit('"'), style, F.lit("];"))
    return merged_arcs(below(seqs, start)).orderBy("src", "label").select(line.alias("line"))


def dot(seqs: DataFrame, start: bytes = b"") -> str:
    """The graph description of a small automaton as one text; ``dot_lines`` is for larger ones."""
    return "digraph automaton {\n  rankdir = LR;\n" + "".join(r[0] + "\n" for r in dot_lines(seqs, start).collect()) + "}\n"
