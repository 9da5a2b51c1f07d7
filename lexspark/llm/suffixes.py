"""Suffix-array deduplication: longest previous factors over sparse suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts somewhere else. A suffix array of a whole corpus
would shuffle every byte many times over; here the array holds only the suffixes that can matter:

1. anchors: of each ``length``-byte string, the run of ``gram`` bytes with the smallest hash. Equal strings have equal
   anchors at equal offsets, so a repeat shows as a repeated anchor, about one for every 75 bytes of text;
2. an anchor whose whole surroundings (all strings that own it) repeat elsewhere is settled by their hash;
3. a match of another anchor covers half of what surrounds the gram on one side at least; anchors that share neither
   half with another one are settled, too: nothing there repeats. This ends most anchors in lines that many texts have;
4. the surroundings of the others, and one of each settled kind, go to blocks by anchor. Each block sorts its suffixes
   to the depth of ``length`` bytes; in suffix order, the previous and next smaller position that share ``length``
   bytes tell whether a suffix has an earlier match (it is a later copy) or only later ones (it is the first);
5. anchors with too many different surroundings for a block are parted by the halves that they share; where even one
   half has too many, the strings are counted by their hashes instead.

The result removes all copies, the first included, as later copies and firsts alike are told from the same order.

Style: Arrow maps around numpy for bytes, DataFrames for everything that meets across documents. What is shuffled are
anchors and a few surroundings, and texts twice, to meet what was found of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, slices, table, told_apart
from .hashing import mix, prefix_sums, range_hash, window_hash


@dataclass(frozen=True)
class RepeatOptions:
    length: int = 200
    gram: int = 50
    hot: int = 2000  # different surroundings of an anchor beyond which its strings are counted by hash
    block_bytes: int = 4_000_000
    broadcast_strings: int = 1_000_000  # at 24 bytes each
    piece: int = 1 << 18

    @property
    def reach(self) -> int:
        """Bytes before an anchor in the strings that may own it."""
        return self.length - self.gram


_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width] for every i that has so many."""
    out, have = x, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = pick(out[: len(out) - (width - have)], out[width - have :])
    return out


def anchors(data: np.ndarray, bounds: list[tuple[int, int]], o: RepeatOptions) -> tuple[np.ndarray, ...]:
    """Anchors of the texts at ``bounds`` in ``data``.

    Text number, offset in data, gram hash, hash of surroundings, how far before the anchor the first and the last of
    its strings start, and 32 bits each of the hashes of the halves: the gram with what is before it, and after it.
    """
    n, L, k, reach = len(data), o.length, o.gram, o.reach
    empty = np.zeros(0, np.int64)
    if n < L:
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty.view(np.uint64)
    sums = prefix_sums(data)
    h = window_hash(sums, k)
    low = _sliding(h, reach + 1, np.minimum)  # of the string that starts at each byte
    valid = np.zeros(n - L + 1, bool)
    for a, b in bounds:
        if b - a >= L:
            valid[a : b - L + 1] = True
    low = np.where(valid, low, np.uint64(0))
    # a gram is an anchor if it is the smallest of some string that has it
    padded = np.concatenate((np.zeros(reach, np.uint64), low, np.zeros(reach, np.uint64)))
    q = np.flatnonzero((_sliding(padded, reach + 1, np.maximum)[: len(h)] == h) & (h > 0))
    starts, ends = (np.array(x) for x in zip(*bounds, strict=True))
    text = np.searchsorted(starts, q, side="right") - 1
    # strings with the same smallest gram follow each other; an anchor owns those of its run that reach it
    run = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    run_end = np.append(run[1:], len(low)) - 1
    mine = np.searchsorted(run, q, side="right") - 1
    rest = np.arange(len(q))
    while len(rest):
        rest = rest[low[run[mine[rest]]] != h[q[rest]]]
        mine[rest] -= 1
    begin, stop = np.maximum(run[mine], q - reach), np.minimum(run_end[mine], q)
    around = range_hash(sums, begin, stop + L) ^ ((q - begin) * 1024 + q - stop).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    half = reach // 2  # a half that the text doesn't have room for is like no other, save in equal surroundings
    before = np.where(q - half >= starts[text], range_hash(sums, np.maximum(q - half, 0), q + k), around)
    after = np.where(q + k + half <= ends[text], range_hash(sums, q, np.minimum(q + k + half, n)), around)
    return text, q, h[q], around, q - begin, q - stop, (before & np.uint64(0xFFFFFFFF00000000)) | (after >> np.uint64(32))


def smaller_neighbours(position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the nearest one before it, and after it, with a smaller position; -1 and n where there is none."""
    n = len(position)
    before = np.arange(-1, n - 1)
    rest = np.arange(n)
    while len(rest):
        j = before[rest]
        rest = rest[(j >= 0) & (position[j] > position[rest])]
        before[rest] = before[before[rest]]
    after = np.arange(1, n + 1)
    rest = np.arange(n)
    padded = np.append(position, -1)
    while len(rest):
        j = after[rest]
        rest = rest[(j < n) & (padded[j] > position[rest])]
        after[rest] = after[after[rest]]
    return before, after


def repeated_suffixes(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order, to the depth of ``length`` bytes, of those ``starts`` that share so much with another one.

    Returns the indices of these starts in suffix order, the class of equal strings of each, and whether its longest
    previous factor (an earlier start, in the order of ``starts``) has ``length`` bytes, so that it is a later copy.
    """
    live = np.arange(len(starts))
    kind = np.zeros(len(starts), np.int64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for depth in range(0, length, 8):
        step = eight[starts[live] + depth].copy()
        if depth + 8 > length:
            step[:, length - depth :] = 0
        word = step.view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((word, kind))
        live, word, kind = live[order], word[order], kind[order]
        new = np.ones(len(live), bool)
        new[1:] = (word[1:] != word[:-1]) | (kind[1:] != kind[:-1])
        kind = np.cumsum(new) - 1
        many = np.bincount(kind, minlength=1)[kind] > 1 if len(kind) else np.zeros(0, bool)
        live, kind = live[many], kind[many]
        if not len(live):
            break
    before, after = smaller_neighbours(live)
    padded_kind = np.append(kind, -1)
    later = (padded_kind[before] == kind) | (padded_kind[after] == kind) if len(live) else np.zeros(0, bool)
    return live, kind, later


def merged(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of texts, with those that meet made one."""
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    far = np.int64(1) << 40
    reached = np.maximum.accumulate(end + text * far) if len(text) else end
    new = np.ones(len(text), bool)
    new[1:] = start[1:] + text[1:] * far > reached[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1 if len(text) else first
    return text[first], start[first], reached[last] - text[first] * far


def hash_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)).view(np.int64)


def _unpack(docs: DataFrame, o: RepeatOptions) -> DataFrame:
    """Anchors of every text, ``(h, c, tid, place, halves, weight)``, and runs that repeat inside it, with an ``end``.

    A text that its task has seen before is left out. The weight is 2 for an anchor that stands for several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def found(tids: list[int], datas: list[bytes]) -> pa.RecordBatch:
            if len(datas) == 1 and len(datas[0]) > 2 * o.piece:
                got, n = [], len(datas[0])
                whole = np.frombuffer(datas[0], np.uint8)
                for a in range(0, n, o.piece):  # each piece with all strings that its anchors can own
                    lo, hi = max(0, a - 2 * o.reach), min(n, a + o.piece + o.length + o.reach)
                    found_here = anchors(whole[lo:hi], [(0, hi - lo)], o)
                    own = (found_here[1] + lo >= a) & (found_here[1] + lo < a + o.piece)
                    got.append(tuple(x[own] + lo if i == 1 else x[own] for i, x in enumerate(found_here)))
                text, q, h, c, far, near, halves = (np.concatenate(x) for x in zip(*got, strict=True))
            else:
                ends = np.cumsum([len(d) for d in datas]).tolist()
                bounds = [(e - len(d), e) for d, e in zip(datas, ends, strict=True)]
                text, q, h, c, far, near, halves = anchors(np.frombuffer(b"".join(datas), np.uint8), bounds, o)
                q = q - np.array([b[0] for b in bounds] or [0])[text]
            # anchors that are alike within a text are settled here: one stays for others, the rest are runs of bytes
            order = np.lexsort((q, c, h, text))
            text, q, h, c, far, near, halves = (x[order] for x in (text, q, h, c, far, near, halves))
            new = np.ones(len(q), bool)
            new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            group = np.cumsum(new) - 1
            size = np.bincount(group, minlength=1)[group] if len(q) else group
            several, first = size > 1, new
            run_text, start, end = merged(text[several], (q - far)[several], (q - near)[several] + o.length)
            ids = np.array(tids, np.int64)
            none = np.zeros(len(start), np.int64)
            columns = [
                np.concatenate((h[first].view(np.int64), hash_of(ids[run_text] if len(run_text) else none, start))), np.concatenate((c[first].view(np.int64), none)),
                np.concatenate((ids[text[first]], ids[run_text] if len(run_text) else none)), np.concatenate((((q * 1024 + far) * 1024 + near)[first], start)),
                np.concatenate((halves[first].view(np.int64), none)), np.concatenate((np.minimum(size[first], 2), none)), np.concatenate((np.zeros(first.sum(), np.int64), end)),
            ]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["h", "c", "tid", "place", "halves", "weight", "end"])

        for b in slices(batches, "text", o.piece):
            tids, datas = [], []
            for k, t in zip(b.column("tid").to_pylist(), b.column("text").to_pylist(), strict=True):
                if t and k not in seen and len(d := t.encode("utf-8", "surrogatepass")) >= o.length:
                    seen.add(k)
                    tids.append(k)
                    datas.append(d)
            if datas:
                yield found(tids, datas)

    return docs.select("tid", "text").mapInArrow(run, "h long, c long, tid long, place long, halves long, weight long, end long")


def _surroundings(rows: DataFrame, o: RepeatOptions) -> DataFrame:
    """The strings of the anchors listed with each text, as one run of bytes for each bucket: ``(bucket, hot, tid, start, far, bytes)``."""
    length = o.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, "text", o.piece):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for k, t, marks in zip(*(b.column(c).to_pylist() for c in ("tid", "text", "marks")), strict=True):
                if k in seen:
                    continue
                seen.add(k)
                d = t.encode("utf-8", "surrogatepass")
                for m in marks:
                    s, far, size = m["place"] >> 20, m["place"] >> 10 & 1023, (m["place"] & 1023) + length
                    to = [(x, False) for x in (m["a"], m["b"]) if x] + [(0, True)] * (m["hot"] == 1)
                    for bucket, hot in to:
                        for column, v in zip(out, (bucket, hot, k, s, far, d[s : s + size]), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "hot", "tid", "start", "far", "bytes"])

    return rows.select("tid", "text", "marks").mapInArrow(run, "bucket long, hot boolean, tid long, start long, far long, bytes binary")


def _block_spans(near: DataFrame, blocks: int, o: RepeatOptions) -> DataFrame:
    length = o.length

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces, size = list(pdf["bytes"]), pdf["bytes"].map(len).to_numpy()
        data = np.frombuffer(b"".join(pieces), np.uint8)
        offset, n = np.cumsum(size) - size, np.maximum(size - length + 1, 0)
        row = np.repeat(np.arange(len(pdf)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        tid, at, start = pdf["tid"].to_numpy()[row], pdf["start"].to_numpy()[row] + inner, offset[row] + inner
        order = np.lexsort((at, tid))  # the order of positions; a place that several anchors bring counts once
        tid, at, start = tid[order], at[order], start[order]
        one = np.ones(len(tid), bool)
        one[1:] = (tid[1:] != tid[:-1]) | (at[1:] != at[:-1])
        tid, at, start = tid[one], at[one], start[one]
        live, _, _ = repeated_suffixes(data, start, length)
        live = np.sort(live)
        tid, at = tid[live], at[live]
        new = np.ones(len(tid), bool)
        new[1:] = (tid[1:] != tid[:-1]) | (at[1:] > at[:-1] + length)
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(tid)) - 1 if len(begin) else begin
        return pd.DataFrame({"tid": tid[begin], "start": at[begin], "end": at[last] + length})

    return near.groupBy(F.pmod(F.xxhash64("bucket"), F.lit(blocks)).alias("block")).applyInPandas(run, "tid long, start long, end long")


#: Strings that one cell of a hot anchor holds.
CELL = 8
_CORE, _UNION = (np.uint64(int(x)) for x in np.random.default_rng(22).integers(1, 1 << 63, 2))


@dataclass
class _Strings:
    """Hashes in the bytes of one hot anchor, whose gram starts at ``far``.

    Cells hold the strings that start ``CELL * i`` to ``CELL * i + CELL - 1`` before the gram. Equal strings lie equally
    far before equal grams, so they are in equal cells: if what all strings of a cell share is found nowhere else, no
    string of it is; if all bytes of a whole cell are found elsewhere, every string of it is.
    """

    bytes: bytes
    far: int
    length: int

    def __post_init__(self) -> None:
        self.sums = prefix_sums(np.frombuffer(self.bytes, np.uint8))
        self.count = len(self.bytes) - self.length + 1
        self.least = self.far - self.count + 1
        self.cell = np.arange(self.least // CELL, self.far // CELL + 1) * CELL
        self.core_at = self.far - self.cell
        self.core = (range_hash(self.sums, self.core_at, self.core_at + self.length - CELL + 1) ^ _CORE).view(np.int64)
        self.full = (self.cell >= self.least) & (self.cell + CELL - 1 <= self.far)
        at = np.where(self.full, self.core_at - CELL + 1, 0)
        self.union = (range_hash(self.sums, at, np.where(self.full, self.core_at + self.length, 1)) ^ _UNION).view(np.int64)

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of cores and of whole cells, and where they start."""
        return np.concatenate((self.core, self.union[self.full])), np.concatenate((self.core_at, self.core_at[self.full] - CELL + 1))

    def opened(self, known: tuple[np.ndarray, ...], tid: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of strings in cells that are neither dead nor settled, their hashes, and starts in settled cells.

        Of equal settled cells, the first one brings its strings, too, for others that have only a part of the cell.
        """
        hashes, tids, starts = known
        found = _in(self.union, hashes)
        settled = self.full & (found >= 0)
        first = settled & (tids[found] == tid) & (starts[found] == start + self.core_at - CELL + 1) if len(hashes) else settled
        open_ = (_in(self.core, hashes) >= 0) & ~settled | first
        spread = lambda cells: (self.core_at[cells][:, None] - np.arange(CELL)).ravel()
        at = spread(open_)
        at = at[(at >= 0) & (at < self.count)]
        return at, range_hash(self.sums, at, at + self.length).view(np.int64), spread(settled)


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each value stands in the sorted ``known``; -1 if it doesn't."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _twice(near: DataFrame, hashes) -> DataFrame:
    """``(w, tid, start)``: hashes that stand at more than one place, and the first one; each batch counts its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [(*hashes(d, far, k, s), k, s) for k, s, far, d in zip(*(b.column(c).to_pylist() for c in ("tid", "start", "far", "bytes")), strict=True)]
            w = np.concatenate([x[0] for x in parts]) if parts else np.zeros(0, np.int64)
            at = np.concatenate([x[1] + x[3] for x in parts]) if parts else np.zeros(0, np.int64)
            tid = np.repeat(np.array([x[2] for x in parts], np.int64), [len(x[0]) for x in parts])
            order = np.lexsort((at, tid, w))
            w, tid, at = w[order], tid[order], at[order]
            new = np.ones(len(w), bool)
            new[1:] = w[1:] != w[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(w)) - 1 if len(w) else first
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w[first], tid[first], at[first], tid[last], at[last])], ["w", "t1", "s1", "t2", "s2"])

    counted = near.mapInArrow(count, "w long, t1 long, s1 long, t2 long, s2 long")
    ends = counted.groupBy("w").agg(F.min(F.struct("t1", "s1")).alias("a"), F.max(F.struct("t2", "s2")).alias("b"))
    return checkpointed(ends.where("a.t1 <> b.t2 OR a.s1 <> b.s2").select("w", F.col("a.t1").alias("tid"), F.col("a.s1").alias("start")))


def _hot_spans(near: DataFrame, o: RepeatOptions) -> DataFrame:
    """Strings of anchors with very many surroundings, by hash: cells of strings first, then those of open cells.

    Repeated hashes go to all tasks while they are few enough; beyond that, single strings are joined with them.
    """
    length, near = o.length, near.select("tid", "start", "far", "bytes")

    def whole(d: bytes, *_) -> tuple[np.ndarray, np.ndarray]:
        hashes = window_hash(prefix_sums(np.frombuffer(d, np.uint8)), length).view(np.int64)
        return hashes, np.arange(len(hashes))

    def shared(twice: DataFrame):
        rows = np.array(sorted(map(tuple, twice.toLocalIterator())), np.int64).reshape(-1, 3)
        return near.sparkSession.sparkContext.broadcast(tuple(np.ascontiguousarray(c) for c in rows.T))

    cells = _twice(near, lambda d, far, *_: _Strings(d, far, length).first())
    strings = None
    if cells.count() <= o.broadcast_strings:
        known = shared(cells)
        strings = _twice(near, lambda d, far, k, s: _Strings(d, far, length).opened(known.value, k, s)[1::-1])
    if strings is None or strings.count() > o.broadcast_strings:
        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                parts = [(*whole(d), k, s) for k, s, d in zip(*(b.column(c).to_pylist() for c in ("tid", "start", "bytes")), strict=True)]
                if parts:
                    w, at = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] + x[3] for x in parts])
                    tid = np.repeat(np.array([x[2] for x in parts], np.int64), [len(x[0]) for x in parts])
                    yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(tid), pa.array(at)], ["w", "tid", "start"])

        rows = near.mapInArrow(spread, "w long, tid long, start long")
        return rows.join(_twice(near, whole).select("w"), "w", "left_semi").select("tid", "start", (F.col("start") + length).alias("end"))
    single = shared(strings)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [])
            for k, s, far, d in zip(*(b.column(c).to_pylist() for c in ("tid", "start", "far", "bytes")), strict=True):
                at, w, settled = _Strings(d, far, length).opened(known.value, k, s)
                yes = np.unique(np.concatenate((at[_in(w, single.value[0]) >= 0], settled)))
                if len(yes):  # strings that start within a length of each other cover one run
                    cut = np.flatnonzero(np.diff(yes) > length)
                    for x, y in zip(yes[np.append(0, cut + 1)].tolist(), yes[np.append(cut, len(yes) - 1)].tolist(), strict=True):
                        for column, v in zip(out, (k, s + x, s + y + length), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["tid", "start", "end"])

    return near.mapInArrow(mark, "tid long, start long, end long")


def repeats(docs: DataFrame, o: RepeatOptions = RepeatOptions()) -> DataFrame:
    """``(tid, spans)`` for every text of ``(tid, text)`` of which some bytes repeat: maximal runs, in order."""
    # hashes of surroundings first, so that the order also serves the wider window
    by_c, by_h = Window.partitionBy("h", "c"), Window.partitionBy("h")
    anchor = F.col("end") == 0
    a = _unpack(docs, o).withColumn("same", F.sum("weight").over(by_c)).withColumn("one", F.row_number().over(by_c.orderBy("tid", "place")) == 1)
    a = a.withColumn("all", F.sum("weight").over(by_h)).where(~anchor | (F.col("all") > 1))
    a = a.withColumn("open", F.count_if(F.col("same") == 1).over(by_h)).withColumn("kinds", F.count_if("one").over(by_h))
    q = F.shiftright("place", 20)
    start, last = q - F.shiftright("place", 10).bitwiseAND(F.lit(1023)), q - F.col("place").bitwiseAND(F.lit(1023))
    a = checkpointed(a.select("h", "tid", "place", "end", start.alias("start"), last.alias("last"), (q - start).alias("far"), "halves", "same", "one", "open", "kinds"))

    settled = a.where(anchor & (F.col("same") > 1)).select("tid", "start", (F.col("last") + o.length).alias("end")).unionByName(a.where(~anchor).select("tid", F.col("place").alias("start"), "end"))
    ask = a.where(anchor).where("(same = 1 OR one) AND open > 0 AND kinds > 1")
    before, after = F.shiftright("halves", 32), F.col("halves").bitwiseAND(F.lit((1 << 32) - 1))
    ask = ask.withColumn("before", F.xxhash64("h", F.lit("before"), before)).withColumn("after", F.xxhash64("h", F.lit("after"), after))
    ask = ask.withColumn("nb", F.count(F.lit(1)).over(Window.partitionBy("h", "before"))).withColumn("na", F.count(F.lit(1)).over(Window.partitionBy("h", "after")))
    ask = ask.where("nb > 1 OR na > 1").withColumn("kinds", F.count(F.lit(1)).over(by_h))
    few = F.col("kinds") <= o.hot
    fits = lambda c, n: F.when(F.col(n).between(2, o.hot), F.col(c)).otherwise(0)
    # two anchors that match share a half: its bucket, or the count of strings if that half has too many
    hot = (~few & (F.greatest("nb", "na") > o.hot)).cast("long")
    a_, b_ = F.when(few, F.col("h")).otherwise(fits("before", "nb")), F.when(few, 0).otherwise(fits("after", "na"))
    packed = F.shiftleft("start", 20) + F.shiftleft("far", 10) + F.col("last") - F.col("start")
    mark = F.struct(packed.alias("place"), a_.alias("a"), b_.alias("b"), hot.alias("hot"))
    marks = checkpointed(ask.groupBy("tid").agg(F.collect_list(mark).alias("marks")))  # as many as the text has anchors
    near = checkpointed(_surroundings(docs.join(marks, "tid"), o))
    total = near.where("NOT hot").agg(F.sum(F.length("bytes"))).first()[0] or 0
    found = settled
    if total:
        found = found.unionByName(_block_spans(near.where("NOT hot"), 1 + total // o.block_bytes, o))
    if not near.where("hot").isEmpty():
        found = found.unionByName(_hot_spans(near.where("hot"), o))

    order = Window.partitionBy("tid").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("tid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: RepeatOptions = RepeatOptions(), with_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for each row; ``with_text`` adds the bytes that are kept.

    A null text counts as empty. Texts shorter than ``length`` bytes keep everything; equal texts that aren't shorter
    lose everything, repeated rows included. Null ids stay null; an empty table gives an empty result; other columns are
    not read. Texts are told apart as by a hash of 128 bits, and matches never cross their ends.
    """
    o = options
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    other = F.xxhash64(F.lit("other"), "text")
    texts = lambda salt: slim.groupBy(F.xxhash64(F.lit(salt), "text").alias("tid"), other.alias("other")).agg(F.count(F.lit(1)).alias("n"))
    counts, salt = told_apart(texts, "tid", "other")
    slim = slim.withColumn("tid", F.xxhash64(F.lit(salt), "text"))
    copied = counts.where("n > 1").select("tid", F.lit(True).alias("copied"))
    known = checkpointed(repeats(slim.select("tid", "text"), o).join(copied, "tid", "full"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = []
            for t, spans, copied in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "copied")), strict=True):
                d = t.encode("utf-8", "surrogatepass")
                cut = [(0, len(d))] if copied and len(d) >= o.length else [(s["start"], s["end"]) for s in spans or ()]
                kept = b"".join(d[e:s] for e, s in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(d)], strict=True))
                rows.append((len(d), len(d) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True))
            arrays = [b.column("id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())] + [pa.array(columns[4], pa.binary())] * with_text
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    joined = slim.join(known, "tid", "left").select("id", "text", "spans", "copied")
    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text).withColumnRenamed("id", id_col)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


#: A hash of the string at every byte: for small tables.
SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d
), p AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(n - 199)) AS i FROM n WHERE n >= 200)
), q AS (SELECT doc_id, i FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)
), o AS (SELECT doc_id, i, coalesce(i > 200 + lag(i) OVER (PARTITION BY doc_id ORDER BY i), true) AS first FROM q
), g AS (SELECT doc_id, i, sum(first::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM o
), s AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, run
), u AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM s GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, n_spans + 2), lambda k: substr(h, 2 * CASE WHEN k = 1 THEN 0 ELSE b[k - 1] END + 1, 2 * (CASE WHEN k > n_spans THEN n ELSE a[k] END - CASE WHEN k = 1 THEN 0 ELSE b[k - 1] END))), '') END)) AS kept_sha256
FROM n LEFT JOIN u USING (doc_id)
"""
