"""Alignment of two tokenizers over the same texts, and how often their tokens are linked corpus-wide.

The ends of the tokens of either side are marked in packed bitsets over a text's bytes. Where both have a mark, they cut
alike; the number of marks up to such a cut tells how many tokens of a side end there. So the cuts make groups, each a
range of tokens on either side, and links are all pairs of both in a group.

Neither tokenizer joins what stands before a blank behind a letter or sign with what follows. So texts are cut there in
units, of which most come again and again; a task tokenizes and aligns each unit once and puts texts together from what it
remembers. Vocabularies of which that doesn't hold take texts whole.

A pair counts the documents that hold it linked. Each document's distinct pairs are written once, so that texts are
tokenized once; counts come from one aggregation with partial sums, and go back to the documents by a broadcast where
there are at most ``broadcast_pairs`` of them, else by a join.

Style: Arrow maps around numpy; counts and joins as DataFrames.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, scratch, slices, table

#: Fixed value: the pattern by which byte-level vocabularies cut texts before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank behind something else; Python counts more characters as white space than the tokenizers do, so it cuts less.
TOGETHER = 32
_CUT, _SPACED = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")


@dataclass(frozen=True)
class AlignOptions:
    folder: str = "/opt/tokenizers"
    first: str = "byte_bpe_50k.json"
    second: str = "piece_bpe_32k.model"
    broadcast_pairs: int = 2_000_000  # at 20 bytes each
    units: int = 400_000  # that a task remembers
    pairs: int = 6_000_000  # of these units
    group: int = 256  # pairs of a larger group are worked out from its distinct tokens
    chunk: int = 2_000_000  # links sorted at once


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable signs of Latin-1 stand for themselves, the other
    bytes take the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE from its JSON file; ``encode`` puts a blank before texts. Special tokens' strings are plain text."""

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *special]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = special[i] if i in special else bytes(letters[c] for c in token)
        before = spec.get("pre_tokenizer") or {}
        self.cuts_at_blanks = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ranks = [vocab[a + b] for a, b in merges]
        letters_first = {vocab.get(c) for c in letters} == set(range(256))
        if self.cuts_at_blanks and letters_first and ranks == list(range(256, 256 + len(ranks))) and not spec.get("normalizer") and not spec["model"].get("dropout"):
            import tiktoken  # merges in the order of their ids: the same tokens, several times faster

            own = {b: i for i, b in enumerate(self.token_bytes) if i not in special}
            encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own, special_tokens={}).encode_ordinary
            self.encode = lambda texts, _: [encode(" " + t) for t in texts]
        else:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            t = Tokenizer.from_str(data.decode())
            t.encode_special_tokens = True
            self.encode = lambda texts, _: [e.ids for e in t.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A vocabulary of pieces that puts a blank before a text. A part of a text that is empty is a lone blank."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.token_bytes = [bytes([int(n[3:5], 16)]) if p.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        # a lone blank: what it adds behind a letter, as the text that is left without its own blank is empty
        blank = p.encode("x ")[len(p.encode("x")) :]
        self._encode = p.encode
        self._blank = blank
        same = all(b"".join(self.token_bytes[i] for i in p.encode(t)) == f" {t}".encode() for t in ("a  b \n c ", " a\tb", "x "))
        self.cuts_at_blanks = same and not any(re.search("[^▁]▁", n) for n in names)

    def encode(self, texts: list[str], whole: bool) -> list[list[int]]:
        found = self._encode(texts, num_threads=1)
        return found if whole else [ids if t else self._blank for t, ids in zip(texts, found, strict=True)]


def _files(spark: SparkSession, o: AlignOptions) -> Broadcast:
    """Both vocabulary files, which hold a few MB, read by the driver."""
    read = [open(os.path.join(o.folder, name), "rb").read() for name in (o.first, o.second)]  # noqa: SIM115
    return spark.sparkContext.broadcast((hashlib.sha256(b"".join(read)).hexdigest(), *read))


@lru_cache(2)
def _opened(key: str, first: bytes, second: bytes) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(first), Pieces(second)


def _ranks(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set up to each place, itself included."""
    ones = np.bitwise_count(packed)
    before = np.concatenate(([0], np.cumsum(ones, dtype=np.int64)))
    byte, low = at >> 3, (np.uint16(2) << (at & 7).astype(np.uint16)) - np.uint16(1)
    return before[byte] + np.bitwise_count(packed[byte] & low.astype(np.uint8))


def groups(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the sizes in bytes of the tokens of both sides of ``n`` bytes: the places where both end, and how many tokens
    of either side end up to each."""
    packed = []
    for sizes in (a, b):
        marks = np.zeros(n, bool)
        marks[np.cumsum(sizes) - 1] = True
        packed.append(np.packbits(marks, bitorder="little"))
    cuts = np.flatnonzero(np.unpackbits(packed[0] & packed[1], count=n, bitorder="little"))
    return cuts, _ranks(packed[0], cuts), _ranks(packed[1], cuts)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _weighed(keys: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the weights of each, or how often it comes."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    if weights is None:
        return keys[first], np.diff(np.concatenate((first, [len(keys)])))
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


class Units:
    """Units that were tokenized and aligned, with their groups as text, their totals and their pairs."""

    def __init__(self, first: ByteLevel, second: Pieces, o: AlignOptions) -> None:
        self.first, self.second, self.o = first, second, o
        self.parts = first.cuts_at_blanks and second.cuts_at_blanks
        self.sizes = [np.array([len(t) for t in v.token_bytes], np.int64) for v in (first, second)]
        self.radix = len(second.token_bytes)
        signs = (",", "|", ";")
        self.names = [np.array([f"{i}{x}" for i in range(len(v.token_bytes)) for x in signs], object) for v in (first, second)]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.totals = np.zeros((0, 5), np.int64)  # good, tokens of both sides, groups, links
        self.offsets, self.keys, self.weights, self.uses = np.zeros(1, np.int64), *(np.zeros(0, np.int64) for _ in range(3))
        self.weighted = False

    def cut(self, text: str) -> list[str]:
        """The units of a text, each without the blank that it starts with."""
        if not self.parts:
            return [text]
        if text[0] == " " or _SPACED.search(text):
            return [u[1:] for u in _CUT.split(" " + text)]
        return text.split(" ")

    def _tokens(self, units: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The ids of both sides of all units that their bytes bring back, end to end; which these are, and their bytes.

        Units go to the tokenizers as one text, where they are cut again; those that white space ends go one by one, and
        so do all if any isn't brought back.
        """
        data = [(" " + u).encode("utf-8", "surrogatepass") for u in units]
        sizes, both = np.array([len(d) for d in data], np.int64), (self.first, self.second)
        loose = [i for i, u in enumerate(units) if not u or u[-1].isspace()] if self.parts else list(range(len(units)))
        good, alone = np.ones(len(units), bool), set(loose)
        rest = [i for i in range(len(units)) if i not in alone] if loose else list(range(len(units)))
        # texts of some units: one of all would be slow, and so would be one for each
        some = [" ".join([units[i] for i in rest[k : k + TOGETHER]]) for k in range(0, len(rest), TOGETHER)]
        flat = [list(chain.from_iterable(v.encode(some, True))) for v in both]
        joined = b"".join([data[i] for i in rest])
        if any(b"".join(map(v.token_bytes.__getitem__, ids)) != joined for v, ids in zip(both, flat, strict=True)):
            loose, rest, flat = list(range(len(units))), [], [[], []]
        if loose:
            found = [v.encode([units[i] for i in loose], not self.parts) for v in both]
            for k, i in enumerate(loose):
                good[i] = all(b"".join(map(v.token_bytes.__getitem__, ids[k])) == data[i] for v, ids in zip(both, found, strict=True))
                if good[i]:
                    for f, ids in zip(flat, found, strict=True):
                        f.extend(ids[k])
        kept = np.array([i for i in rest + loose if good[i]], np.int64)
        return [np.array(f, np.int64) for f in flat], kept, sizes[kept]

    def learn(self, units: list[str]) -> None:
        """Adds units that aren't known."""
        flat, kept, sizes = self._tokens(units)
        n = int(sizes.sum())
        cuts, *ends = groups(self.sizes[0][flat[0]], self.sizes[1][flat[1]], n) if n else (np.zeros(0, np.int64),) * 3
        starts = [np.concatenate(([0], e[:-1])) if len(e) else e for e in ends]
        na, nb = (e - s for e, s in zip(ends, starts, strict=True))
        upto = np.searchsorted(cuts, np.cumsum(sizes))  # groups up to the end of each unit
        owner = np.repeat(np.arange(len(kept)), np.diff(np.concatenate(([0], upto))))

        # each token as text with the sign behind it, in the order in which groups are shown
        pieces = np.empty(len(flat[0]) + len(flat[1]), object)
        for names, ids, many, end, before, last in ((self.names[0], flat[0], na, ends[0], starts[1], 1), (self.names[1], flat[1], nb, ends[1], ends[0], 2)):
            sign = np.zeros(len(ids), np.int64)
            sign[end - 1] = last
            pieces[np.arange(len(ids)) + np.repeat(before, many)] = names[ids * 3 + sign]
        pieces = pieces.tolist()
        self.texts += [""] * len(units)
        base, done = len(self.index), 0
        for i, g in zip(kept.tolist(), (ends[0] + ends[1])[upto - 1].tolist() if n else [], strict=True):
            self.texts[base + i] = "".join(pieces[done:g])
            done = g

        totals = np.zeros((len(units), 5), np.int64)
        totals[kept, 0] = 1
        for column, values in ((1, na), (2, nb), (3, np.ones(len(na), np.int64)), (4, na * nb)):
            np.add.at(totals[:, column], kept[owner], values)
        small = np.flatnonzero(na * nb <= self.o.group)
        k = _spread(np.zeros(len(small), np.int64), (na * nb)[small])
        at = np.repeat(small, (na * nb)[small])
        keys = flat[0][starts[0][at] + k // nb[at]] * self.radix + flat[1][starts[1][at] + k % nb[at]]
        where, weights = kept[owner[at]], np.ones(len(keys), np.int64)
        for g in np.flatnonzero(na * nb > self.o.group).tolist():
            self.weighted = True
            (x, cx), (y, cy) = (_weighed(f[s[g] : e[g]], None) for f, s, e in zip(flat, starts, ends, strict=True))
            keys = np.concatenate((keys, (x[:, None] * self.radix + y).ravel()))
            weights = np.concatenate((weights, (cx[:, None] * cy).ravel()))
            where = np.concatenate((where, np.full(len(x) * len(y), kept[owner[g]])))
        order = np.argsort(where, kind="stable")
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(np.bincount(where, minlength=len(units)))))
        self.keys, self.weights = np.concatenate((self.keys, keys[order])), np.concatenate((self.weights, weights[order]))
        self.totals, self.uses = np.concatenate((self.totals, totals)), np.concatenate((self.uses, np.zeros(len(units), np.int64)))
        for u in units:
            self.index[u] = len(self.index)

    def forget(self) -> None:
        """Leaves the units that were met more than once, if these are at most half as many as may be known."""
        known, keep = list(self.index), np.flatnonzero(self.uses > 1)
        sizes = (self.offsets[1:] - self.offsets[:-1])[keep]
        if len(keep) > self.o.units // 2 or sizes.sum() > self.o.pairs // 2:
            self.clear()
            return
        at = _spread(self.offsets[keep], sizes)
        self.index = {known[i]: k for k, i in enumerate(keep.tolist())}
        self.texts = [self.texts[i] for i in keep.tolist()]
        self.totals, self.uses = self.totals[keep], np.zeros(len(keep), np.int64)
        self.keys, self.weights = self.keys[at], self.weights[at]
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Totals and groups of each text, and its distinct pairs, with how many of them each text has."""
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.index) > self.o.units or len(self.keys) > self.o.pairs:
            self.forget()
        parts = list(chain.from_iterable(cut))
        flat = np.fromiter(map(self.index.get, parts, repeat(-1)), np.int64, len(parts))
        if len(missing := np.flatnonzero(flat < 0)):
            new = [parts[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(new)))
            flat[missing] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        many = np.array([len(x) for x in cut], np.int64)
        ends = np.cumsum(many)
        lines = list(map(self.texts.__getitem__, flat.tolist()))
        shown = ["".join(lines[b - n : b])[:-1] for b, n in zip(ends.tolist(), many.tolist(), strict=True)]
        self.uses += np.bincount(flat, minlength=len(self.uses))
        doc = np.repeat(np.arange(len(texts)), many)
        sums = np.concatenate((np.zeros((1, 5), np.int64), np.cumsum(self.totals[flat], axis=0)))
        totals = sums[ends] - sums[ends - many]
        good = (totals[:, 0] == many) & (many > 0)
        totals[~good] = 0
        doc, flat = doc[good[doc]], flat[good[doc]]
        start, size = self.offsets[flat], self.offsets[flat + 1] - self.offsets[flat]
        upto, sorted_, i = np.cumsum(size), [], 0
        while i < len(flat):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + self.o.chunk, "right")))
            at = _spread(start[i:j], size[i:j])
            own = np.repeat(doc[i:j], size[i:j]) * (len(self.first.token_bytes) * self.radix) + self.keys[at]
            sorted_.append(_weighed(own, self.weights[at] if self.weighted else None))
            i = j
        keys, times = (np.concatenate(x) for x in zip(*sorted_)) if sorted_ else (np.zeros(0, np.int64),) * 2
        if len(sorted_) > 1:
            keys, times = _weighed(keys, times)
        of, keys = np.divmod(keys, len(self.first.token_bytes) * self.radix)
        return totals, [s if g else "" for s, g in zip(shown, good, strict=True)], keys, times, np.bincount(of, minlength=len(texts))


_ROW = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: AlignOptions = AlignOptions(), digest: bool = False) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, groups, pairs, times)`` for each row.

    ``groups`` lists the ids of each group in order, as ``a1,a2|b1;a3|b2,b3``, or the SHA-256 of that; ``pairs`` are the
    distinct linked pairs as first id times the size of the second vocabulary plus second id, ``times`` their links.
    """
    files = _files(docs.sparkSession, options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(*_opened(*files.value), options)
        for b in slices(batches, "text", 1_000_000):
            totals, shown, keys, times, many = units.documents(b.column("text").to_pylist())
            if digest:
                shown = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]
            offsets = pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (keys, times)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(totals[:, i]) for i in range(1, 5)), pa.array(shown, pa.string()), *lists], ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    slim = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, {_ROW}")


def pair_counts(aligned: DataFrame, second_size: int) -> DataFrame:
    """``(pair, docs, best)``: the documents that hold a pair linked, and whether no pair of its first id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    first = F.expr(f"pair div {second_size}")
    most = counts.groupBy(first.alias("a")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", first).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def token_alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: AlignOptions = AlignOptions()) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for each row.

    Texts that are null, empty, or not brought back by the tokens' bytes have no tokens: zeros and an empty digest. Repeated
    rows, and rows with one id, count as documents of their own. An empty table gives an empty result; other columns are
    not read, whatever their names. Texts are taken whole; a task holds the distinct pairs of some documents.
    """
    spark = docs.sparkSession
    second = len(_opened(*_files(spark, options).value)[1].token_bytes)
    place = scratch(spark, "aligned")
    rows = alignments(docs, id_col, text_col, options, digest=True).withColumn("row", F.monotonically_increasing_id())
    rows.write.option("compression", "zstd").parquet(place)
    rows = spark.read.parquet(place)
    counts = scratch(spark, "pairs")
    pair_counts(rows, second).write.parquet(counts)
    known = spark.read.parquet(counts)
    if known.count() <= options.broadcast_pairs:
        t = known.orderBy("pair").toArrow()
        shared = spark.sparkContext.broadcast(tuple(t.column(c).to_numpy() for c in ("pair", "docs", "best")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, docs_, best = shared.value
            for b in batches:
                lists, times = b.column("pairs"), b.column("times").flatten().to_numpy()
                at = np.searchsorted(pair, lists.flatten().to_numpy())
                cut = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                sums = []
                for x in (times * best[at], times * docs_[at]) if len(at) else (np.zeros(0, np.int64),) * 2:
                    upto = np.concatenate(([0], np.cumsum(x)))
                    sums.append(pa.array(upto[cut[1:]] - upto[cut[:-1]], pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + sums, [*kept, "n_best", "count_sum"])

        kept = ["id", "n_a", "n_b", "n_groups", "n_links", "groups"]
        kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
        out = rows.mapInArrow(run, f"{kind}, n_best long, count_sum long")
    else:
        each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
        sums = each.join(known, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        out = rows.join(sums, "row", "left").select("id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"))
