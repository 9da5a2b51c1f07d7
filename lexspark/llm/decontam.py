"""Benchmark decontamination: a prefix-filtered set join of item-sized windows with whole documents.

A benchmark window occurs in a document only if each of its word shingles does. So its necessary prefix is one shingle,
and the rarest of them over all documents makes the fewest candidates:

1. count, in all documents, the shingles that the benchmark has;
2. order the shingles of each window by rarity; a window with a shingle that no document has is settled;
3. join documents with the rarest shingles; position and length bounds tell where a window would have to lie;
4. compare the words there, which is exact.

Style: DataFrame functions only. With the windows broadcast (only below a bound that is checked), explosion, join and
comparison run inside one generated stage, so no exploded word is ever shuffled. Above the bound the shingles are
shuffled instead and the candidates join their documents again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, named, table, unused

WINDOW = 13
SHINGLE = 3
#: Benchmark windows, counted once for each item that has them, that may be broadcast; at some 300 bytes each, about 60 MB.
BROADCAST_WINDOWS = 200_000
#: Words of a text whose candidates are gathered together beyond that.
PART = 2048

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none for null."""
    text = F.coalesce(text, F.lit(""))
    # lower() does the same as translate() where all is ASCII, and faster
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def _key(words: Column, at: Column, size: int, first: Column | None = None) -> Column:
    rest = [F.get(words, at + i) for i in range(size)]
    return F.xxhash64(*([first, *rest[1:]] if first is not None else rest))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``(item, wid, words, len)``: all windows of every item; a shorter item is one window."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i + 1, window))).alias("words"))
    return cut.select("item", F.sha2(F.array_join("words", " "), 256).alias("wid"), "words", F.size("words").alias("len")).distinct()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for each row.

    Null texts and items have no words; an item without id hits words but is not named among the items. A null id is an
    id like any other, and rows that share an id are told apart by their texts. Empty tables give empty or untouched
    results. Texts are taken whole.
    """
    found = _figures(docs, benchmark, id_col, text_col, item_col, item_text_col, window, shingle, broadcast_windows).alias("f")
    each = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tid")).alias("d")
    out = each.join(found, F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.tid") == F.col("f.tid")))
    return out.select(F.col("d.id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _figures(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, shingle: int, broadcast_windows: int) -> DataFrame:
    """``(id, tid, ...)`` for each id and text, of which ``tid`` is the hash; rows that repeat both come out once."""
    wins = checkpointed(benchmark_windows(benchmark, item_col, item_text_col, window))
    distinct = wins.dropDuplicates(["wid"]).select("wid", "words", "len")
    n = wins.count()
    small = n <= broadcast_windows
    hint = F.broadcast if small else (lambda x: x)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    split = texts.select("id", F.xxhash64("text").alias("tid"), words_of(F.col("text")).alias("doc"))
    spread = split.select("id", "tid", "doc", F.posexplode_outer("doc").alias("pos", "word"))

    sizes = [k for k in (shingle, 1) if n and distinct.where((F.col("len") >= k) if k == shingle else (F.col("len") < shingle)).limit(1).count()]
    found = []
    for k in sizes:
        own = distinct.where((F.col("len") >= k) if k == shingle else (F.col("len") < shingle))
        parts = own.select("wid", "words", "len", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("len") - k), lambda i: i)).alias("offset", "_"))
        parts = parts.select("wid", "words", "len", "offset", _key(F.col("words"), F.col("offset"), k).alias("key"))
        there = spread.select(_key(F.col("doc"), F.col("pos"), k, F.col("word")).alias("key")) if k > 1 else spread.select(F.xxhash64("word").alias("key"))
        counts = there.join(hint(parts.select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("rarity"))
        ranked = parts.join(counts, "key", "left").groupBy("wid").agg(
            F.min(F.when(F.col("rarity").isNotNull(), F.struct("rarity", "offset", "key"))).alias("rare"), F.count(F.lit(1)).alias("all"), F.count("rarity").alias("known"),
        )
        prefix = ranked.where(F.col("all") == F.col("known")).select("wid", "rare.offset", "rare.key").join(own, "wid")
        found.append((k, checkpointed(prefix.select("key", "offset", "wid", "words", "len"))))

    hits = [_matches(spread, split, prefix, k, small, first=i == 0) for i, (k, prefix) in enumerate(found)]
    if not hits:
        hits = [split.select("id", "tid", F.size("doc").alias("n_words"), *(F.lit(None).cast(t).alias(c) for c, t in (("wid", "string"), ("start", "int"), ("len", "int"))))]
    rows = checkpointed(reduce(DataFrame.unionByName, hits))  # two aggregates read it; the texts are split once for both

    # equal rows fall together before the shuffle, and what is left of a text is bounded by its own length
    spans = F.sort_array(F.collect_set(F.when(F.col("wid").isNotNull(), F.struct("start", "len"))))
    covered = rows.groupBy("id", "tid").agg(F.max("n_words").cast("long").alias("n_words"), spans.alias("spans")).select("id", "tid", "n_words", _covered(F.col("spans")).alias("n_hit"))
    # an item counts once for a document; the list is no longer than the benchmark
    items = rows.where(F.col("wid").isNotNull()).select("id", "tid", "wid").distinct().join(hint(wins.select("wid", "item")), "wid")
    items = items.groupBy("id", "tid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = covered.alias("c").join(items.alias("n"), F.col("c.id").eqNullSafe(F.col("n.id")) & (F.col("c.tid") == F.col("n.tid")), "left")
    items = F.coalesce(F.col("n.items"), F.array().cast("array<string>"))
    return both.select(
        "c.id", "c.tid", "c.n_words", "c.n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((F.col("c.n_hit") > 0) & (20 * F.col("c.n_hit") >= F.col("c.n_words"))).alias("contaminated"),
    )


def _covered(spans: Column) -> Column:
    """Words under at least one of the sorted spans ``(start, len)``."""

    def step(a: Column, x: Column) -> Column:
        end = x["start"] + x["len"]
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(x["start"], a["end"]))).alias("n"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"].cast("long"))


def _matches(spread: DataFrame, split: DataFrame, prefix: DataFrame, k: int, small: bool, first: bool) -> DataFrame:
    """Verified occurrences; the first call also returns a row for each document, with or without one."""
    key = _key(F.col("doc"), F.col("pos"), k, F.col("word")) if k > 1 else F.xxhash64("word")
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("len") <= F.size("doc"))
    same = F.slice("doc", F.greatest(start + 1, F.lit(1)), F.col("len")) == F.col("words")
    columns = ["id", "tid", F.size("doc").alias("n_words"), "wid", start.alias("start"), "len"]
    if small:
        keyed = spread.withColumn("k", key)
        joined = keyed.join(F.broadcast(prefix), (F.col("k") == F.col("key")) & inside & same, "left" if first else "inner")
        return joined.where(F.col("wid").isNotNull() | (F.coalesce(F.col("pos"), F.lit(0)) == 0)).select(*columns)
    # candidates are places and windows' hashes, gathered by parts of a text, so that a text is copied once for each part
    # and never for a candidate; what stands there is hashed and compared
    near = spread.select("id", "tid", "pos", key.alias("key")).join(prefix.select("key", "offset", "wid", "len"), "key").withColumn("start", start).where("start >= 0")
    near = near.groupBy("id", "tid", F.floor(F.col("start") / PART).alias("part")).agg(F.collect_set(F.struct("start", "len", "wid")).alias("at")).alias("x")
    whole = split.alias("s").join(near, F.col("s.id").eqNullSafe(F.col("x.id")) & (F.col("s.tid") == F.col("x.tid")))
    there = lambda c: F.sha2(F.array_join(F.slice("doc", c["start"] + 1, c["len"]), " "), 256) == c["wid"]
    true = F.filter("at", lambda c: (c["start"] + c["len"] <= F.size("doc")) & there(c))
    out = whole.select(F.col("s.id").alias("id"), F.col("s.tid").alias("tid"), F.size("doc").alias("n_words"), F.explode(true).alias("c")).select("id", "tid", "n_words", "c.wid", "c.start", "c.len")
    if first:
        blank = {"wid": "string", "start": "int", "len": "int"}
        out = out.unionByName(split.select("id", "tid", F.size("doc").alias("n_words"), *(F.lit(None).cast(t).alias(c) for c, t in blank.items())))
    return out


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_hit: int = 1) -> DataFrame:
    """The documents with fewer than ``min_hit`` words in benchmark windows, with all their columns.

    A corpus is cleaned by whole documents, so by default one verified window is enough: a passage of 13 words in a long
    text is as much a leak as in a short one. The share of the text that ``contaminated`` asks for isn't asked here.
    Each row goes or stays by its own id and text; null ids and repeated rows are rows like others. Empty tables leave
    the documents as they are, and columns may have any name.
    """
    found = _figures(docs, benchmark, id_col, text_col, "item_id", "text", WINDOW, SHINGLE, BROADCAST_WINDOWS)
    i, t = unused(docs, "bad_id", "bad_tid")
    bad = found.where(F.col("n_hit") >= min_hit).select(F.col("id").alias(i), F.col("tid").alias(t))
    return docs.join(bad, named(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(named(text_col)) == F.col(t)), "left_anti")


SQL = r"""
WITH doc AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents
), item AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, list_slice(ws, i + 1, least(i + 13, len(ws))) AS w
  FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 13, 0) + 1)) AS i FROM item WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT len(w) AS n FROM win
), hit AS (
  SELECT d.doc_id, d.i, s.n, w.item_id
  FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM doc) d, sizes s, win w
  WHERE d.i + s.n <= len(d.ws) AND w.w = list_slice(d.ws, d.i + 1, d.i + s.n)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
