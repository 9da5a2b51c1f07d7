"""Spelling: membership, misspellings, run-on words, and ranked suggestions under a bounded distance.

Suggestions are a similarity join. Two words within d edits share a string that is left after at most d deletions from
each, so an equi-join on these neighbourhoods proposes pairs and the exact distance decides. As they grow with the d-th
power of the length, more than two edits go by pieces of words instead. Nothing is crossed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from functools import reduce
from math import comb
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import words as W
from ..functions.distance import Rules, choices, deletions, distance, distances, probing_keys, rewritten, stored_keys, variants
from ..sources.store import checkpointed, release, remove, scratch, written
from .lexicon import Lexicon, frequencies, to_bytes

#: Longest probe, exclusive; most rewritten probes that are searched; shortest of these but for the first.
LONGEST, SEARCHED, SHORTEST = 120, 14, 4
CLASSES = 26
#: Keys that are met in one pass: so many, or so many for each word if that is more.
KEYS, KEYS_PER_WORD = 12_000_000, 6


def _marked(df: DataFrame, known: DataFrame, word: Column, name: str) -> DataFrame:
    """Adds whether ``word`` is known, as ``name``, which replaces a column of that name."""
    key, yes = "_lexspark_key", "_lexspark_yes"
    return df.withColumn(key, word).join(known.select(F.col("word").alias(key), F.lit(True).alias(yes)), key, "left").withColumn(name, F.coalesce(yes, F.lit(False))).drop(key, yes)


def with_membership(df: DataFrame, lexicon: Lexicon, column: str = "word") -> DataFrame:
    """Each row with ``in_dictionary``; null words, and words that the charset lacks, aren't."""
    return _marked(df, lexicon.words(), F.col(column), "in_dictionary")


def with_misspelled(df: DataFrame, lexicon: Lexicon, column: str = "word") -> DataFrame:
    """Each row with ``misspelled``, by the dictionary's options."""
    m, known = lexicon.metadata, lexicon.words()
    w = W.converted(F.col(column), m.input_conversion)
    out = _marked(df, known, w, "_lexspark_in")
    out = _marked(out, known, F.lower(w), "_lexspark_low") if m.convert_case else out.withColumn("_lexspark_low", F.lit(False))
    out = _marked(out, known, W.initial_uppercase(w), "_lexspark_first") if m.convert_case else out.withColumn("_lexspark_first", F.lit(False))
    return out.withColumn("misspelled", F.coalesce(W.checked(w, m, F.col("_lexspark_in"), F.col("_lexspark_low"), F.col("_lexspark_first")), F.lit(False))).drop("_lexspark_in", "_lexspark_low", "_lexspark_first")


def run_ons(words: DataFrame, lexicon: Lexicon, column: str = "word") -> DataFrame:
    """``(word, prefix, suffix, candidate)``: unknown words cut in two known ones, each cut a row.

    A half may also be known in lower case: the suffix if it is capitalised, the prefix if it starts with a capital.
    """
    known = lexicon.words()
    if not lexicon.metadata.runon_words:
        known = known.limit(0)
    probes = words.select(F.col(column).alias("word")).where(F.length("word") > 1).distinct().join(known, "word", "left_anti")
    cut = probes.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    cut = cut.select("word", F.substring("word", F.lit(1), F.col("at")).alias("prefix"), F.substring("word", F.col("at") + 1, F.length("word")).alias("suffix"))
    for half, lower in (("suffix", ~W.is_not_capitalized(F.col("suffix"))), ("prefix", F.col("prefix").rlike(r"^\p{Lu}"))):
        cut = _marked(cut, known, F.col(half), "_a")
        cut = _marked(cut, known, F.when(lower, F.lower(half)), "_b").where("_a OR _b").drop("_a", "_b")
    return cut.withColumn("candidate", F.concat("prefix", F.lit(" "), "suffix"))


#: Most rewritten forms of a probe whose keys are made one by one; others meet by their collapsed forms.
FORMS = 64


def _keyed(words: DataFrame, column: str, keys: Callable[[str], Iterable[str]]) -> DataFrame:
    """``(column, key)`` for each key of each word."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [sorted(keys(w)) for w in pdf[column]]
            yield pd.DataFrame({column: np.repeat(pdf[column].to_numpy(object), [len(k) for k in found]), "key": [k for x in found for k in x]})

    return words.select(column).mapInPandas(run, f"`{column}` string, key string")


def _knotty(rules: Rules) -> Column:
    """Whether short pairs rewrite a probe in many ways."""

    def ways(words: pd.Series) -> pd.Series:
        return words.map(lambda w: choices(w, rules.short) > FORMS)

    ways.__annotations__ = {"words": pd.Series, "return": pd.Series}
    return F.pandas_udf(ways, "boolean")("probe")


def _respelled(probes: DataFrame, rules: Rules) -> DataFrame:
    """``(probe, other)``: each probe with what short pairs make of it, itself as null; nothing for those with many."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(w, None if v == w else v) for w in pdf["probe"] if choices(w, rules.short) <= FORMS for v in variants(w, rules.short)]
            yield pd.DataFrame(rows, columns=["probe", "other"])

    return probes.mapInPandas(run, "probe string, other string")


def _met(probes: DataFrame, known: DataFrame, most: int, rules: Rules) -> DataFrame:
    """``(probe, word)``: pairs of which no similar one is missing.

    Both sides fold by their classes of equal characters. Up to two edits, keys are what is left after deletions; beyond,
    pieces, one of which the edits can't touch. A probe that short pairs rewrite in many ways meets by its collapsed form,
    whose pieces must survive twice the edits.
    """
    if most <= 2:
        own = stored = lambda w: deletions(w, most)
    else:
        own, stored = (lambda w: probing_keys(w, most)), (lambda w: stored_keys(w, most))
    form = lambda w: {k for v in variants(w, rules.short) for k in own(rules.folded(v))}
    few = probes
    if rules.short:
        marked = checkpointed(probes.select("probe", _knotty(rules).alias("knotty")))
        few, many = marked.where("NOT knotty"), marked.where("knotty")
    pairs = _keyed(few, "probe", form).join(_keyed(known, "word", lambda w: stored(rules.folded(w))), "key").select("probe", "word")
    if rules.short and not many.isEmpty():
        pairs = pairs.union(_met_collapsed(many, known, most, rules))
    return pairs.distinct()


def _met_collapsed(probes: DataFrame, known: DataFrame, most: int, rules: Rules) -> DataFrame:
    """The pairs of probes that short pairs rewrite in many ways, some of them several times."""
    left = _keyed(probes, "probe", lambda w: probing_keys(rules.collapsed(w), 2 * most))
    right = _keyed(known, "word", lambda w: stored_keys(rules.collapsed(w), 2 * most))
    return left.join(right, "key").select("probe", "word")


def _shorter(w: Column) -> Column:
    """The strings that are left after one deletion."""
    n = F.length(w)
    less = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)))
    return F.when(n > 0, less).otherwise(F.array().cast("array<string>"))


def _native_neighbours(words: DataFrame, column: str, most: int) -> DataFrame:
    """Each row with ``key``: hashes of the strings left after at most one deletion, or two. Two strings that share a hash
    by chance only propose a pair more."""
    keys = F.concat(F.array(F.col(column)), _shorter(F.col(column)))
    if most == 2:
        keys = F.flatten(F.transform(F.array_distinct(keys), lambda x: F.concat(F.array(x), _shorter(x))))
    return words.withColumn("key", F.explode(F.array_distinct(F.transform(keys, lambda x: F.xxhash64(x)))))


def _without(w: Column, most: int) -> Column:
    """The strings that are left after so many deletions, at most two; the empty one of words with fewer letters."""
    n = F.length(w)
    if most == 0:
        return F.array(w)
    if most == 1:
        return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)))
    cut = lambda i, j: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, j - i - 1), F.substring(w, j + 1, n))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.transform(F.sequence(i + 1, F.greatest(n, i + 1)), lambda j: cut(i, j))))


def _with_letters(words: DataFrame, name: str) -> DataFrame:
    """Each row with a bit for each letter of ``form``, by its number modulo 64: whether the letters are odd in number."""
    return words.withColumn(name, F.expr("aggregate(split(form, ''), 0L, (bits, c) -> bits ^ if(c = '', 0L, shiftleft(1L, ascii(c) % 64)))"))


def _translated(c: Column, rules: Rules) -> Column:
    """A column folded by classes of equal characters, of rules without diacritics."""
    return F.translate(c, "".join(rules.classes), "".join(rules.classes.values())) if rules.classes else c


def _swapped(p: Column, w: Column, rules: Rules = Rules()) -> Column:
    """Whether one swap of neighbours makes both equal; the two are the same letters, others may be equal by class."""
    n, letter = F.length(p), lambda c, i: F.substring(c, i, F.lit(1))
    turned = lambda i: F.concat(F.substring(p, F.lit(1), i - 1), letter(p, i + 1), letter(p, i), F.substring(p, i + 2, n))
    same = lambda i: _translated(turned(i), rules) == _translated(w, rules)
    fits = (lambda i: (letter(p, i) == letter(w, i + 1)) & (letter(p, i + 1) == letter(w, i)) & same(i)) if rules.classes else same
    return (n > 1) & (n == F.length(w)) & F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), fits)


def effective_distance(probe: Column, most: int) -> Column:
    """The distance that a search allows: ``most``, and of a probe no longer than that one less than its length."""
    n = F.length(probe)
    return F.when(n <= most, n - 1).otherwise(most)


def with_sizes(found: DataFrame, most: int) -> DataFrame:
    """Suggestions with what the search saw: ``word_length``, ``candidate_length`` and ``effective_distance``."""
    return found.select("*", F.length("probe").alias("word_length"), F.length("suggestion").alias("candidate_length"), effective_distance(F.col("probe"), most).alias("effective_distance"))


def _told(pairs: DataFrame, rules: Rules, keyed: Column | None = None, same: Column | None = None) -> DataFrame:
    """Pairs with their distance of up to two as ``known``, which has that without swaps, up to four; as null where a swap
    may stand beside another edit and where ``keyed`` holds; others are left out. ``same``: no swap alone if it is false."""
    p, w = (_translated(F.col(c), rules) for c in ("probe", "word"))
    keyed = F.lit(False) if keyed is None else keyed
    swap = (F.col("known") == 2) & (F.lit(True) if same is None else same) & _swapped(F.col("probe"), F.col("word"), rules)
    bag = lambda c: F.array_join(F.sort_array(F.split(c, "")), "")
    letters = F.levenshtein(bag(p), bag(w), 2)
    pairs = pairs.where(keyed | F.col("known").between(0, 2) | (F.col("known") == 3) & (letters >= 0) | (F.col("known") == 4) & (letters == 0))
    return pairs.withColumn("known", F.when(~keyed, F.when(swap, 1).when(F.col("known") <= 2, F.col("known"))))


def _distance(most: int, rules: Rules) -> Column:
    """The distance of ``probe`` and ``word``, by a Python function where ``known`` is null."""

    def far(a: pd.Series, b: pd.Series, known: pd.Series) -> pd.Series:
        out, x, y = known.fillna(0).to_numpy("int32", copy=True), a.to_numpy(), b.to_numpy()
        unknown = np.flatnonzero(known.isna())
        if rules.alike:
            out[unknown] = distances(x[unknown].tolist(), y[unknown].tolist(), rules, most)
            return pd.Series(out)
        for i in unknown:
            out[i] = distance(x[i], y[i], rules, max(0, len(x[i]) - 1) if len(x[i]) <= most else most)
        return pd.Series(out)

    far.__annotations__ = {"a": pd.Series, "b": pd.Series, "known": pd.Series, "return": pd.Series}
    unknown = [F.when(F.col("known").isNull(), F.col(c)) for c in ("probe", "word")]  # others needn't go to Python
    # else a filter by it would be moved before it, and work it out twice
    return F.pandas_udf(far, "int").asNondeterministic()(*unknown, "known")


def similar_pairs(probes: DataFrame, known: DataFrame, most: int, rules: Rules = Rules()) -> DataFrame:
    """``(probe, word, distance)`` for all pairs within ``most`` edits; of a probe no longer than that, one less.

    ``probes`` has a column probe, ``known`` a column word, both distinct. For one or two edits without
    diacritics the join, and the distance but for swaps beside another edit and for probes that short pairs rewrite, stay in built-in expressions; else keys and
    distances come from Python functions on batches. Equal characters and short pairs may be met in any number.
    """
    allowed = effective_distance(F.col("probe"), most)
    p, w = (_translated(F.col(c), rules) for c in ("probe", "word"))
    if replace(rules, short=()).alike and most in (1, 2):
        # words are few bytes for the work that they make, so tasks are not left to be dealt by bytes
        parts = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        form, keyed, many = p, F.lit(False), None
        if rules.short:  # they change nothing for probes without any of their keys
            keyed = reduce(or_, (F.contains("probe", F.lit(k)) for k, *_ in rules.short))
            probes = checkpointed(probes.select("probe"))
            many = probes.where(keyed).where(_knotty(rules))
            probes = probes.where(~keyed).withColumn("other", F.lit(None).cast("string")).unionByName(_respelled(probes.where(keyed), rules))
            form = _translated(F.coalesce("other", "probe"), rules)
        left, right = _with_letters(probes.withColumn("form", form).repartition(parts), "mine"), _with_letters(known.select("word", w.alias("form")).repartition(parts), "its")
        left, right = (_native_neighbours(side, "form", most).drop("form").repartition(parts, "key") for side in (left, right))
        # most pairs that share a key are too far apart, so they are left out before they are dealt out to be counted once;
        # those that swaps may bring nearer have the same letters but for one edit at most
        bits = F.bit_count(F.col("mine").bitwiseXOR(F.col("its")))
        pairs = left.join(right, "key").where((F.levenshtein(form, w, most) >= 0) | (bits <= 2 * (most - 1))).select("probe", "word")
        if many is not None and not many.isEmpty():
            pairs = pairs.union(_met_collapsed(many, known, most, rules))
        # a swap counts as two edits here, so one beside an edit as three and two as four; as it moves no letter in or
        # out, few such pairs are left to Python
        pairs = pairs.distinct().withColumn("known", F.levenshtein(p, w, 2 * most))
        if most == 2:
            pairs = _told(pairs, rules, keyed)
        else:
            swap = (F.col("known") == 2) & _swapped(F.col("probe"), F.col("word"), rules)
            pairs = pairs.withColumn("known", F.when(~keyed, F.when(F.col("known").between(0, 1), F.col("known")).when(swap, 1).otherwise(2)))
            if not rules.short:
                return pairs.withColumnRenamed("known", "distance").where(F.col("distance") <= allowed)
            pairs = pairs.where(keyed | (F.col("known") <= allowed))
    else:
        pairs = _met(probes, known, most, rules)
        if not (rules.short or rules.ignore_diacritics):
            pairs = pairs.where(F.levenshtein(p, w, 2 * most) >= 0)
        pairs = pairs.withColumn("known", F.lit(None).cast("int"))

    return pairs.select("probe", "word", _distance(most, rules).alias("distance")).where(F.col("distance") <= allowed)


def _passes(words: dict[int, int], most: int, longest: int) -> list[tuple[int, int, int]]:
    """``(least, largest, parts)``: lengths of keys that are met together, by the number of words of each length, and in how
    many parts those of a length are met of which there are too many."""
    limit, held, out = max(KEYS, KEYS_PER_WORD * sum(words.values())), 0, []
    for size in range(longest + 1):
        n = sum(comb(size + d, d) * words.get(size + d, 0) for d in range(most + 1))
        if out and held + n <= limit:
            held, out[-1] = held + n, (out[-1][0], size, 1)
        else:
            held = n
            out.append((size, size, max(1, -(-n // limit))))
    return out


def _met_in_pass(probes: DataFrame, known: DataFrame, most: int, rules: Rules, least: int, largest: int, part: int, parts: int) -> DataFrame:
    """``(probe, word, frequency, distance)``: the pairs that meet by keys of some lengths, some of them several times."""
    tasks = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keyed(words: DataFrame, bits: str) -> DataFrame:
        n, form = F.length("form"), F.col("form")
        words = _with_letters(words.where(n.between(least, largest + most)).repartition(tasks), bits)
        keys = [F.when(F.greatest(n - d, F.lit(0)).between(least, largest), _without(form, d)).otherwise(F.array().cast("array<string>")) for d in range(most + 1)]
        words = words.withColumn("key", F.explode(F.array_distinct(F.transform(F.concat(*keys), lambda x: F.xxhash64(x))))).drop("form")
        return words.where(F.pmod("key", F.lit(parts)) == part).repartition(tasks, "key")

    p, w = (_translated(F.col(c), rules) for c in ("probe", "word"))
    bits = F.bit_count(F.col("mine").bitwiseXOR(F.col("its")))
    size = F.greatest(F.length("probe"), F.length("word"), F.lit(most)) - most
    pairs = keyed(probes, "mine").join(keyed(known, "its").hint("merge"), "key").where(size.between(least, largest) & (F.col("probe") != F.col("word")))
    pairs = pairs.where((F.levenshtein(p, w, most) >= 0) | (bits <= 2 * (most - 1))).withColumn("known", F.levenshtein(p, w, 2 * most))
    pairs = _told(pairs, rules, same=bits == 0).select("probe", "word", "frequency", _distance(most, rules).alias("distance"))
    return pairs.where(F.col("distance") <= effective_distance(F.col("probe"), most))


def _ranked_in_passes(probes: DataFrame, known: DataFrame, most: int, rules: Rules, ranked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``ranked`` of ``(probe, word, frequency, distance)`` for all pairs within two edits, written.

    What two words share is sought among strings of one length only: that of the longer one less the edits. So keys are met
    by their lengths, and a probe's pairs are complete, and ranked, when keys as long as it are met. Shuffle files
    of a pass are deleted after it, so disk holds the keys of one, the pairs of probes of three lengths, and results.
    """
    spark = probes.sparkSession
    form = lambda c: _translated(F.col(c), rules).alias("form")
    probes, known = written(probes.select("probe", form("probe")), "probes"), written(known.select("word", "frequency", form("word")), "known")
    count = lambda df: {r[0]: r[1] for r in df.groupBy(F.length("form")).count().collect()}
    asked, held = count(probes), count(known)
    met, out, done = scratch(spark, "met"), scratch(spark, "suggestions"), -1
    passes = _passes({n: asked.get(n, 0) + held.get(n, 0) for n in asked | held}, most, max(asked, default=0))
    for least, largest, parts in passes:
        for part in range(parts):
            pairs = _met_in_pass(probes, known, most, rules, least, largest, part, parts).withColumn("size", F.length("probe"))
            pairs.sortWithinPartitions("size", "probe", "word").write.partitionBy("size").option("compression", "zstd").parquet(met, mode="append")
            if len(passes) > 1:
                release(spark)
        # dealt by probe once, to be told apart and to be ranked
        pairs = spark.read.schema("probe string, word string, frequency int, distance int, size int").parquet(met).where(F.col("size").between(done + 1, largest)).drop("size")
        pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "probe").distinct()
        ranked(pairs).write.option("compression", "zstd").parquet(out, mode="append")
        for n in range(done + 1, largest + 1):
            remove(spark, f"{met}/size={n}")
        done = largest
        if len(passes) > 1:
            release(spark)
    return spark.read.parquet(out)


def rewrites(words: DataFrame, rules: Rules, column: str = "word") -> DataFrame:
    """``(probe, place, form)``: the word, and its rewrites with long targets, in the order in which they are tried."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(w, i, f) for w in pdf["probe"] for i, f in enumerate(rewritten(w, rules.long) if len(w) > 1 else [w])]
            yield pd.DataFrame(rows, columns=["probe", "place", "form"])

    return words.select(F.col(column).alias("probe")).where("probe IS NOT NULL").distinct().mapInPandas(run, "probe string, place int, form string")


def _found_by_forms(probes: DataFrame, known: DataFrame, most: int, rules: Rules) -> DataFrame:
    """``(probe, place, word, distance)`` by the rewrites of probes with long targets, which may be known as they are."""
    forms = written(rewrites(probes, rules, "probe"), "forms")  # read three times
    low = F.lower("form")
    cased = F.array_distinct(F.array(F.col("form"), low, F.upper("form"), F.when(F.length(low) > 1, F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, F.lit(2), F.length(low))))))
    tried = forms.select("probe", "place", F.posexplode(cased).alias("case", "word"))
    free = tried.join(known, "word").withColumn("least", F.min("case").over(Window.partitionBy("probe", "place"))).where("case = 0 OR least > 0")
    free = free.select("probe", "place", "word", F.lit(0).alias("distance"))

    short = F.min(F.when((F.length("form") < SHORTEST) & (F.col("place") > 0), F.col("place"))).over(Window.partitionBy("probe"))
    searched = forms.where(F.col("place") < SEARCHED).withColumn("stop", short).where("stop IS NULL OR place < stop")
    near = similar_pairs(searched.select(F.col("form").alias("probe")).distinct(), known, most, rules).withColumnRenamed("probe", "form")
    return searched.hint("merge").join(near, "form").select("probe", "place", "word", "distance").unionByName(free)


def suggestions(words: DataFrame, lexicon: Lexicon, most: int = 1, column: str = "word", even_if_known: bool = False) -> DataFrame:
    """``(probe, suggestion, distance, score, rank)`` for the distinct words that aren't known, or for all.

    The score is 26 times the distance plus 25 less the frequency; of equal scores, the earlier rewrite comes
    first, and of one rewrite the word that a walk through the dictionary's automaton finds first. Words of 120 characters and more, and null or empty ones, get nothing.
    """
    m, rules = lexicon.metadata, Rules.of(lexicon.metadata)
    # read several times; its file is a tenth of what its words take in the driver's memory, so Spark, which goes by files,
    # would broadcast them at each join
    known = written(lexicon.words(), "words").hint("merge")
    probes = words.select(W.converted(F.col(column), m.input_conversion).alias("probe")).where((F.length("probe") > 0) & (F.length("probe") < LONGEST)).distinct()
    if not even_if_known:
        # an anti join would be moved before the distinct, where it meets all words of a text
        probes = _marked(probes, known, F.col("probe"), "known").where("NOT known").drop("known")
    # an automaton's arcs are walked in the order of their bytes, so that is the order in which it finds words
    found_at = F.col("word") if m.encoding.lower().replace("-", "") == "utf8" else to_bytes(F.col("word"), m.encoding)
    score = F.col("distance") * CLASSES + CLASSES - 1 - F.col("frequency")
    if most == 2 and rules.alike and not (rules.long or m.output_conversion):
        rank = F.row_number().over(Window.partitionBy("probe").orderBy("score", found_at))
        ranked = lambda pairs: pairs.withColumn("score", score).select("probe", F.col("word").alias("suggestion"), "distance", "score", rank.alias("rank"))
        return _ranked_in_passes(probes, frequencies(known, lexicon, "word"), most, rules, ranked)
    if rules.long:
        found = _found_by_forms(probes, known, most, rules)
    else:
        found = similar_pairs(probes, known, most, rules).withColumn("place", F.lit(0))

    out = found.withColumn("suggestion", W.converted(F.col("word"), m.output_conversion))
    out = frequencies(out.where("suggestion <> probe"), lexicon, "suggestion")
    own = frequencies(out.select("probe", "place", "word", "distance", "suggestion"), lexicon, "word") if m.output_conversion else out
    out = own.withColumn("score", score)
    if rules.long or m.output_conversion:  # else a pair is found once
        once = Window.partitionBy("probe", "suggestion").orderBy("score", "place", found_at)
        out = out.repartition("probe").withColumn("n", F.row_number().over(once)).where("n = 1")  # dealt once for both windows
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("score", "place", found_at))
    return out.select("probe", "suggestion", "distance", "score", rank.alias("rank"))
