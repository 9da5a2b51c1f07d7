"""Queries over the driver's tables and the SQL that checks them.

The dictionary is derived from the documents: words are the runs of letters, of any alphabet, in the lower-case text, a
stem is the word less one suffix, the tag is the language, and the frequency class comes from the number of bits of the
word's count. Every query reads its tables whole and takes all words of them. Automata are made of the words' bytes,
which are shown in hexadecimal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tools
from ..functions import words as W
from ..functions.encoders import BY_NAME
from ..functions.encoders import register as register_encoder
from ..operators import automaton, lexicon, speller
from ..operators.lexicon import Lexicon
from ..sources import formats, readers
from ..sources.datasource import FsaDataSource
from ..sources.metadata import Metadata, format_properties, read_metadata, write_metadata
from ..sources.store import checkpointed, numbered, scratch
from ..sql import register
from ..streaming import apply as streaming
from ..streaming import unknown

OPTIONS = Metadata("+", "suffix", "utf-8", ignore_diacritics=False)
FREQUENT = OPTIONS.with_(frequency_included=True)
FOLDING = OPTIONS.with_(ignore_diacritics=True, convert_case=True)
#: Rewrite pairs for the queries that use them.
PAIRS = OPTIONS.with_(replacement_pairs=(("ll", "l"), ("sm", "th"), ("ot", "ought"), ("g", "tion"), ("ed$", "anded")))
#: Letters that count as equal, in both directions.
ALIKE = FREQUENT.with_(equivalent_chars=tuple(p for a, b in ("ck", "vw", "iy", "sz") for p in ((a, b), (b, a))))
CONVERSIONS = (("th", "d"), ("ing", "in"), ("er", ""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:  # lets Python workers import the package where it isn't installed
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- inputs -------------------------------------------------------------------------------------------------------


def _stem(w: Column) -> Column:
    return F.regexp_replace(w, "(tion|ing|ed|er|en|es|ly|s)$", "")


def _tokens(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")


def counted(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(table(spark, d, "documents"), "lang").groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(table(spark, d, "documents")).select("word").distinct()


def derived(spark: SparkSession, d: str) -> Lexicon:
    rows = counted(spark, d).select(_stem(F.col("word")).alias("base"), F.col("word").alias("inflected"), F.col("lang").alias("tag"))
    return Lexicon.compile(rows, OPTIONS)


def frequent(spark: SparkSession, d: str, options: Metadata = FREQUENT) -> Lexicon:
    """A word list with a letter for the frequency class in place of a tag."""
    total = counted(spark, d).groupBy("word").agg(F.sum("n").alias("n"))
    level = F.least(F.length(F.bin("n")) - 1, F.lit(25))
    return Lexicon.compile(total.select(F.col("word").alias("base"), F.col("word").alias("inflected"), F.char(level + 65).alias("tag")), options)


def probes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of the conversations."""
    return _tokens(table(spark, d, "conversations")).select("word").distinct()


def raw_words(df: DataFrame) -> DataFrame:
    """Distinct runs of letters and digits, as they are written."""
    return df.select(F.explode(F.split("text", r"[^\p{L}\p{Nd}]+")).alias("word")).where("word <> ''").distinct()


def seqs(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary as bytes, written once, as most queries read it several times."""
    return checkpointed(automaton.sequences(vocabulary(spark, d), "word"))


def misspelled(spark: SparkSession, d: str) -> DataFrame:
    """Part names, and every word of the vocabulary less its fifth letter, or with its last one doubled if it has none."""
    names = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    w, n = F.col("word"), F.length("word")
    less = F.when(n >= 5, F.concat(F.substring(w, 1, 4), F.substring(w, F.lit(6), n))).otherwise(F.concat(w, F.substring(w, n, F.lit(1))))
    return names.union(vocabulary(spark, d).select(less)).distinct()


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Source and target forms that share a start, an end, a middle or little."""
    w, n = F.col("word"), F.length("word")
    target = (
        F.when(n % 4 == 0, _stem(w)).when(n % 4 == 1, F.concat(F.substring(w, F.lit(3), n), F.lit("e")))
        .when(n % 4 == 2, F.concat(F.substring(w, 1, 1), F.substring(w, F.lit(4), n))).otherwise(F.concat(F.lit("ge"), F.substring(w, F.lit(1), n - 2)))
    )
    return vocabulary(spark, d).select(w.alias("source"), target.alias("target"))


def shown(c: str) -> Column:
    return F.hex(c).alias(c)


# --- queries ------------------------------------------------------------------------------------------------------


def lex_scan(spark, d):
    return derived(spark, d).scan()


def _encode(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        code = BY_NAME[name].encode(F.col("source").cast("binary"), F.col("target").cast("binary"))
        return pairs(spark, d).select("source", "target", F.hex(code).alias("coded"))

    return query


def lex_roundtrip(spark, d):
    p = pairs(spark, d).select(F.col("source").cast("binary").alias("s"), F.col("target").cast("binary").alias("t"))
    wrong = [F.count_if(~e.decode(F.col("s"), e.encode(F.col("s"), F.col("t"))).eqNullSafe(F.col("t"))).alias(n) for n, e in BY_NAME.items()]
    return p.agg(F.count(F.lit(1)).alias("pairs"), *wrong)


def lookup_inner(spark, d):
    return lexicon.lookup(probes(spark, d), derived(spark, d))


def lookup_left(spark, d):
    return lexicon.lookup(probes(spark, d), derived(spark, d), how="left")


def lookup_not_found(spark, d):
    return lexicon.lookup(probes(spark, d), derived(spark, d), how="anti")


def synth_lookup(spark, d):
    asked = probes(spark, d).select(_stem(F.col("word")).alias("stem")).where("stem <> ''").distinct().select("stem", F.explode(F.array(F.lit("en"), F.lit("de"))).alias("tag"))
    return lexicon.synthesize(asked, derived(spark, d)).select("stem", "tag", "word")


def apply_lines(spark, d):
    return lexicon.applied(misspelled(spark, d).union(probes(spark, d)).distinct(), derived(spark, d))


def dict_decompile(spark, d):
    return derived(spark, d).decompile()


def dict_compile_validate(spark, d):
    lines = table(spark, d, "part").select(F.concat_ws("+", F.replace("p_name", F.lit(" "), F.lit("+")), "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_type"))).alias("line"))
    return lexicon.source_violations(lexicon.source_rows(lines, OPTIONS))


def dict_tag_inventory(spark, d):
    return derived(spark, d).entries.groupBy("tag").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("word").alias("words"))


def dict_unsafe(spark, d):
    """Source rows whose base or inflected form has the separator, among others that have none."""
    joined = lambda c, n: F.when(F.col("p_size") % n == 0, F.replace(c, F.lit(" "), F.lit("+"))).otherwise(F.col(c))
    rows = table(spark, d, "part").select(joined("p_name", 3).alias("base"), joined("p_type", 5).alias("inflected"), F.col("p_brand").alias("tag"))
    return lexicon.unsafe_rows(rows, OPTIONS)


def apply_conversions(spark, d):
    return probes(spark, d).select("word", W.converted(F.col("word"), CONVERSIONS).alias("converted"))


def fsa_arcs(spark, d):
    return automaton.tree_arcs(seqs(spark, d)).select(shown("prefix"), shown("label"), "is_final", "is_terminal")


def fsa_right_language(spark, d):
    return automaton.right_languages(seqs(spark, d)).select(shown("prefix"), "count")


def fsa_states(spark, d):
    return automaton.states(seqs(spark, d)).select(shown("name"), "count")


def fsa_stats(spark, d):
    return automaton.totals(seqs(spark, d))


def fsa_fanout(spark, d):
    return automaton.fan_outs(seqs(spark, d))


def fsa_label_hist(spark, d):
    return automaton.label_counts(seqs(spark, d)).select(shown("label"), "arcs")


def fsa_top_labels(spark, d):
    return automaton.top_labels(seqs(spark, d), 10).select(shown("label"), "arcs")


def fsa_inlinks(spark, d):
    return automaton.in_links(seqs(spark, d)).select(shown("state"), "in_links")


def fsa_perfect_hash(spark, d):
    return automaton.ranked(seqs(spark, d)).select(shown("seq"), "rank")


def match_probes(spark, d):
    """Words of the conversations, less their last byte, and with one more; and words that start like none."""
    w = F.col("word").cast("binary")
    forms = F.array(w, F.substring(w, F.lit(1), F.octet_length(w) - 1), F.concat(w, F.lit(b"x")), F.concat(F.lit(b"Q"), w))
    return probes(spark, d).select(F.explode(forms).alias("probe")).distinct()


def fsa_match_kind(spark, d):
    return automaton.matched(match_probes(spark, d), seqs(spark, d)).select(shown("probe"), "kind", "index")


def fsa_perfect_hash_probe(spark, d):
    return automaton.perfect_hash(match_probes(spark, d), seqs(spark, d)).select(shown("probe"), "hash")


def fsa_prefix_expand(spark, d):
    starts = probes(spark, d).select(F.substring(F.col("word").cast("binary"), 1, 5).alias("prefix")).distinct()
    return automaton.expanded(starts, seqs(spark, d)).select(shown("prefix"), shown("suffix"))


def _roundtrip(version: str):
    """The vocabulary written as a binary automaton by one task, and read again."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            data = formats.WRITERS[version]((s for b in batches for s in b.column("seq").to_pylist()), numbers=True)
            for block in formats.read(data).blocks():
                yield pa.RecordBatch.from_arrays([readers.block_array(block).cast(pa.string())], ["word"])

        return seqs(spark, d).coalesce(1).sortWithinPartitions("seq").mapInArrow(run, "word string")

    return query


def spell_predicates(spark, d):
    w = F.col("word")
    return raw_words(table(spark, d, "documents")).select(
        "word", W.is_alphabetic(w).alias("alphabetic"), W.contains_no_digit(w).alias("no_digit"), W.is_all_uppercase(w).alias("all_upper"), W.is_not_all_lowercase(w).alias("not_all_lower"),
        W.is_not_capitalized(w).alias("not_capitalized"), W.is_mixed_case(w).alias("mixed"), W.is_camel_case(w).alias("camel"), W.initial_uppercase(w).alias("initial_upper"),
    )


def spell_in_dict(spark, d):
    return speller.with_membership(probes(spark, d), derived(spark, d))


def spell_misspelled(spark, d):
    return speller.with_misspelled(raw_words(table(spark, d, "conversations")), derived(spark, d))


def spell_runon(spark, d):
    names = table(spark, d, "part").select("p_name")
    joined = F.replace("p_name", F.lit(" "), F.lit(""))
    asked = names.select(F.explode(F.array(joined, F.concat(F.upper(F.substring(joined, 1, 1)), F.substring(joined, F.lit(2), F.length(joined))))).alias("word"))
    known = names.select(F.explode(F.split("p_name", " ")).alias("base")).union(vocabulary(spark, d)).select("base", F.col("base").alias("inflected"), F.lit(None).cast("string").alias("tag"))
    return speller.run_ons(asked, Lexicon.compile(known, OPTIONS))


def spell_frequency(spark, d):
    return lexicon.frequencies(probes(spark, d), frequent(spark, d))


def spell_suggest_d1(spark, d):
    return speller.suggestions(misspelled(spark, d), frequent(spark, d))


def spell_similar_d1(spark, d):
    return speller.suggestions(vocabulary(spark, d), frequent(spark, d), even_if_known=True)


def spell_suggest_diacritics(spark, d):
    docs = table(spark, d, "documents")
    words = _tokens(docs).select(F.col("word").alias("base")).distinct()
    known = Lexicon.compile(words.select("base", F.col("base").alias("inflected"), F.lit(None).cast("string").alias("tag")), FOLDING)
    return speller.suggestions(probes(spark, d), known, most=0).select("probe", "suggestion", "distance")


def spell_suggest_equivalents(spark, d):
    """Misspelled words, and all words with each letter of a class as the other of its class, in any number."""
    respelled = vocabulary(spark, d).select(F.translate("word", "ckvwiysz", "kcwvyizs"))
    return speller.suggestions(misspelled(spark, d).union(respelled), frequent(spark, d, ALIKE))


def spell_suggest_d3(spark, d):
    """Words of part names, and these less their fifth letter, among all words within three edits."""
    w = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    less = w.where(F.length("word") >= 5).select(F.concat(F.substring("word", 1, 4), F.substring("word", F.lit(6), F.length("word"))))
    return speller.suggestions(w.union(less), frequent(spark, d), most=3)


def spell_suggest_d2(spark, d):
    return speller.suggestions(misspelled(spark, d), frequent(spark, d), most=2)


def spell_suggest_pairs(spark, d):
    return speller.suggestions(misspelled(spark, d), frequent(spark, d, PAIRS.with_(frequency_included=True)))


def spell_rewrites(spark, d):
    return speller.rewrites(misspelled(spark, d), speller.Rules.of(PAIRS))


def lex_parquet_roundtrip(spark, d):
    """The dictionary saved as Parquet and loaded again."""
    path = scratch(spark, "lexicon.parquet")
    derived(spark, d).save(path)
    return Lexicon.load(spark, path).scan()


def lookup_guards(spark, d):
    """Raw words of the documents, some with the separator, in a dictionary whose charset lacks many of their letters."""
    rows = counted(spark, d).select(_stem(F.col("word")).alias("base"), F.col("word").alias("inflected"), F.col("lang").alias("tag")).where(~F.col("inflected").rlike("[^\\x00-\\xFF]"))
    latin = Lexicon.compile(rows, OPTIONS.with_(encoding="iso8859-1", encoder="prefix"))
    w = raw_words(table(spark, d, "conversations"))
    asked = w.union(w.select(F.concat("word", F.lit("+"), "word"))).union(w.select(F.concat("word", F.lit("\u017c"))))
    return lexicon.lookup(asked, latin, how="left")


def fsa_hot_states(spark, d):
    return automaton.hot_states(seqs(spark, d)).select(shown("state"), "in_links")


def fsa_visits(spark, d):
    return automaton.visits(seqs(spark, d)).select("place", shown("name"), "count", "height")


def byte_names(spark, d):
    """How each byte of the vocabulary is shown."""
    b = automaton.label_counts(seqs(spark, d)).select(F.conv(F.hex("label"), 16, 10).cast("int").alias("byte"))
    return b.select("byte", W.byte_as_char(F.col("byte")).alias("shown"))


def line_checks(spark, d):
    """The documents' texts as one folder of line files: what their bytes would be refused for."""
    path = scratch(spark, "lines")
    lines = table(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("\ufeff")).otherwise(F.lit("")), F.coalesce("text", F.lit(""))).alias("value"))
    lines.write.text(path)
    v = readers.line_violations(spark, path)
    return v.agg(F.sum("cr_lines").cast("long").alias("cr_lines"), F.sum("empty_lines").cast("long").alias("empty_lines"))


def spell_misspelled_strict(spark, d):
    """All options that let words pass are off."""
    plain = OPTIONS.with_(ignore_numbers=False, ignore_punctuation=False, ignore_camel_case=False, ignore_all_uppercase=False, convert_case=False)
    known = vocabulary(spark, d).select(F.col("word").alias("base"), F.col("word").alias("inflected"), F.lit(None).cast("string").alias("tag"))
    return speller.with_misspelled(raw_words(table(spark, d, "conversations")), Lexicon.compile(known, plain))


def dict_files_roundtrip(spark, d):
    """The dictionary as a binary file with its metadata file, found again by the rule for its name."""
    path = scratch(spark, "lexicon.dict")
    derived(spark, d).write(path, "cfsa2")
    return Lexicon.read(spark, path).scan()


def dict_tools_roundtrip(spark, d):
    """Source lines compiled, validated and decompiled again by the command-line tools."""
    path = scratch(spark, "tools")
    rows = counted(spark, d).select(F.concat_ws("+", _stem(F.col("word")), "word", "lang").cast("binary").alias("line"))
    readers.write_one(rows, f"{path}/d.input")
    readers.write_bytes(spark, f"{path}/d.info", write_metadata(OPTIONS.with_(encoder="infix")))
    for code in (tools.main(["dict_compile", "-i", f"{path}/d.input"], spark), tools.main(["dict_decompile", "-i", f"{path}/d.dict", "-o", f"{path}/back"], spark)):
        if code != tools.DONE:
            raise RuntimeError(f"exit code {code}")
    return readers.read_lines(spark, f"{path}/back").select(F.decode("line", "UTF-8").alias("line"))


def fsa_tools_roundtrip(spark, d):
    """Word lines compiled to an automaton and dumped again, in byte order."""
    path = scratch(spark, "tools")
    readers.write_one(seqs(spark, d), f"{path}/w.input")
    for code in (tools.main(["fsa_compile", "-i", f"{path}/w.input", "-o", f"{path}/w.fsa"], spark), tools.main(["fsa_decompile", "-i", f"{path}/w.fsa", "-o", f"{path}/w.out"], spark)):
        if code != tools.DONE:
            raise RuntimeError(f"exit code {code}")
    return readers.read_lines(spark, f"{path}/w.out").select(F.hex("line").alias("seq"))


def dict_apply_charset(spark, d):
    """Lines in ISO-8859-15, looked up by the tool in a dictionary in UTF-8."""
    path = scratch(spark, "tools")
    derived(spark, d).write(f"{path}/lexicon.dict")
    readers.write_one(probes(spark, d).select(lexicon.strict_bytes(F.col("word"), "iso8859-15")), f"{path}/words.txt")
    return tools.apply_dict(spark, f"{path}/lexicon.dict", f"{path}/words.txt", "iso8859-15")


def dict_apply_ordered(spark, d):
    """A file of lines, the last words first, looked up by the tool: output lines by their place."""
    path = scratch(spark, "tools")
    derived(spark, d).write(f"{path}/lexicon.dict")
    readers.write_one(probes(spark, d).orderBy(F.desc("word")).select(F.col("word").cast("binary").alias("line")), f"{path}/words.txt")
    return numbered(tools.apply_dict(spark, f"{path}/lexicon.dict", f"{path}/words.txt"), "place")


def lookup_bucketed(spark, d):
    """Look-up in a dictionary that lies in buckets by word."""
    path = scratch(spark, "buckets")
    derived(spark, d).save_buckets(path, 8)
    return lexicon.lookup(probes(spark, d), Lexicon.load_buckets(spark, path, 8))


def fsa_info(spark, d):
    """Header and totals of the vocabulary's automaton as files of both formats."""
    path = scratch(spark, "info")
    for version in formats.WRITERS:
        readers.write_fsa(seqs(spark, d), f"{path}/{version}", version, numbers=True)
    found = readers.fsa_info(spark, f"{path}/*")
    return found.select("version", F.array_contains("flags", "NUMBERS").alias("numbers"), "nodes", "arcs", "final_arcs", "sequences")


def fsa_datasource(spark, d):
    """The vocabulary as automata of ranges of it, written and read by the data source."""
    spark.dataSource.register(FsaDataSource)
    path = scratch(spark, "automata")
    seqs(spark, d).repartitionByRange(4, "seq").write.format("fsa").option("version", "cfsa2").mode("append").save(path)
    return spark.read.format("fsa").load(path).select(shown("seq"))


def fsa_dot(spark, d):
    """The graph of what follows th."""
    return automaton.dot_lines(seqs(spark, d), b"th")


def sql_lookup(spark, d):
    """Look-up by the table function of SQL."""
    register(spark, derived(spark, d), "derived")
    probes(spark, d).createOrReplaceTempView("derived_probes")
    return spark.sql("SELECT p.word, l.stem, l.tag FROM derived_probes AS p, LATERAL derived_lookup(p.word) AS l")


def stream_apply(spark, d):
    """A stream of line files, each word looked up once."""
    path = scratch(spark, "stream")
    probes(spark, d).repartition(3).select(F.col("word").alias("value")).write.text(f"{path}/in")
    streaming.stream_apply(streaming.words_stream(spark, f"{path}/in"), derived(spark, d), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.text(f"{path}/out").select(F.col("value").alias("line"))


def stream_unknown(spark, d):
    """Words of the conversations that no English document has, by conversation, as a stream of files that holds each row
    twice."""
    path = scratch(spark, "unknown")
    said = table(spark, d, "conversations").select("conv_id", "turn", F.timestamp_seconds((F.col("conv_id") + 400_000) * 3600 + F.col("turn")).alias("time"), "text")
    said.union(said).repartition(4).write.parquet(f"{path}/in")
    words = _tokens(table(spark, d, "documents").where("lang = 'en'")).select(F.col("word").alias("base")).distinct()
    known = Lexicon.compile(words.select("base", F.col("base").alias("inflected"), F.lit(None).cast("string").alias("tag")), OPTIONS)
    stream = spark.readStream.schema(said.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    unknown.count_unknown(stream, known, ("conv_id", "turn"), f"{path}/out", f"{path}/state", delay="100000 hours").awaitTermination()
    return unknown.unknown_counts(spark, f"{path}/out").select(((F.unix_timestamp("start") / 3600).cast("long") - 400_000).alias("conv_id"), "words")


def stemmer_named(spark, d):
    """Look-up in a dictionary that the session opens by its name."""
    path = scratch(spark, "named.parquet")
    derived(spark, d).save(path)
    lexicon.Stemmer.register("derived", path)
    return lexicon.Stemmer.named(spark, "derived").transform(probes(spark, d), how="left")


def lookup_bytes(spark, d):
    """Look-up whose results come as bytes of the dictionary's charset, too."""
    latin = OPTIONS.with_(encoding="iso8859-1")
    rows = counted(spark, d).select(_stem(F.col("word")).alias("base"), F.col("word").alias("inflected"), F.col("lang").alias("tag")).where(~F.col("inflected").rlike("[^\\x00-\\xFF]"))
    found = lexicon.with_bytes(lexicon.lookup(probes(spark, d), Lexicon.compile(rows, latin)), latin)
    return found.select("word", *(shown(f"{c}_bytes") for c in ("word", "stem", "tag")))


def spell_sizes(spark, d):
    """Suggestions with the sizes that the search saw, for words of part names and their starts of two letters."""
    w = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    asked = w.union(w.select(F.substring("word", 1, 2)))
    return speller.with_sizes(speller.suggestions(asked, frequent(spark, d), most=2), 2).select("probe", "suggestion", "word_length", "candidate_length", "effective_distance")


def _turned(source: bytes, target: bytes) -> bytes:
    return b"T" + target[::-1]


def _turned_back(source: bytes, code: bytes) -> bytes:
    return code[1:][::-1]


def lex_custom_encoder(spark, d):
    """A dictionary by an encoder of one's own, read back from its bytes."""
    register_encoder("turned", _turned, _turned_back, 1)
    own = OPTIONS.with_(encoder="turned")
    rows = counted(spark, d).select(_stem(F.col("word")).alias("base"), F.col("word").alias("inflected"), F.col("lang").alias("tag"))
    return Lexicon(Lexicon.compile(rows, own).seqs, own).scan()


def spell_misspelled_by_file(spark, d):
    """The options come from a metadata file, in all spellings of booleans."""
    path = scratch(spark, "options.info")
    values = {"separator": "+", "encoder": "SUFFIX", "encoding": "utf-8"} | {f"speller.{k}": v for k, v in (("ignore-numbers", "no"), ("ignore-punctuation", "Off"), ("ignore-camel-case", "false"), ("ignore-all-uppercase", " FALSE "), ("convert-case", "No"))}
    readers.write_bytes(spark, path, format_properties({f"fsa.dict.{k}": v for k, v in values.items()}).encode())
    options = read_metadata(readers.read_bytes(spark, path))
    known = vocabulary(spark, d).select(F.col("word").alias("base"), F.col("word").alias("inflected"), F.lit(None).cast("string").alias("tag"))
    return speller.with_misspelled(raw_words(table(spark, d, "conversations")), Lexicon.compile(known, options))


def spell_longest(spark, d):
    """Words of 119 to 121 letters, and these less one: a speller has suggestions for words of fewer than 120."""
    names = table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("n")).distinct()
    long = names.select(F.explode(F.array(*(F.substring(F.repeat("n", 130), 1, k) for k in (119, 120, 121)))).alias("w"))
    known = Lexicon.compile(long.select(F.col("w").alias("base"), F.col("w").alias("inflected"), F.lit(None).cast("string").alias("tag")), OPTIONS)
    asked = long.select(F.concat(F.substring("w", 1, 4), F.substring("w", 6, 200)).alias("word"))
    return speller.suggestions(asked, known).select("probe", "suggestion", "distance")


def lookup_gb18030(spark, d):
    """Look-up in a dictionary whose charset has characters of two and four bytes, read back from its bytes."""
    wide = OPTIONS.with_(encoding="gb18030", encoder="infix")
    rows = counted(spark, d).select(_stem(F.col("word")).alias("base"), F.col("word").alias("inflected"), F.col("lang").alias("tag"))
    return lexicon.lookup(probes(spark, d), Lexicon(Lexicon.compile(rows, wide).seqs, wide), how="left")


def queries() -> dict:
    out = {f"lex_encode_{n}": _encode(n) for n in BY_NAME} | {"fsa5_roundtrip": _roundtrip("fsa5"), "cfsa2_roundtrip": _roundtrip("cfsa2")}
    named = (
        lookup_inner, lookup_left, lookup_not_found, lex_scan, lex_roundtrip, synth_lookup, apply_lines, dict_decompile, dict_compile_validate, dict_tag_inventory, dict_unsafe, apply_conversions,
        fsa_arcs, fsa_right_language, fsa_states, fsa_stats, fsa_fanout, fsa_label_hist, fsa_top_labels, fsa_inlinks, fsa_perfect_hash, fsa_perfect_hash_probe, fsa_match_kind, fsa_prefix_expand,
        spell_predicates, spell_in_dict, spell_misspelled, spell_runon, spell_frequency, spell_suggest_d1, spell_similar_d1, spell_suggest_diacritics, spell_suggest_equivalents, spell_suggest_d2, spell_suggest_d3, spell_suggest_pairs, spell_rewrites,
        dict_files_roundtrip, dict_tools_roundtrip, fsa_tools_roundtrip, dict_apply_charset, dict_apply_ordered, lookup_bucketed, stemmer_named, lookup_bytes, spell_sizes, lex_custom_encoder, spell_misspelled_by_file, spell_longest, lookup_gb18030, stream_unknown, fsa_info, fsa_datasource, fsa_dot, sql_lookup, stream_apply, lex_parquet_roundtrip, lookup_guards, fsa_hot_states, fsa_visits, byte_names, line_checks, spell_misspelled_strict,
    )
    return {f.__name__: f for f in named} | out


# --- the same in SQL ----------------------------------------------------------------------------------------------

_BASE = r"""
WITH tok AS (SELECT lang, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM documents),
cnt AS (SELECT word, lang, count(*) AS n FROM tok WHERE word <> '' GROUP BY word, lang),
vocab AS (SELECT DISTINCT word FROM cnt),
bytes AS (SELECT word, hex(encode(word)) AS h FROM vocab),
lex AS (SELECT word, nullif(regexp_replace(word, '(tion|ing|ed|er|en|es|ly|s)$', ''), '') AS stem, lang AS tag FROM cnt),
freq AS (SELECT word, least(length(bin(sum(n)::BIGINT)) - 1, 25)::INTEGER AS f FROM cnt GROUP BY word),
said AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM conversations) WHERE word <> ''),
wrong AS (
  SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL
    SELECT CASE WHEN length(word) >= 5 THEN substr(word, 1, 4) || substr(word, 6) ELSE word || substr(word, length(word), 1) END FROM vocab)
),
pairs AS (
  SELECT source, target, hex(encode(source)) AS s, hex(encode(target)) AS t, strlen(source) AS ls, strlen(target) AS lt FROM (
    SELECT word AS source, CASE length(word) % 4 WHEN 0 THEN regexp_replace(word, '(tion|ing|ed|er|en|es|ly|s)$', '') WHEN 1 THEN substr(word, 3) || 'e'
      WHEN 2 THEN substr(word, 1, 1) || substr(word, 4) ELSE 'ge' || substr(word, 1, length(word) - 2) END AS target FROM vocab)
)
"""
#: All over bytes, two hexadecimal digits each.
_TREE = _BASE + r""",
pre AS (SELECT substr(h, 1, 2 * i) AS prefix, substr(h, 2 * i + 1, 2) AS label, substr(h, 2 * i + 3) AS rest, substr(h, 2 * i + 1) AS suffix FROM (SELECT h, unnest(range(length(h) // 2)) AS i FROM bytes)),
arcs AS (SELECT prefix, label, bool_or(rest = '') AS is_final, bool_and(rest = '') AS is_terminal FROM pre GROUP BY prefix, label),
langs AS (SELECT prefix, count(*) AS count, max(length(suffix)) // 2 AS height, md5(string_agg(suffix, ' ' ORDER BY suffix)) AS state FROM pre GROUP BY prefix),
st AS (SELECT state, min(prefix) AS name, any_value(count) AS count, any_value(height) AS height FROM langs GROUP BY state),
named AS (SELECT prefix, name FROM langs JOIN st USING (state)),
merged AS (SELECT a.prefix AS src, a.label, n.name AS dst, a.is_final, a.is_terminal FROM arcs a JOIN st ON st.name = a.prefix LEFT JOIN named n ON n.prefix = a.prefix || a.label)
"""
_PROBE = _TREE + r""",
probe AS (SELECT DISTINCT unnest([h, substr(h, 1, length(h) - 2), h || '78', '51' || h]) AS probe FROM (SELECT hex(encode(word)) AS h FROM said)),
known AS (SELECT prefix || label AS p, bool_or(rest = '') AS whole FROM pre GROUP BY prefix || label),
best AS (SELECT probe, max(length(p) // 2) AS size, bool_or(whole AND p = probe) AS whole FROM (SELECT probe, unnest(range(1, length(probe) // 2 + 1)) AS i FROM probe) JOIN known ON p = substr(probe, 1, 2 * i) GROUP BY probe),
kinds AS (
  SELECT probe, CASE WHEN whole THEN 0 WHEN coalesce(size, 0) = length(probe) // 2 THEN -4 WHEN coalesce(size, 0) > 0 THEN -3 ELSE -1 END::INTEGER AS kind,
    CASE WHEN NOT whole AND size < length(probe) // 2 THEN size ELSE 0 END::INTEGER AS index FROM probe LEFT JOIN best USING (probe)
)
"""
#: Matches by the entries nearest before and behind each probe.
_NEAREST = _BASE + rf""", probe AS (SELECT DISTINCT unnest([h, substr(h, 1, length(h) - 2), h || '78', '51' || h]) AS probe FROM (SELECT hex(encode(word)) AS h FROM said)),
marks AS (SELECT probe AS p, NULL AS h FROM probe UNION ALL SELECT h, h FROM bytes),
near AS (
  SELECT p AS probe, below, above FROM (
    SELECT p, h, max(h) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below,
      min(h) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM marks) WHERE h IS NULL
), sizes AS (
  SELECT probe, below = probe AS whole, coalesce(list_max(list_filter(range(length(probe) // 2 + 1), lambda k: starts_with(below, substr(probe, 1, 2 * k)) OR starts_with(above, substr(probe, 1, 2 * k)))), 0) AS size FROM near
), kinds AS (
  SELECT probe, CASE WHEN whole THEN 0 WHEN size = length(probe) // 2 THEN -4 WHEN size > 0 THEN -3 ELSE -1 END::INTEGER AS kind, CASE WHEN NOT coalesce(whole, false) AND size < length(probe) // 2 THEN size ELSE 0 END::INTEGER AS index FROM sizes
)
"""
_PREDICATES = {
    "alphabetic": r"regexp_full_match(word, '[\p{L}\p{Nl}]')",
    "no_digit": r"NOT regexp_matches(word, '\p{Nd}')",
    "all_upper": r"NOT regexp_matches(word, '\p{Ll}')",
    "not_all_lower": r"regexp_matches(word, '[\p{Lu}\p{Lt}\p{Lm}\p{Lo}]')",
    "not_capitalized": r"NOT regexp_full_match(word, '\p{Lu}[^\p{Lu}\p{Lt}\p{Lm}\p{Lo}]*')",
}
_CASED = f"""
raw AS (SELECT word, {", ".join(f"{v} AS {k}" for k, v in _PREDICATES.items())} FROM words),
cased AS (SELECT *, NOT all_upper AND not_capitalized AND not_all_lower AS mixed, upper(substr(word, 1, 0)) || substr(word, 1, 1) || lower(substr(word, 2)) AS initial_upper FROM raw)
"""
_WORDS = r"words AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(text, '[^\p{L}\p{Nd}]+')) AS word FROM %s) WHERE word <> ''),"


# Letters beyond a-z in the tables, each by a sign of one byte, as the distances of the SQL count bytes.
_ONE = "translate({}, 'éèßêçíóöüäñ', 'ABCDEFGHIJK')"
_SHORTER = "list_transform(range(1, length({0}) + 1), lambda i: substr({0}, 1, i - 1) || substr({0}, i + 1))"
# Of words that no two edits without a swap make equal: a swap of neighbours, and at most one edit on either side of it.
_SWAP = """len(list_filter(range(1, length(x)), lambda i: len(list_filter([i - 1, i, i + 1], lambda j: j >= 1 AND j < length(y) AND substr(y, j, 2) = substr(x, i + 1, 1) || substr(x, i, 1)
  AND damerau_levenshtein(substr(x, 1, i - 1), substr(y, 1, j - 1)) + damerau_levenshtein(substr(x, i + 2), substr(y, j + 2)) <= 1)) > 0)) > 0"""


# The distance of neighbouring swaps by its table, a row at a time; {x} and {y} are its sides.
_TABLE = """list_reduce(list_prepend([range(length(y_) + 1), range(length(y_) + 1)], list_transform(range(1, length(x_) + 1), lambda i: [[i]])), lambda two, k: [
  list_reduce(list_prepend([k[1][1]], list_transform(range(1, length(y_) + 1), lambda j: [j])), lambda r, j: list_append(r, least(two[1][j[1] + 1] + 1, r[j[1]] + 1, two[1][j[1]] + (substr(x_, k[1][1], 1) <> substr(y_, j[1], 1))::BIGINT,
    CASE WHEN k[1][1] > 1 AND j[1] > 1 AND substr(x_, k[1][1], 1) = substr(y_, j[1] - 1, 1) AND substr(x_, k[1][1] - 1, 1) = substr(y_, j[1], 1) THEN two[2][j[1] - 1] + 1 ELSE 1000 END))), two[1]])[1][-1]"""


# Of words whose letters x and y are equal by class: a swap of neighbours counts for the letters themselves only.
_ALIKE = """CASE WHEN levenshtein(x, y) <= 1 THEN levenshtein(x, y) WHEN length(x) = length(y) AND len(list_filter(range(1, length(x)), lambda i: substr(probe, i, 1) = substr(suggestion, i + 1, 1)
  AND substr(probe, i + 1, 1) = substr(suggestion, i, 1) AND substr(x, 1, i - 1) = substr(y, 1, i - 1) AND substr(x, i + 2) = substr(y, i + 2))) > 0 THEN 1 ELSE 2 END"""


def _suggest(asked: str, extra: str, most: int = 1, distance: str | None = None) -> str:
    """Suggestions by an equi-join of what is left after deletions, and the distance of each pair."""
    keys = f"SELECT word, w, unnest(list_distinct(list_append({_SHORTER.format('w')}, w))) AS k FROM {{}}"
    if most == 2:
        keys = f"SELECT DISTINCT word, w, unnest(list_distinct(list_append({_SHORTER.format('k')}, k))) AS k FROM ({keys})"
    lev = "levenshtein(x, y)"
    distance = distance or ("damerau_levenshtein(x, y)" if most == 1 else f"CASE WHEN damerau_levenshtein(x, y) <= 1 THEN damerau_levenshtein(x, y) WHEN {lev} <= 2 OR {_SWAP} THEN 2 ELSE 3 END")
    return (
        _BASE
        + f""", asked AS ({asked}),
a AS (SELECT word, {_ONE.format('word')} AS w FROM asked WHERE length(word) < 120), b AS (SELECT word, {_ONE.format('word')} AS w FROM vocab),
ka AS ({keys.format('a')}), kb AS ({keys.format('b')}),
met AS (SELECT DISTINCT ka.word AS probe, kb.word AS suggestion, ka.w AS x, kb.w AS y FROM ka JOIN kb USING (k) WHERE ka.word <> kb.word {extra}),
near AS (SELECT probe, suggestion, ({distance})::INTEGER AS distance, f FROM met JOIN freq ON freq.word = suggestion),
all_ AS (
  SELECT probe, suggestion, distance, distance * 26 + 25 - f AS score, row_number() OVER (PARTITION BY probe ORDER BY distance * 26 + 25 - f, suggestion)::INTEGER AS rank FROM near
  WHERE distance <= CASE WHEN length(probe) <= {most} THEN length(probe) - 1 ELSE {most} END
)
SELECT * FROM all_
"""
    )


#: Rewrites with long targets: from left to right, each place where a key starts is kept or rewritten; kept comes first.
_WALK = _BASE.replace("WITH tok", "WITH RECURSIVE tok") + r""", walk(probe, done, rest, n, path) AS (
  SELECT word, '', word, 6, '' FROM wrong
  UNION ALL
  SELECT probe, done || substr(rest, 1, i - 1) || CASE b WHEN 0 THEN k ELSE t END, substr(rest, i + length(k)), n - 1, path || b FROM (
    SELECT *, CASE k WHEN 'ot' THEN 'ought' WHEN 'g' THEN 'tion' ELSE 'anded' END AS t, length(done) + i AS pos FROM (
      SELECT *, CASE WHEN substr(rest, i, 1) = 'g' THEN 'g' ELSE substr(rest, i, 2) END AS k FROM (
        SELECT *, list_min(list_filter([instr(rest, 'ot'), instr(rest, 'g'), CASE WHEN ends_with(rest, 'ed') THEN length(rest) - 1 ELSE 0 END], lambda x: x > 0)) AS i FROM walk WHERE length(probe) > 1 AND n > 0))
    WHERE i IS NOT NULL), (VALUES (0), (1)) AS v(b)
  WHERE b = 0 OR NOT (substr(done || rest, pos, length(t)) = t OR (pos - length(t) + 1 >= 1 AND substr(done || rest, pos - length(t) + 1, length(t)) = t))
), ends AS (
  SELECT probe, done || rest AS form, min(path) AS path FROM walk WHERE n = 0 OR length(probe) <= 1 OR NOT (contains(rest, 'ot') OR contains(rest, 'g') OR ends_with(rest, 'ed')) GROUP BY ALL
)
"""
#: Suggestions with all rewrite pairs: rewritten probes, their words by what is left after the short pairs and a
#: deletion, and the least cost over the points where a short pair applies and both sides are in step.
_PAIRED = _WALK + rf""", forms AS (
  SELECT probe, form, {_ONE.format('form')} AS w, row_number() OVER (PARTITION BY probe ORDER BY path) - 1 AS place FROM ends WHERE length(probe) < 120 AND probe NOT IN (SELECT word FROM vocab)
), searched AS (
  SELECT probe, form, w, place FROM (SELECT *, min(CASE WHEN place > 0 AND length(form) < 4 THEN place END) OVER (PARTITION BY probe) AS stop FROM forms) WHERE place < 14 AND (stop IS NULL OR place < stop)
), var(w, done, rest, n) AS (
  SELECT DISTINCT w, '', w, 6 FROM searched
  UNION ALL
  SELECT w, done || CASE b WHEN 0 THEN substr(rest, 1, i) ELSE substr(rest, 1, i - 1) || CASE substr(rest, i, 2) WHEN 'll' THEN 'l' ELSE 'th' END END, substr(rest, i + 1 + b), n - b
  FROM (SELECT *, list_min(list_filter([instr(rest, 'll'), instr(rest, 'sm')], lambda x: x > 0)) AS i FROM var WHERE n > 0), (VALUES (0), (1)) AS v(b) WHERE i IS NOT NULL
), x AS (SELECT DISTINCT w, done || rest AS v FROM var WHERE n = 0 OR NOT (contains(rest, 'll') OR contains(rest, 'sm'))
), y AS (SELECT word, {_ONE.format('word')} AS v FROM vocab
), kx AS (SELECT DISTINCT w, unnest(list_append({_SHORTER.format('v')}, v)) AS k FROM x), ky AS (SELECT DISTINCT word, v, unnest(list_append({_SHORTER.format('v')}, v)) AS k FROM y
), met AS (SELECT DISTINCT w, word, v FROM kx JOIN ky USING (k)
), points(w, word, v, i, j, cost) AS (
  SELECT w, word, v, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM met
  UNION
  SELECT w, word, v, i + k + 2, j + k + length(t), cost + damerau_levenshtein(substr(w, i + 1, k), substr(v, j + 1, k))
  FROM (SELECT *, unnest(range(0, least(length(w) - i, length(v) - j) + 1)) AS k FROM points WHERE contains(substr(w, i + 1), 'll') OR contains(substr(w, i + 1), 'sm')), (VALUES ('ll', 'l'), ('sm', 'th')) AS r(s, t)
  WHERE substr(w, i + k + 1, 2) = s AND substr(v, j + k + 1, length(t)) = t AND cost + damerau_levenshtein(substr(w, i + 1, k), substr(v, j + 1, k)) <= 1
), far AS (
  SELECT w, word, min(cost + damerau_levenshtein(substr(w, i + 1), substr(v, j + 1))) AS distance FROM points GROUP BY w, word HAVING distance <= CASE WHEN length(w) <= 1 THEN length(w) - 1 ELSE 1 END
), found AS (
  SELECT probe, place, word, distance FROM searched JOIN far USING (w) UNION ALL SELECT probe, place, form, 0 FROM forms WHERE form IN (SELECT word FROM vocab)
), scored AS (SELECT probe, word AS suggestion, place, distance::INTEGER AS distance, (distance * 26 + 25 - f)::INTEGER AS score FROM found JOIN freq USING (word) WHERE word <> probe
), once AS (SELECT *, row_number() OVER (PARTITION BY probe, suggestion ORDER BY score, place) AS n FROM scored
), all_ AS (SELECT probe, suggestion, distance, score, row_number() OVER (PARTITION BY probe ORDER BY score, place, suggestion)::INTEGER AS rank FROM once WHERE n = 1)
SELECT * FROM all_
"""


#: Latin-1 bytes in hexadecimal of a text that has no other characters.
_LATIN = "array_to_string(list_transform(range(1, length({0}) + 1), lambda i: printf('%02X', ord(substr({0}, i, 1)))), '')"
#: Bytes that the starts of two texts of hexadecimal digits share, of so many bytes each.
_SHARED = "list_max(list_filter(range(0, least({n}, {m}) + 1), lambda k: substr({a}, 1, 2 * k) = substr({b}, 1, 2 * k)))"


def oracle_sql() -> dict[str, str]:
    same = _SHARED.format(a="s", b="t", n="ls", m="lt")
    code = lambda n: f"printf('%02X', ((65 + {n}) % 256)::INTEGER)"
    return {
        "lex_scan": _BASE + "SELECT word, stem, tag FROM lex",
        "lex_encode_none": _BASE + "SELECT source, target, t AS coded FROM pairs",
        "lex_encode_suffix": _BASE + f"SELECT source, target, {code('ls - n')} || substr(t, 2 * n + 1) AS coded FROM (SELECT *, {same} AS n FROM pairs)",
        "lex_encode_prefix": _BASE + f""", runs AS (
  SELECT source, target, s, t, ls, list_max(list_transform(range(ls), lambda i: {{'n': list_max(list_filter(range(0, least(ls - i, lt) + 1), lambda k: substr(s, 2 * i + 1, 2 * k) = substr(t, 1, 2 * k))), 'i': -i}})) AS b FROM pairs
) SELECT source, target, {code('(-b.i)')} || {code('(ls + b.i - b.n)')} || substr(t, 2 * b.n + 1) AS coded FROM runs""",
        "lex_encode_infix": _BASE + f""", first AS (SELECT *, {same} AS f FROM pairs),
tries AS (
  SELECT *, list_transform(list_distinct([0, f]), lambda i: list_transform(range(1, ls - i + 1), lambda j: {{'n': {_SHARED.format(a="(substr(s, 1, 2 * i) || substr(s, 2 * (i + j) + 1))", b="t", n="(ls - j)", m="lt")}, 'o': -(CASE WHEN i = 0 THEN 0 ELSE 1000 END + j), 'i': i, 'j': j}})) AS found FROM first
), best AS (SELECT *, list_max(flatten(found)) AS b FROM tries
), chosen AS (
  SELECT source, target, t, ls, CASE WHEN b.n > f THEN b.n ELSE f END AS n, CASE WHEN b.n > f THEN b.i ELSE 0 END AS i, CASE WHEN b.n > f THEN b.j ELSE 0 END AS j FROM best
), last AS (SELECT *, ls - j - n AS rest FROM chosen
), moved AS (SELECT *, rest = 0 AND i + j = ls AS m FROM last)
SELECT source, target, {code('CASE WHEN m THEN 0 ELSE i END')} || {code('CASE WHEN m THEN 0 ELSE j END')} || {code('CASE WHEN m THEN j ELSE rest END')} || substr(t, 2 * n + 1) AS coded FROM moved""",
        "lex_roundtrip": _BASE + "SELECT count(*) AS pairs, 0::BIGINT AS suffix, 0::BIGINT AS prefix, 0::BIGINT AS infix, 0::BIGINT AS \"none\" FROM pairs",
        "lookup_inner": _BASE + "SELECT word, stem, tag FROM said JOIN lex USING (word)",
        "lookup_left": _BASE + "SELECT word, stem, tag FROM said LEFT JOIN lex USING (word)",
        "lookup_not_found": _BASE + "SELECT word FROM said WHERE word NOT IN (SELECT word FROM vocab)",
        "synth_lookup": _BASE + ", asked AS (SELECT DISTINCT regexp_replace(word, '(tion|ing|ed|er|en|es|ly|s)$', '') AS stem, unnest(['en', 'de']) AS tag FROM said) SELECT stem, tag, word FROM asked JOIN lex USING (stem, tag)",
        "apply_lines": _BASE + ", w AS (SELECT word FROM wrong UNION SELECT word FROM said) SELECT word || ' => ' || CASE WHEN stem IS NULL AND tag IS NULL THEN '[not found]' ELSE coalesce(stem, '') || ' ' || coalesce(tag, '') END AS line FROM w LEFT JOIN lex USING (word)",
        "dict_decompile": _BASE + "SELECT coalesce(stem, '') || '+' || word || '+' || coalesce(tag, '') AS line FROM lex",
        "dict_compile_validate": "SELECT (length(line) - length(replace(line, '+', '')))::INTEGER AS separators, count(*) AS rows FROM (SELECT concat_ws('+', replace(p_name, ' ', '+'), p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END) AS line FROM part) GROUP BY 1",
        "dict_tag_inventory": _BASE + "SELECT tag, count(*) AS entries, count(DISTINCT word) AS words FROM lex GROUP BY tag",
        "dict_unsafe": "SELECT DISTINCT base, inflected, p_brand AS tag FROM (SELECT CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '+') ELSE p_name END AS base, CASE WHEN p_size % 5 = 0 THEN replace(p_type, ' ', '+') ELSE p_type END AS inflected, p_brand FROM part) WHERE contains(base, '+') OR contains(inflected, '+')",
        "apply_conversions": _BASE + "SELECT word, replace(replace(replace(word, 'th', 'd'), 'ing', 'in'), 'er', '') AS converted FROM said",
        "fsa_arcs": _TREE + "SELECT * FROM arcs",
        "fsa_right_language": _TREE + "SELECT prefix, count FROM langs",
        "fsa_states": _TREE + "SELECT name, count FROM st",
        "fsa_stats": _TREE + "SELECT (SELECT count(*) + 1 FROM st) AS nodes, (SELECT count(*) + 1 FROM merged) AS arcs, (SELECT count(*) + 1 FROM merged WHERE is_final) AS finals, (SELECT count(*) FROM arcs) AS tree_arcs, (SELECT count(*) FROM vocab) AS sequences, (SELECT max(length(h)) // 2 FROM bytes) AS longest",
        "fsa_fanout": _TREE + ", d AS (SELECT count(*) AS fan_out FROM merged GROUP BY src), h AS (SELECT fan_out, count(*) AS states FROM d GROUP BY fan_out) SELECT fan_out, coalesce(states, 0) AS states FROM (SELECT unnest(range(min(fan_out), max(fan_out) + 1)) AS fan_out FROM h) LEFT JOIN h USING (fan_out)",
        "fsa_label_hist": _TREE + "SELECT label, count(*) AS arcs FROM merged GROUP BY label",
        "fsa_top_labels": _TREE + "SELECT label, count(*) AS arcs FROM merged GROUP BY label ORDER BY arcs DESC, label LIMIT 10",
        "fsa_inlinks": _TREE + "SELECT dst AS state, count(*) AS in_links FROM merged WHERE dst IS NOT NULL GROUP BY dst",
        "fsa_perfect_hash": _BASE + "SELECT h AS seq, row_number() OVER (ORDER BY h) - 1 AS rank FROM bytes",
        "fsa_match_kind": _NEAREST + "SELECT probe, kind, index FROM kinds",
        "fsa_perfect_hash_probe": _PROBE + ", r AS (SELECT h AS probe, row_number() OVER (ORDER BY h) - 1 AS rank FROM bytes) SELECT probe, coalesce(rank, kind)::BIGINT AS hash FROM kinds LEFT JOIN r USING (probe)",
        "fsa_prefix_expand": _BASE + ", p AS (SELECT DISTINCT substr(hex(encode(word)), 1, 10) AS prefix FROM said), c AS (SELECT h, unnest(range(1, least(5, length(h) // 2 - 1) + 1)) AS n FROM bytes) SELECT prefix, substr(h, 2 * n + 1) AS suffix FROM p JOIN c ON prefix = substr(h, 1, 2 * n)",
        "fsa5_roundtrip": _BASE + "SELECT word FROM vocab",
        "cfsa2_roundtrip": _BASE + "SELECT word FROM vocab",
        "spell_predicates": "WITH " + _WORDS % "documents" + _CASED + r"SELECT word, alphabetic, no_digit, all_upper, not_all_lower, not_capitalized, mixed, mixed AND regexp_matches(word, '^\p{Lu}\p{Ll}') AS camel, initial_upper FROM cased",
        "spell_in_dict": _BASE + "SELECT word, word IN (SELECT word FROM vocab) AS in_dictionary FROM said",
        "spell_misspelled": _BASE + "," + _WORDS % "conversations" + _CASED + r"""
SELECT word, length(word) > 0 AND word NOT IN (SELECT word FROM vocab) AND (length(word) <> 1 OR regexp_full_match(word, '[\p{L}\p{Nl}]')) AND no_digit
  AND NOT (mixed AND regexp_matches(word, '^\p{Lu}\p{Ll}')) AND NOT ((length(word) <> 1 OR regexp_full_match(word, '[\p{L}\p{Nl}]')) AND all_upper)
  AND NOT (NOT mixed AND (lower(word) IN (SELECT word FROM vocab) OR (all_upper AND initial_upper IN (SELECT word FROM vocab)))) AS misspelled FROM cased""",
        "spell_runon": _BASE + r""", known AS (SELECT word FROM vocab UNION SELECT unnest(string_split(p_name, ' ')) FROM part),
asked AS (SELECT DISTINCT unnest([replace(p_name, ' ', ''), upper(substr(p_name, 1, 1)) || substr(replace(p_name, ' ', ''), 2)]) AS word FROM part),
cut AS (SELECT word, substr(word, 1, i) AS prefix, substr(word, i + 1) AS suffix FROM (SELECT word, unnest(range(1, length(word))) AS i FROM asked WHERE word NOT IN (SELECT word FROM known)))
SELECT word, prefix, suffix, prefix || ' ' || suffix AS candidate FROM cut
WHERE (suffix IN (SELECT word FROM known) OR (regexp_full_match(suffix, '\p{Lu}[^\p{Lu}\p{Lt}\p{Lm}\p{Lo}]*') AND lower(suffix) IN (SELECT word FROM known)))
  AND (prefix IN (SELECT word FROM known) OR (regexp_matches(prefix, '^\p{Lu}') AND lower(prefix) IN (SELECT word FROM known)))""",
        "spell_frequency": _BASE + "SELECT word, coalesce(f, 0)::INTEGER AS frequency FROM said LEFT JOIN freq USING (word)",
        "spell_suggest_d1": _suggest("SELECT word FROM wrong", "AND ka.word NOT IN (SELECT word FROM vocab)"),
        "spell_suggest_d2": _suggest("SELECT word FROM wrong", "AND ka.word NOT IN (SELECT word FROM vocab)", 2),
        "spell_suggest_equivalents": _suggest("SELECT word FROM wrong UNION SELECT translate(word, 'ckvwiysz', 'kcwvyizs') FROM vocab", "AND ka.word NOT IN (SELECT word FROM vocab)", distance=_ALIKE).replace(_ONE.format("word"), f"translate({_ONE.format('word')}, 'kwyz', 'cvis')"),
        "spell_suggest_d3": _BASE + f""", names AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
a AS (SELECT word, {_ONE.format('word')} AS x_ FROM (SELECT word FROM names UNION SELECT substr(word, 1, 4) || substr(word, 6) FROM names WHERE length(word) >= 5) WHERE word NOT IN (SELECT word FROM vocab)),
met AS (SELECT a.word AS probe, v.word AS suggestion, x_, {_ONE.format('v.word')} AS y_ FROM a JOIN vocab v ON abs(length(a.word) - length(v.word)) <= 3),
far AS (SELECT *, damerau_levenshtein(x_, y_) AS low, levenshtein(x_, y_) AS high FROM met),
near AS (SELECT probe, suggestion, (CASE WHEN low = high THEN low ELSE {_TABLE} END)::INTEGER AS distance FROM far WHERE low <= 3)
SELECT probe, suggestion, distance, distance * 26 + 25 - f AS score, row_number() OVER (PARTITION BY probe ORDER BY distance * 26 + 25 - f, suggestion)::INTEGER AS rank FROM near JOIN freq ON freq.word = suggestion
WHERE distance <= CASE WHEN length(probe) <= 3 THEN length(probe) - 1 ELSE 3 END""",
        "spell_similar_d1": _suggest("SELECT word FROM vocab", ""),
        "spell_suggest_diacritics": _BASE + """, plain AS MATERIALIZED (SELECT word, lower(strip_accents(word)) AS k FROM vocab), asked AS MATERIALIZED (SELECT word, lower(strip_accents(word)) AS k FROM said ANTI JOIN vocab USING (word))
SELECT a.word AS probe, p.word AS suggestion, 0::INTEGER AS distance FROM asked a JOIN plain p USING (k)""",
        "spell_rewrites": _WALK + "SELECT probe, (row_number() OVER (PARTITION BY probe ORDER BY path) - 1)::INTEGER AS place, form FROM ends",
        "spell_suggest_pairs": _PAIRED,
        "dict_files_roundtrip": _BASE + "SELECT word, stem, tag FROM lex",
        "dict_tools_roundtrip": _BASE + "SELECT coalesce(stem, '') || '+' || word || '+' || tag AS line FROM lex",
        "fsa_tools_roundtrip": _BASE + "SELECT h AS seq FROM bytes",
        "dict_apply_charset": _BASE + "SELECT word || ' => ' || CASE WHEN stem IS NULL AND tag IS NULL THEN '[not found]' ELSE coalesce(stem, '') || ' ' || coalesce(tag, '') END AS line FROM said LEFT JOIN lex USING (word)",
        "dict_apply_ordered": _BASE + "SELECT row_number() OVER (ORDER BY word DESC, tag) - 1 AS place, word || ' => ' || CASE WHEN stem IS NULL AND tag IS NULL THEN '[not found]' ELSE coalesce(stem, '') || ' ' || coalesce(tag, '') END AS line FROM said LEFT JOIN lex USING (word)",
        "stemmer_named": _BASE + "SELECT word, stem, tag FROM said LEFT JOIN lex USING (word)",
        "lookup_bytes": _BASE + f", b AS (SELECT word, {_LATIN.format('word')} AS word_bytes, {_LATIN.format('stem')} AS stem_bytes, hex(encode(tag)) AS tag_bytes FROM said JOIN lex USING (word)) SELECT * FROM b",
        "lex_custom_encoder": _BASE + "SELECT word, stem, tag FROM lex",
        "spell_misspelled_by_file": _BASE + "," + _WORDS.rstrip(",") % "conversations" + " SELECT word, word NOT IN (SELECT word FROM vocab) AS misspelled FROM words",
        "spell_sizes": "SELECT probe, suggestion, length(probe)::INTEGER AS word_length, length(suggestion)::INTEGER AS candidate_length, CASE WHEN length(probe) <= 2 THEN length(probe) - 1 ELSE 2 END::INTEGER AS effective_distance FROM ("
        + _suggest("SELECT unnest([w, substr(w, 1, 2)]) AS word FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)", "AND ka.word NOT IN (SELECT word FROM vocab)", 2) + ")",
        "spell_longest": """
WITH n AS (SELECT DISTINCT replace(p_name, ' ', '') AS n FROM part), w AS (SELECT DISTINCT unnest([substr(repeat(n, 130), 1, 119), substr(repeat(n, 130), 1, 120), substr(repeat(n, 130), 1, 121)]) AS w FROM n),
a AS (SELECT DISTINCT substr(w, 1, 4) || substr(w, 6) AS p FROM w WHERE length(w) < 121),
k AS (SELECT DISTINCT w, unnest(list_transform(range(1, length(w) + 1), lambda i: substr(w, 1, i - 1) || substr(w, i + 1))) AS k FROM w),
m AS (SELECT p, w FROM a JOIN k ON k = p UNION SELECT a.p, b.w FROM (SELECT p, unnest(list_transform(range(1, length(p) + 1), lambda i: substr(p, 1, i - 1) || substr(p, i + 1))) AS k FROM a) a JOIN k b USING (k) UNION
  SELECT p, w FROM (SELECT p, unnest(list_transform(range(1, length(p) + 1), lambda i: substr(p, 1, i - 1) || substr(p, i + 1))) AS k FROM a) JOIN w ON w = k)
SELECT p AS probe, w AS suggestion, 1::INTEGER AS distance FROM m WHERE damerau_levenshtein(p, w) = 1 AND p NOT IN (SELECT w FROM w)""",
        "lookup_gb18030": _BASE + "SELECT word, stem, tag FROM said LEFT JOIN lex USING (word)",
        "stream_unknown": r"""
SELECT conv_id, count(*) AS words FROM (SELECT conv_id, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM conversations)
WHERE word <> '' AND word NOT IN (SELECT unnest(string_split_regex(lower(text), '[^\p{L}]+')) FROM documents WHERE lang = 'en' AND text IS NOT NULL) GROUP BY conv_id""",
        "lookup_bucketed": _BASE + "SELECT word, stem, tag FROM said JOIN lex USING (word)",
        "fsa_info": _TREE + "SELECT unnest([5, 198])::INTEGER AS version, true AS numbers, (SELECT count(*) + 1 FROM st) AS nodes, (SELECT count(*) + 1 FROM merged) AS arcs, (SELECT count(*) + 1 FROM merged WHERE is_final) AS final_arcs, (SELECT count(*) FROM vocab) AS sequences",
        "fsa_datasource": _BASE + "SELECT h AS seq FROM bytes",
        "fsa_dot": _TREE.replace("SELECT word, hex(encode(word)) AS h FROM vocab", "SELECT word, substr(hex(encode(word)), 5) AS h FROM vocab WHERE starts_with(word, 'th') AND word <> 'th'") + """
, shown AS (SELECT *, list_transform([src, dst, label], lambda x: array_to_string(list_transform(range(length(x) // 2), lambda i: chr(('0x' || substr(x, 2 * i + 1, 2))::INTEGER)), '')) AS s FROM merged)
SELECT '  "' || s[1] || '/" -> ' || CASE WHEN dst IS NULL THEN '"."' ELSE '"' || s[2] || '/"' END || ' [label="' || s[3] || '"' || CASE WHEN is_final THEN ', style=bold' ELSE '' END || '];' AS line FROM shown""",
        "sql_lookup": _BASE + "SELECT word, stem, tag FROM said JOIN lex USING (word)",
        "stream_apply": _BASE + "SELECT word || ' => ' || CASE WHEN stem IS NULL AND tag IS NULL THEN '[not found]' ELSE coalesce(stem, '') || ' ' || coalesce(tag, '') END AS line FROM said LEFT JOIN lex USING (word)",
        "lex_parquet_roundtrip": _BASE + "SELECT word, stem, tag FROM lex",
        "lookup_guards": _BASE + "," + _WORDS.rstrip(",") % "conversations" + """,
asked AS (SELECT unnest([word, word || '+' || word, word || chr(380)]) AS word FROM words)
SELECT word, stem, tag FROM asked LEFT JOIN lex USING (word)""",
        "fsa_hot_states": _TREE + "SELECT dst AS state, count(*) AS in_links FROM merged WHERE dst IS NOT NULL GROUP BY dst HAVING count(*) > 2 ORDER BY in_links DESC, state DESC LIMIT 150",
        "fsa_visits": _TREE + "SELECT row_number() OVER (ORDER BY height, name) - 1 AS place, name, count, height::INTEGER AS height FROM st",
        "byte_names": _TREE + "SELECT byte, CASE WHEN byte > 32 AND byte < 127 THEN chr(byte) || printf(' (0x%02x)', byte) ELSE printf('0x%02x', byte) END AS shown FROM (SELECT DISTINCT ('0x' || label)::INTEGER AS byte FROM merged)",
        "line_checks": "SELECT sum(length(t) - length(replace(t, chr(13), '')) > 0)::BIGINT AS cr_lines, sum(t = '')::BIGINT AS empty_lines FROM (SELECT unnest(string_split(CASE WHEN doc_id % 3 = 0 THEN chr(65279) ELSE '' END || coalesce(text, ''), chr(10))) AS t FROM documents)",
        "spell_misspelled_strict": _BASE + "," + _WORDS.rstrip(",") % "conversations" + " SELECT word, word NOT IN (SELECT word FROM vocab) AS misspelled FROM words",
    }
