import pytest
from pyspark.sql import functions as F

from lexspark.operators import automaton as A
from lexspark.operators import lexicon as L
from lexspark.operators import speller as S
from lexspark.sources.metadata import Metadata

PLAIN = Metadata("+", "suffix", "utf-8", ignore_diacritics=False)
NONE = Metadata("+", "none", "iso8859-1")
ABC = "a aba ac b ba c".split()


def seqs(spark, words):
    return A.sequences(spark.createDataFrame([(w if isinstance(w, bytes) else w.encode(),) for w in words], "seq binary"))


def words(spark, *ws):
    return spark.createDataFrame([(w,) for w in ws], "word string")


def test_totals_of_the_small_automaton(spark):
    r = A.totals(seqs(spark, ABC)).first()
    assert (r.nodes, r.arcs, r.finals, r.sequences, r.longest) == (4, 7, 6, 6, 3)
    assert {bytes(r[0]).decode(): r[1] for r in A.right_languages(seqs(spark, ABC)).select("prefix", "count").collect()} == {"": 6, "a": 2, "ab": 1, "b": 1}
    assert [tuple(r) for r in A.fan_outs(seqs(spark, ABC)).orderBy("fan_out").collect()] == [(1, 1), (2, 1), (3, 1)]
    assert {bytes(r.state).decode(): r.in_links for r in A.in_links(seqs(spark, ABC)).collect()} == {"a": 1, "ab": 2}
    assert "digraph" in A.dot(seqs(spark, ABC)) and A.dot(seqs(spark, ABC)).count("->") == 6


def test_perfect_hash(spark):
    probes = spark.createDataFrame([(w,) for w in [*ABC, "abax", "abx", "ab", "d", "\0"]], "probe string")
    got = {bytes(r[0]).decode(): r[1] for r in A.perfect_hash(probes, seqs(spark, ABC)).collect()}
    assert got == {"a": 0, "aba": 1, "ac": 2, "b": 3, "ba": 4, "c": 5, "abax": -3, "abx": -3, "ab": -4, "d": -1, "\0": -1}


def test_match_kinds(spark):
    stored = "a ab abc ad bcd bce".split()
    probes = spark.createDataFrame([(w,) for w in "a ab abc ad b bc abcd ade ax d".split()] + [("",), (None,)], "probe string")
    got = {bytes(r[0]).decode(): (r[1], r[2]) for r in A.matched(probes, seqs(spark, stored)).collect()}
    assert got == {"a": (0, 0), "ab": (0, 0), "abc": (0, 0), "ad": (0, 0), "b": (-4, 0), "bc": (-4, 0), "abcd": (-3, 3), "ade": (-3, 2), "ax": (-3, 1), "d": (-1, 0), "": (-4, 0)}


def test_expansion_and_empty_sets(spark):
    starts = spark.createDataFrame([("a",), ("b",), ("x",)], "prefix string")
    got = {(bytes(r[0]).decode(), bytes(r[1]).decode()) for r in A.expanded(starts, seqs(spark, ABC)).collect()}
    assert got == {("a", "ba"), ("a", "c"), ("b", "a")}
    assert A.ranked(seqs(spark, [])).count() == 0 and A.fan_outs(seqs(spark, [])).count() == 0 and A.totals(seqs(spark, [])).first().nodes == 1


def test_bytes_above_127_sort_unsigned(spark):
    got = [(bytes(r[0]), r[1]) for r in A.ranked(seqs(spark, [b"\xff", b"\x00", b"a", b"\x80a"])).orderBy("rank").collect()]
    assert got == [(b"\x00", 0), (b"a", 1), (b"\x80a", 2), (b"\xff", 3)]


ENTRIES = ["token1+", "token2++", "token3+++", "token4+token2", "token5+token2+", "token6+token2++", "token7+token2+token3+", "token8+token2+token3++"]


def test_scan_with_empty_fields(spark):
    lex = L.Lexicon(seqs(spark, ENTRIES), NONE)
    assert {tuple(r) for r in lex.scan().collect()} == {
        ("token1", None, None), ("token2", None, None), ("token3", None, "+"), ("token4", "token2", None), ("token5", "token2", None), ("token6", "token2", "+"), ("token7", "token2", "token3+"), ("token8", "token2", "token3++"),
    }


def test_an_empty_base_hides_a_word(spark):
    lex = L.Lexicon(seqs(spark, ["w+", "w+base", "v+base"]), NONE)
    assert {tuple(r) for r in L.lookup(words(spark, "w", "v"), lex).collect()} == {("v", "base", None)}


def test_separator_in_a_probe(spark):
    lex = L.Lexicon(seqs(spark, ["l+A+LW", "l+A+NN1d"]), NONE)
    assert L.lookup(words(spark, "l+A", None), lex).count() == 0
    assert {r.tag for r in L.lookup(words(spark, "l"), lex).collect()} == {"LW", "NN1d"}


JAWA = [("jawa", "jawy", "subst:pl:acc:f"), ("jawa", "jawy", "subst:pl:nom:f"), ("jawa", "jawie", "subst:sg:dat:f"), ("jaźń", "jaźnie", None)]


@pytest.mark.parametrize("encoder", ["suffix", "prefix", "infix", "none"])
@pytest.mark.parametrize("encoding", ["utf-8", "iso-8859-2", "cp1250"])
def test_compile_look_up_and_decompile(spark, encoder, encoding):
    m = Metadata(";", encoder, encoding)
    lex = L.Lexicon.compile(spark.createDataFrame(JAWA, "base string, inflected string, tag string"), m)
    assert {(r.inflected, r.base, r.tag) for r in spark.createDataFrame(JAWA, "base string, inflected string, tag string").collect()} == {tuple(r) for r in lex.scan().collect()}
    assert {tuple(r) for r in L.lookup(words(spark, "jawy", "nic"), lex, how="left").collect()} == {("jawy", "jawa", "subst:pl:acc:f"), ("jawy", "jawa", "subst:pl:nom:f"), ("nic", None, None)}
    assert {r.line for r in lex.decompile().collect()} == {";".join([b, i, t or ""]) for b, i, t in JAWA}
    assert L.lookup(words(spark, "jawy", "nic"), lex, how="anti").first().word == "nic"
    asked = spark.createDataFrame([("jawa", "subst:sg:dat:f")], "stem string, tag string")
    assert L.synthesize(asked, lex).first().word == "jawie"


def test_applied_lines(spark):
    lex = L.Lexicon.compile(spark.createDataFrame(JAWA, "base string, inflected string, tag string"), PLAIN)
    assert {r.line for r in L.applied(words(spark, "jawie", "x", "", "jaźnie"), lex).collect()} == {"jawie => jawa subst:sg:dat:f", "x => [not found]", "jaźnie => jaźń "}
    assert {r.line for r in L.applied(words(spark, "jawie"), lex, skip_tags=True).collect()} == {"jawie => jawa"}


def test_conversions(spark):
    m = PLAIN.with_(input_conversion=(("fi", "ﬁ"), ("_", "x")), output_conversion=(("ﬁ", "fi"),))
    lex = L.Lexicon.compile(spark.createDataFrame([("ﬁlut", "ﬁluta", None)], "base string, inflected string, tag string"), m)
    assert [tuple(r) for r in L.lookup(words(spark, "filuta"), lex).collect()] == [("filuta", "ﬁlut", None)]


def test_source_rows(spark):
    lines = spark.createDataFrame([("a+b",), ("a+b+c",), ("a+b+c",)], "line string")
    rows = L.source_rows(lines, PLAIN)
    assert {tuple(r) for r in L.source_violations(rows).collect()} == {(1, 1), (2, 2)}
    with pytest.raises(L.SourceError):
        L.checked_rows(rows)
    four = L.source_rows(spark.createDataFrame([("a+b+c+d",)], "line string"), PLAIN).first()
    assert (four.tag, four.separators) == ("c+d", 3)


def test_unsafe_entries(spark):
    lex = L.Lexicon(seqs(spark, ["c+Ba", "d+E"]), PLAIN)
    assert lex.unsafe_entries().count() == 0
    # a code byte that equals the separator is no separator, and cuts the word so that a plus of it stays in the stem
    odd = L.Lexicon(seqs(spark, [b"c+" + bytes([43]) + b"x"]), PLAIN)
    assert odd.scan().first().stem == "x" and odd.unsafe_entries().count() == 0


FREQUENT = "ageist+C deist+G didst+A digest+J direst+E dist+G divest+I fist+J gist+G grist+I heist+I hist+A jest+H jilt+D joist+F just+P licit+F list+O mist+J weest+A wist+C".split()
LONG_PAIRS = (("teached", "taught"), ("t", "tgh"), ("a", "ei"), ("i", "igh"), ("igh", "i"), ("i", "ee"), ("ee", "i"), ("j", "di"), ("di", "j"), ("s", "ci"), ("j", "ge"))


def by_frequency(spark, **more):
    rows = [(w, w, f) for w, f in (x.split("+") for x in FREQUENT)]
    return L.Lexicon.compile(spark.createDataFrame(rows, "base string, inflected string, tag string"), Metadata("+", "suffix", "utf-8", frequency_included=True, **more))


def test_frequencies(spark):
    got = {r.word: r.frequency for r in L.frequencies(words(spark, "just", "hist", "none"), by_frequency(spark)).collect()}
    assert got == {"just": 15, "hist": 0, "none": 0}


def order(df, probe):
    return [r.suggestion for r in df.where(F.col("probe") == probe).orderBy("rank").collect()]


def test_suggestions_by_frequency(spark):
    lex = by_frequency(spark, replacement_pairs=LONG_PAIRS)
    got = S.suggestions(words(spark, "jist", "list", None, ""), lex)
    assert order(got, "jist")[:7] == "just list fist mist jest dist gist".split() and order(got, "list") == []
    like = S.suggestions(words(spark, "fist", "mist", "Fist", "licit"), lex, even_if_known=True)
    for probe, first in (("fist", "list mist dist gist wist hist"), ("mist", "list fist dist gist wist hist"), ("Fist", "fist list mist dist gist wist hist")):
        assert [x for x in order(like, probe) if x in first.split()] == first.split()


def test_suggestions_natively(spark):
    lex = by_frequency(spark, ignore_diacritics=False)
    assert order(S.suggestions(words(spark, "jist", "lsit"), lex), "jist")[:3] == ["just", "list", "fist"]
    assert order(S.suggestions(words(spark, "lsit"), lex), "lsit") == ["list"]


def plain(spark, ws, **options):
    return L.Lexicon.compile(spark.createDataFrame([(w, w, None) for w in ws], "base string, inflected string, tag string"), Metadata("+", "suffix", "utf-8", **options))


def test_suggestions_with_pairs(spark):
    lex = plain(spark, "pissarra passara passarà".split(), replacement_pairs=(("s", "ss"), ("ss", "s")))
    got = {r.suggestion: r.distance for r in S.suggestions(words(spark, "pissara"), lex, most=2).collect()}
    assert got == {"pissarra": 1, "passara": 1, "passarà": 1}
    lex = plain(spark, ["IJsland", "a lot", "på ny"], replacement_pairs=(("^Ij", "IJ"), ("^alot", "a lot"), ("^påny$", "på ny")))
    got = S.suggestions(words(spark, "Ijsland", "alot", "påny"), lex, most=0)
    assert {(r.probe, r.suggestion) for r in got.collect()} == {("Ijsland", "IJsland"), ("alot", "a lot"), ("påny", "på ny")}
    lex = plain(spark, ["taught", "teach"], replacement_pairs=(("teached", "taught"), ("t", "tgh")))
    assert "taught" in order(S.suggestions(words(spark, "teached"), lex), "teached")


def test_spelling_queries_edit_the_whole_vocabulary(spark, tmp_path):
    """Against brute force over words of all lengths, none of them long."""
    from lexspark.functions.distance import Rules, distance, rewritten
    from lexspark.plans import catalogue as C

    vocabulary = "the then than thin ball small thought brought nation station lamped longer singer stone notes cab abc bca wellness ".split()
    spark.createDataFrame([(" ".join(vocabulary), "en")], "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("misty tono",)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    probes = {"misty", "tono"} | {w[:4] + w[5:] if len(w) > 4 else w + w[-1] for w in vocabulary}
    unknown, d = sorted(probes - set(vocabulary)), str(tmp_path)
    got = {(r.probe, r.suggestion, r.distance) for r in C.spell_suggest_d2(spark, d).collect()}
    assert got == {(p, w, distance(p, w)) for p in unknown for w in vocabulary if distance(p, w) <= 2} and len({p for p, *_ in got}) > 15
    rules = Rules.of(C.PAIRS)
    assert {(r.probe, r.place, r.form) for r in C.spell_rewrites(spark, d).collect()} == {(p, i, f) for p in probes for i, f in enumerate(rewritten(p, rules.long))}
    forms = {(p, f) for p in unknown for f in rewritten(p, rules.long)}
    want = {(p, w) for p, f in forms for w in vocabulary if w != p and distance(f, w, rules) <= 1}
    assert {(r.probe, r.suggestion) for r in C.spell_suggest_pairs(spark, d).collect()} == want and len({p for p, _ in want}) > 15


def test_equivalents_are_directional(spark):
    lex = plain(spark, ["łza", "xza"], ignore_diacritics=False, equivalent_chars=(("x", "ł"),))
    got = {r.suggestion: r.distance for r in S.suggestions(words(spark, "xza"), lex, even_if_known=True).collect()}
    assert got == {"łza": 0}


def test_run_ons(spark):
    lex = plain(spark, ["a", "lot", "red", "ring"])
    got = {(r.word, r.candidate) for r in S.run_ons(words(spark, "alot", "redring", "Redring", "redRing", "rEdring", "red", None), lex).collect()}
    assert got == {("alot", "a lot"), ("redring", "red ring"), ("Redring", "Red ring"), ("redRing", "red Ring")}


def test_misspelled(spark):
    lex = plain(spark, ["known", "Name", "Warsaw"])
    ws = ["known", "Known", "KNOWN", "unknwon", "name", "Name", "NAME", "NAMEX", "x1y", ",", "CamelCase", "kNown", "WARSAW", "", None]
    got = {r.word for r in S.with_misspelled(words(spark, *ws), lex).where("misspelled").collect()}
    assert got == {"unknwon", "name", "kNown"}
    strict = plain(spark, ["known"], ignore_all_uppercase=False, ignore_numbers=False, ignore_camel_case=False, convert_case=False, ignore_punctuation=False)
    got = {r.word for r in S.with_misspelled(words(spark, *ws), strict).where("misspelled").collect()}
    assert got == set(ws) - {"known", "", None}


def test_membership_of_plain_lists(spark):
    lex = L.Lexicon(seqs(spark, ["one", "two"]), PLAIN)
    assert {r.word: r.in_dictionary for r in S.with_membership(words(spark, "one", "on", None), lex).collect()} == {"one": True, "on": False, None: False}


def test_states_are_visited_in_order(spark):
    s = seqs(spark, ["a", "aba", "ac", "b", "ba", "c"])
    post = A.visits(s).orderBy("place").collect()
    assert [r.place for r in post] == list(range(len(post))) and {bytes(r.name) for r in post} == {bytes(r.name) for r in A.states(s).collect()}
    place = {bytes(r.name): r.place for r in post}
    arcs = [(bytes(r.src), bytes(r.dst)) for r in A.merged_arcs(s).collect() if r.dst is not None]
    assert arcs and all(place[a] > place[b] for a, b in arcs)
    pre = {bytes(r.name): r.place for r in A.visits(s, "pre").collect()}
    assert all(pre[a] < pre[b] for a, b in arcs)
    stopped = A.visits(s, "pre", spark.createDataFrame([(b"a",)], "name binary")).collect()
    assert {bytes(r.name) for r in stopped} == {b"", b"a", b"b"}  # the state behind ab is behind b, too, unless it is another
    with pytest.raises(ValueError, match="order"):
        A.visits(s, "up")


def test_ranks_in_cells_of_any_depth(spark):
    words = sorted({w.encode() for w in ("a", "ab", "abc", "abcd", "abce", "b")} | {b"http://x/%d" % i for i in range(60)} | {b"http", b"ht", bytes([255, 0]), b"abcdefgh"})
    s = seqs(spark, words)
    for cell in (1, 5, 1000):
        assert [(bytes(r.seq), r["rank"]) for r in A.ranked(s, cell).orderBy("rank").collect()] == [(w, i) for i, w in enumerate(words)]


def test_sub_graphs(spark):
    s = seqs(spark, ["ax", "ay", 'b"', "c"])
    assert sorted(bytes(r.seq) for r in A.below(s, b"a").collect()) == [b"x", b"y"]
    assert A.dot(s, b"a").splitlines()[2:-1] == ['  "/" -> "." [label="x", style=bold];', '  "/" -> "." [label="y", style=bold];']
    assert '[label="\\""' in A.dot(s) and A.dot(s).count("->") == 6


def test_registered_encoders(spark):
    from lexspark.functions import encoders

    encoders.register("mirror", lambda s, t: b"M" + t[::-1], lambda s, c: c[1:][::-1], 1)
    try:
        lex = L.Lexicon.compile(spark.createDataFrame([("base", "word", "t")], "base string, inflected string, tag string"), PLAIN.with_(encoder="mirror"))
        assert bytes(lex.seqs.first().seq) == b"word+Mesab+t" and tuple(L.Lexicon(lex.seqs, lex.metadata).scan().first()) == ("word", "base", "t")
        with pytest.raises(ValueError, match="mirror"):
            encoders.register("mirror", lambda s, t: t, lambda s, c: c, 0)
    finally:
        del encoders.BY_NAME["mirror"]
    with pytest.raises(ValueError, match="encoder"):
        PLAIN.with_(encoder="mirror")


def test_strict_charsets_and_bytes(spark):
    df = spark.createDataFrame([("ż", b"\xbf"), ("a", b"a"), (None, None)], "t string, b binary")
    got = df.select(L.strict_bytes(F.col("t"), "iso8859-2").alias("x"), L.strict_text(F.col("b"), "iso8859-2").alias("y")).collect()
    assert [(r.x and bytes(r.x), r.y) for r in got] == [(b"\xbf", "ż"), (b"a", "a"), (None, None)]
    for c in (L.strict_bytes(F.lit("ж"), "iso8859-2"), L.strict_text(F.lit(b"\xff"), "utf-8"), L.strict_text(F.lit(b"\x81"), "cp1252"), L.strict_bytes(F.lit("é"), "ascii")):
        with pytest.raises(Exception, match="not in"):
            spark.range(1).select(c).collect()
    r = L.with_bytes(spark.createDataFrame([("ż", None, "t")], "word string, stem string, tag string"), PLAIN.with_(encoding="iso8859-2")).first()
    assert (bytes(r.word_bytes), r.stem_bytes, bytes(r.tag_bytes)) == (b"\xbf", None, b"t")


def test_sizes_that_the_search_saw(spark):
    found = spark.createDataFrame([("ab", "abc"), ("abcd", "abd")], "probe string, suggestion string")
    assert [tuple(r)[2:] for r in S.with_sizes(found, 2).collect()] == [(2, 3, 1), (4, 3, 2)]
