"""Similarity joins without caps, order, buckets, long sequences, charsets of several bytes, and the stateful stream."""

import random

import pytest
from pyspark.sql import functions as F

from lexspark import tools
from lexspark.functions import charsets, distance as D
from lexspark.functions.hashes import part_hashes
from lexspark.operators import automaton as A, lexicon as L, speller as S
from lexspark.sources import readers, store
from lexspark.sources.metadata import Metadata
from lexspark.streaming import unknown

PLAIN = Metadata("+", "suffix", "utf-8", ignore_diacritics=False)


def words_of(spark, words, column="word"):
    return spark.createDataFrame([(w,) for w in words], f"{column} string")


def pairs_of(spark, probes, known, most, rules):
    return {(r.probe, r.word, r.distance) for r in S.similar_pairs(words_of(spark, sorted(probes), "probe"), words_of(spark, sorted(known)), most, rules).collect()}


def plain_pairs(probes, known, most, rules):
    allowed = lambda p: len(p) - 1 if len(p) <= most else most
    return {(p, w, d) for p in probes for w in known if (d := D.distance(p, w, rules, most)) <= allowed(p)}


RULES = {
    "none": D.Rules(),
    "closed": D.Rules(equivalent=frozenset({("x", "y"), ("y", "x")})),
    "one way": D.Rules(equivalent=frozenset({("x", "y"), ("y", "z")})),
    "pairs": D.Rules(short=(("aa", "a", False, False), ("b", "cc", False, False), ("x", "b", True, False))),
    "folding": D.Rules(ignore_diacritics=True, convert_case=True, equivalent=frozenset({("x", "y")})),
}


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("name", RULES)
def test_no_similar_pair_is_missed(spark, name, most):
    draw, rules = random.Random(most), RULES[name]
    letters = "aéAxyY" if name == "folding" else "abcxyz"
    word = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(1, 9)))
    probes, known = {word() for _ in range(60)}, {word() for _ in range(90)}
    probes |= {"aaaaaaaaaaaaaaaa", "bbbbbbbb", "abababababab", "xbbbbbbb"}
    known |= {"aaaaaaaa", "cccccccccccccccc", "acacacacacac", "accaccaccaccaccacc", "bcccccccccccccc"}
    assert pairs_of(spark, probes, known, most, rules) == plain_pairs(probes, known, most, rules)


def most_shuffled(spark, seen):
    """The most rows that a stage has shuffled, of those that ``seen`` lacks, which gets them."""
    jvm, none = spark._jvm, spark._jvm.java.util.ArrayList()
    stages = spark._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    new = {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size())) if s.stageId() not in seen}
    seen.update(new)
    return max(new.values(), default=0)


@pytest.mark.parametrize("name", ["none", "closed"])
def test_two_edits_are_met_in_passes(spark, name, monkeypatch):
    """All keys of both sides were shuffled at once before."""
    draw, rules, limit, seen = random.Random(7), RULES[name], 800, set()
    word = lambda: "".join(draw.choice("abcdexy") for _ in range(draw.randint(1, 9)))
    known, probes = {word(): draw.randint(0, 25) for _ in range(200)}, {word() for _ in range(150)} | {"abababababab", "a", "xy"}
    for n, value in (("KEYS", limit), ("KEYS_PER_WORD", 0), ("release", lambda spark: None)):
        monkeypatch.setattr(S, n, value, raising=False)
    lex = L.Lexicon.compile(spark.createDataFrame([(w, w, chr(65 + f)) for w, f in known.items()], "base string, inflected string, tag string"), PLAIN.with_(frequency_included=True, equivalent_chars=tuple(rules.equivalent)))
    most_shuffled(spark, seen)
    got = {(r.probe, r.suggestion): (r.distance, r.score, r.rank) for r in S.suggestions(words_of(spark, sorted(probes)), lex, most=2).collect()}
    assert 0 < most_shuffled(spark, seen) <= 1.5 * limit  # the parts of a length are about even
    want = {p: sorted((d * 26 + 25 - known[w], w, d) for q, w, d in plain_pairs({p}, known, 2, rules)) for p in probes - set(known)}
    assert got == {(p, w): (d, score, i) for p, found in want.items() for i, (score, w, d) in enumerate(found, 1)} and len(got) > 500


def test_equivalents_and_pairs_in_any_number(spark):
    """Eight equal characters, ten of them, and eight rewrites were lost before."""
    m = PLAIN.with_(equivalent_chars=(("x", "ź"),))
    known = ["ź" * n for n in (6, 8, 10, 24)]
    lex = L.Lexicon.compile(spark.createDataFrame([(w, w, None) for w in known], "base string, inflected string, tag string"), m)
    got = S.suggestions(words_of(spark, ["x" * n for n in (6, 8, 10, 24)]), lex).where("distance = 0").collect()
    assert sorted((len(r.probe), r.suggestion) for r in got) == [(len(w), w) for w in known]
    rules = D.Rules(short=(("ll", "l", False, False),))
    assert ("ll" * 8, "l" * 8, 0) in pairs_of(spark, ["ll" * 8], ["l" * 8, "m" * 8], 1, rules)
    assert D.choices("ll" * 8, rules.short) > S.FORMS and len(D.variants("llall", rules.short)) == 4


@pytest.mark.parametrize("pairs", [(), (("ll", "l"), ("g", "tion"))])
@pytest.mark.parametrize("most", [1, 3])
def test_suggestions_broadcast_no_words(spark, pairs, most):
    """Files of a million words are small enough for Spark to broadcast them, which the driver's memory isn't."""
    rows = spark.createDataFrame([(w, w, "A") for w in ("ball", "bale", "station")], "base string, inflected string, tag string")
    lex = L.Lexicon.compile(rows, PLAIN.with_(frequency_included=True, replacement_pairs=pairs))
    found = S.suggestions(words_of(spark, ["bal", "balll", "stag"]), lex, most)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {("bal", "ball", 1), ("bal", "bale", 1)} <= {(r.probe, r.suggestion, r.distance) for r in found.collect()}


def test_pieces_survive_the_edits():
    draw = random.Random(9)
    for _ in range(3000):
        most = draw.choice([1, 2, 3, 4])
        w = [draw.choice("abc") for _ in range(draw.randint(0, 12))]
        v = list(w)
        for _ in range(most):
            kind, i = draw.choice("irds"), draw.randrange(len(v) + 1)
            if kind == "i":
                v.insert(i, draw.choice("abc"))
            elif i < len(v) and kind == "r":
                v[i] = draw.choice("abc")
            elif i < len(v) and kind == "d":
                del v[i]
            elif i + 1 < len(v):
                v[i], v[i + 1] = v[i + 1], v[i]
        a, b = "".join(w), "".join(v)
        if D.distance(a, b) <= most:
            assert D.probing_keys(a, most) & D.stored_keys(b, most), (a, b, most)


def test_collapsed_forms_change_little():
    rules = RULES["pairs"]
    draw = random.Random(4)
    for _ in range(2000):
        w = "".join(draw.choice("abcxm") for _ in range(draw.randint(0, 8)))
        v = draw.choice(D.variants(w, rules.short))
        assert rules.collapsed(w) == rules.collapsed(v)
        i = draw.randrange(len(w) + 1)
        near = draw.choice([w[:i] + "m" + w[i:], w[:i] + w[i + 1 :], w[:i] + "a" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]])
        assert D.distance(rules.collapsed(w), rules.collapsed(near)) <= 2


def test_ties_in_the_order_of_the_walk(spark):
    """The bytes of the dictionary's charset order words that are found alike."""
    words = ["kot\u00e4", "kot\u017c", "kotz", "kot"]
    rows = spark.createDataFrame([(w, w, None) for w in words], "base string, inflected string, tag string")
    for charset, order in (("utf-8", [3, 2, 0, 1]), ("iso8859-2", [3, 2, 1, 0])):
        lex = L.Lexicon.compile(rows, PLAIN.with_(encoding=charset))
        assert [r.suggestion for r in S.suggestions(words_of(spark, ["kotq"]), lex).orderBy("rank").collect()] == [words[i] for i in order]


# --- automata -----------------------------------------------------------------------------------------------------


def plain_match(probe, stored):
    size = max((n for s in stored for n in range(min(len(s), len(probe)) + 1) if s[:n] == probe[:n]), default=0)
    return (0, 0) if probe in stored else (-4, 0) if size == len(probe) else (-3, size) if size else (-1, 0)


def test_matches_by_neighbours(spark):
    draw = random.Random(6)
    word = lambda: bytes(draw.choice(b"\x00ab\xff") for _ in range(draw.randint(1, 6)))
    stored = {word() for _ in range(80)}
    probes = {word() for _ in range(200)} | stored | {b""}
    s = spark.createDataFrame([(bytearray(x),) for x in stored], "seq binary")
    p = spark.createDataFrame([(bytearray(x),) for x in probes], "probe binary")
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            assert {bytes(r.probe): (r.kind, r["index"]) for r in A.matched(p, s).collect()} == {x: plain_match(x, stored) for x in probes}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.kind for r in A.matched(p.where("octet_length(probe) > 0"), s.limit(0)).collect()} == {-1}


def test_states_are_right_languages(spark):
    draw = random.Random(8)
    stored = {"".join(draw.choice("abc") for _ in range(draw.randint(1, 7))) for _ in range(150)}
    languages = {}
    for p in {w[:n] for w in stored for n in range(len(w))}:
        languages.setdefault(frozenset(w[len(p) :] for w in stored if w.startswith(p) and w != p), []).append(p)
    s = A.sequences(words_of(spark, sorted(stored)), "word")
    assert {(bytes(r.name).decode(), r["count"]) for r in A.states(s).collect()} == {(min(ps), len(x)) for x, ps in languages.items()}
    name = {p: min(ps) for ps in languages.values() for p in ps}
    arcs = {(name[w[:n]], w[n], name.get(w[: n + 1])) for w in stored for n in range(len(w)) if name[w[:n]] == w[:n]}
    got = {(bytes(r.src).decode(), bytes(r.label).decode(), bytes(r.dst).decode() if r.dst is not None else None) for r in A.merged_arcs(s).collect()}
    assert got == arcs and A.totals(s).first().arcs == len(arcs) + 1


def test_long_sequences(spark):
    """Lines of 10,000 bytes: rows of one size for each byte, and a name only for what is shown."""
    lines = [bytes([97 + k]) * 5_000 + b"x" * 5_000 for k in range(4)]
    t = A.totals(spark.createDataFrame([(bytearray(x),) for x in lines], "seq binary")).first()
    assert (t.longest, t.tree_arcs, t.nodes, t.arcs) == (10_000, 40_000, 1 + 4 * 4_999 + 5_000 + 1, 4 * 5_000 + 5_000 + 1)


def test_part_hashes():
    seqs = [b"abab", b"b", b"ab", b"xabab"]
    depth, p1, p2, q1, q2, s1, s2, last = part_hashes(seqs)
    parts, i = {}, 0
    for s in seqs:
        for d in range(len(s)):
            for x, h in ((s[:d], (p1[i], p2[i])), (s[: d + 1], (q1[i], q2[i])), (s[d:], (s1[i], s2[i]))):
                assert parts.setdefault(x, h) == h
            assert depth[i] == d and last[i] == (d == len(s) - 1)
            i += 1
    assert len(set(parts.values())) == len(parts)


# --- dictionaries -------------------------------------------------------------------------------------------------


@pytest.fixture
def shuffled(spark):
    """No side of a join is broadcast, and files are read in parts."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "0"}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k in held:
        spark.conf.unset(k)


def test_lines_in_input_order(spark, shuffled, tmp_path):
    draw = random.Random(1)
    entries = [(f"b{k}", f"w{k}", t) for k in range(0, 300, 2) for t in ("B", "A")]
    L.Lexicon.compile(spark.createDataFrame(entries, "base string, inflected string, tag string"), PLAIN).write(str(tmp_path / "d.dict"))
    asked = [f"w{draw.randrange(300)}" for _ in range(3000)]
    (tmp_path / "in.txt").write_text("\n".join(asked) + "\n\n")
    want = [line for w in asked for line in ([f"{w} => b{w[1:]} A", f"{w} => b{w[1:]} B"] if int(w[1:]) % 2 == 0 else [f"{w} => [not found]"])]
    found = tools.apply_dict(spark, str(tmp_path / "d.dict"), str(tmp_path / "in.txt"))
    assert [r[0] for r in found.toLocalIterator()] == want
    assert [r.line for r in store.numbered(found, "place").orderBy("place").collect()] == want
    with open(tmp_path / "in.txt", "rb") as stream:
        assert list(tools.apply_stream(spark, str(tmp_path / "d.dict"), stream, batch=700)) == want


def test_buckets_spare_the_dictionary_a_shuffle(spark, shuffled, tmp_path):
    entries = [(f"b{k}", f"w{k}", "t") for k in range(200)]
    lex = L.Lexicon.compile(spark.createDataFrame(entries, "base string, inflected string, tag string"), PLAIN)
    lex.save_buckets(str(tmp_path / "lex"), 4)
    with pytest.raises(L.SourceError, match="exists"):
        lex.save_buckets(str(tmp_path / "lex"), 4)
    back = L.Lexicon.load_buckets(spark, str(tmp_path / "lex"), 4)
    found = L.lookup(words_of(spark, ["w1", "w199", "none"]), back, how="left")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("w1", "b1", "t"), ("w199", "b199", "t"), ("none", None, None)], key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan.splitlines()[[i for i, x in enumerate(plan.splitlines()) if "Scan parquet" in x][0]]
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1 and "Bucketed: true" in scan and "struct<word:string,stem:string,tag:string>" in scan


def test_look_up_reads_three_columns(spark):
    lex = L.Lexicon.compile(spark.createDataFrame([("b", "w", "t"), ("", "v", None)], "base string, inflected string, tag string"), PLAIN)
    plan = L.lookup(words_of(spark, ["w"]), lex)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<word:string,base:string,tag:string>" in plan


def test_results_replace_columns_of_their_names(spark):
    lex = L.Lexicon.compile(spark.createDataFrame([("b", "w", "A")], "base string, inflected string, tag string"), PLAIN.with_(frequency_included=True))
    asked = spark.createDataFrame([("w", 1, 2, 3, 4, 5)], "word string, Stem int, tag int, _word int, _k int, frequency int")
    r = L.lookup(asked, lex).first()
    assert (r.word, r.stem, r.tag, r._word, r._k) == ("w", "b", "A", 3, 4) and len(r) == 6
    assert L.frequencies(asked, lex).first().frequency == 0 and S.with_membership(asked, lex).first().in_dictionary


def test_a_write_that_no_one_else_sees_is_an_error(tmp_path):
    from lexspark.sources.datasource import FsaWriter, Written

    with pytest.raises(ValueError, match="share"):
        FsaWriter(str(tmp_path), "fsa5", False, False).commit([Written(f"{tmp_path}/_gone", f"{tmp_path}/part-gone.fsa5"), None])


def test_rows_that_could_not_come_back(spark):
    rows = [("a+b", "c", None), ("a", "c+d", "t"), ("a", "c", "t+u"), (None, "c", "t"), ("a+b", "c", None)]
    got = L.unsafe_rows(spark.createDataFrame(rows, "base string, inflected string, tag string"), PLAIN)
    assert sorted(tuple(r)[:2] for r in got.collect()) == [("a", "c+d"), ("a+b", "c")]


@pytest.mark.parametrize(("charset", "separator"), [("shift_jis", "|"), ("gb18030", "+"), ("big5", "+"), ("euc_jp", "+")])
def test_charsets_of_several_bytes(spark, tmp_path, charset, separator):
    assert charsets.several_bytes(charset) and not charsets.several_bytes("iso8859-2") and not charsets.several_bytes("utf-8")
    m = PLAIN.with_(encoding=charset, separator=separator, encoder="prefix")
    words = ["日本", "日本人", "人", "ab", "a\nb"] + (["ポット"] if charset == "shift_jis" else [])
    lex = L.Lexicon.compile(spark.createDataFrame([(w[:1], w, "t") for w in words[:4]], "base string, inflected string, tag string"), m)
    lex.write(str(tmp_path / "d.dict"))
    back = L.Lexicon.read(spark, str(tmp_path / "d.dict"))
    want = [(w, w[:1], "t") for w in words[:4]]
    assert sorted(map(tuple, back.scan().collect())) == sorted(want)
    # a byte of ポ is the separator of Shift-JIS here; a word of another script isn't in the charset
    asked = words_of(spark, [*words, "żółw" if charset != "gb18030" else "x", None])
    assert sorted(map(tuple, L.lookup(asked, back).collect())) == sorted(want)
    assert sorted(r[0] for r in back.decompile().collect()) == sorted(f"{w[:1]}{separator}{w}{separator}t" for w in words[:4])
    if charset == "shift_jis":
        assert L.unsafe_rows(spark.createDataFrame([("ポ", "人", None)], "base string, inflected string, tag string"), m).count() == 1


def test_codecs_on_odd_values():
    for name in ("gb18030", "shift_jis"):
        texts = ["a", None, "b\nc", "", "日", "🙂" if name == "shift_jis" else "x"]
        assert charsets.encoded(texts, name) == [None if t is None else t.encode(name, "replace") for t in texts]
        data = [b"a", None, b"\x81", b"", "日\n".encode(name)]
        assert charsets.decoded(data, name) == [None if b is None else b.decode(name, "replace") for b in data]
    assert charsets.codable(["a", None, "🙂"], "shift_jis") == [True, None, False] and charsets.known([b"\x81", None, b"a"], "shift_jis") == [False, None, True]


# --- streams ------------------------------------------------------------------------------------------------------


def test_unknown_words_go_on_after_a_restart(spark, tmp_path):
    lex = L.Lexicon.compile(spark.createDataFrame([("known", "known", None)], "base string, inflected string, tag string"), PLAIN)
    schema = "id long, time timestamp, text string"
    stamp = lambda hour, minute: f"2024-01-01 {hour:02}:{minute:02}:00"
    parts = [
        [(1, stamp(1, 5), "known new, words"), (2, stamp(1, 10), "odd"), (1, stamp(1, 5), "known new, words")],
        [(3, stamp(2, 0), "more"), (2, stamp(1, 10), "odd"), (4, stamp(1, 59), "late but counted")],
        [(5, stamp(9, 0), "known")],
        [(6, stamp(1, 0), "far too late"), (7, stamp(9, 1), None), (8, stamp(9, 2), "End")],
    ]
    for rows in parts:  # each run takes up what the one before has left
        spark.createDataFrame(rows, "id long, time string, text string").selectExpr("id", "to_timestamp(time) AS time", "text").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        unknown.count_unknown(stream, lex, ("id",), str(tmp_path / "out"), str(tmp_path / "state"), delay="2 hours").awaitTermination()
    got = {(r.start.hour, r.words) for r in unknown.unknown_counts(spark, str(tmp_path / "out")).select(F.col("start")).join(unknown.unknown_counts(spark, str(tmp_path / "out")), "start").collect()}
    assert {w for _, w in got} == {6, 1} and len(got) == 3


def test_lines_keep_their_place(spark, shuffled, tmp_path):
    lines = [f"{k} {'x' * (k % 50)}" for k in range(1500)]
    (tmp_path / "f").write_text("\n".join(lines))
    rows = readers.read_lines(spark, str(tmp_path / "f"), placed=True)
    assert rows.rdd.getNumPartitions() > 3
    assert [bytes(r.line).decode() for r in rows.orderBy(F.rand(1)).orderBy(*readers.PLACE).collect()] == lines
