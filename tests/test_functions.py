import random

import pytest

from lexspark.functions import encoders as E
from lexspark.functions.distance import Rules, deletions, distance, distances, rewritten, variants
from lexspark.sources import metadata as M

BASE = {"separator": "+", "encoder": "suffix", "encoding": "utf-8"}


@pytest.mark.parametrize("name", E.BY_NAME)
def test_encoders_are_undone(name):
    e, draw = E.BY_NAME[name], random.Random(5)
    fixed = [("", ""), ("abc", "ade"), ("ade", "abc"), ("abc", "abcd"), ("abcd", "abc"), ("postmodernizm", "modernizm"), ("Niemcami", "Niemiec"), ("Niemiec", "Niemcami"), ("laquelle", "lequel"), ("x" * 300, "xx"), ("ab" * 200, "b" * 300)]
    rows = [(a.encode(), b.encode()) for a, b in fixed]
    rows += [tuple(bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 9))) for _ in "st") for _ in range(10_000)]
    for s, t in rows:
        code = e.encode_bytes(s, t)
        assert len(code) >= e.header and e.decode_bytes(s, code) == t


@pytest.mark.parametrize(("name", "source", "target", "code"), [
    ("infix", "ayz", "abc", "AACbc"), ("infix", "aillent", "aller", "BBCr"), ("prefix", "abc", "abcd", "AAd"), ("prefix", "abc", "xyz", "ADxyz"),
    ("prefix", "postmodernizm", "modernizm", "EA"), ("infix", "laquelle", "lequel", "AGAquel"), ("suffix", "ab", "ab", "A"),
])
def test_documented_codes(name, source, target, code):
    assert E.BY_NAME[name].encode_bytes(source.encode(), target.encode()) == code.encode()


def test_suffix_columns_equal_bytes(spark):
    from pyspark.sql import functions as F

    rows = [(b"abc", b"abd"), (b"", b"x"), (b"x", b""), (b"a" * 260, b"b"), ("łódź".encode(), "łodzi".encode()), (b"same", b"same")]
    df = spark.createDataFrame(rows, "s binary, t binary").withColumn("c", E.suffix_code(F.col("s"), F.col("t"))).withColumn("d", E.suffix_decoded(F.col("s"), F.col("c")))
    for r in df.collect():
        assert bytes(r.c) == E.encode_suffix(bytes(r.s), bytes(r.t)) and bytes(r.d) == bytes(r.t)


@pytest.mark.parametrize(("a", "b", "d"), [("recoginze", "recognize", 1), ("sailn", "failing", 3), ("abc", "abcd", 1), ("abc", "abcde", 2), ("abka", "abaka", 1), ("abka", "abakan", 2), ("abka", "abaki", 2), ("", "ab", 2)])
def test_distances(a, b, d):
    assert distance(a, b) == d
    assert distance(a, b, limit=d - 1) == d


def test_neighbourhoods_are_complete():
    draw = random.Random(2)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 6))) for _ in range(150)]
    for most in (1, 2, 3):
        for p in words[:40]:
            for w in words:
                if distance(p, w, limit=most) <= most:
                    assert deletions(p, most) & deletions(w, most), (p, w)


def ranked(words, probe, metadata, most, freq=None):
    rules, best = Rules.of(metadata), {}
    for k, form in enumerate(rewritten(probe, rules.long)[:14]):
        limit = len(form) - 1 if len(form) <= most else most
        for w in words:
            d = distance(form, w, rules, limit)
            if d <= limit:
                score = d * 26 + 25 - (freq or {}).get(w, 0)
                if w not in best or score < best[w][0]:
                    best[w] = (score, k, w)
    return [w for _, _, w in sorted(best.values()) if w != probe]


PAIRS = M.Metadata(**BASE, replacement_pairs=(("s", "ss"), ("t", "d"), ("R", "Rh"), ("y", "ij"), ("ę", "em"), ("em", "ę")))
WORDS = "Mitmuss Rhythmus Wald Band ijo ijond youd ijoussud ijoussuud ijussuud ijousod ij Ciarkę Czarkę Clarke Clarkiem Clarkom".split()


@pytest.mark.parametrize(("probe", "first"), [
    ("Rytmus", "Rhythmus Mitmuss"), ("Walt", "Wald Band"), ("yout", "youd ijond ijo"), ("yousut", "ijoussud ijousod ijoussuud youd"), ("yo", "ijo ij"), ("Clarkem", "Ciarkę Clarke Clarkiem Clarkom Czarkę"),
])
def test_order_with_rewrite_pairs(probe, first):
    assert ranked(WORDS, probe, PAIRS, 3)[: len(first.split())] == first.split()


def test_reciprocal_pairs_cost_something():
    m = M.Metadata(**BASE, replacement_pairs=(("s", "ss"), ("ss", "s")))
    assert [distance("pissara", w, Rules.of(m)) for w in ("pissarra", "passara", "passarà")] == [1, 1, 1]


def test_anchors_and_spaces():
    m = M.from_properties({"fsa.dict." + k: v for k, v in {"separator": "+", "encoder": "suffix", "encoding": "utf-8", "speller.replacement-pairs": "^Ij IJ, ^alot a_lot, ^påny$ på_ny"}.items()})
    rules = Rules.of(m)
    assert "IJsland" in variants("Ijsland", rules.short) and "BIJ" not in variants("BIj", rules.short)
    assert rewritten("alot", rules.long) == ["alot", "a lot"] and rewritten("påny", rules.long) == ["påny", "på ny"] and rewritten("pånyx", rules.long) == ["pånyx"]


def test_long_rewrites():
    assert set(rewritten("teached", (("teached", "taught", False, False), ("t", "tgh", False, False)))) == {"teached", "taught"}


def test_properties_and_their_escapes():
    text = "# c\n! c\nfsa.dict.separator=\\t\nfsa.dict.encoding : UTF-8\nfsa.dict.encoder Prefix\nfsa.dict.input-conversion=\\\\a \\u0105, krowa Rzecz\nfsa.dict.author=a \\\n  b\n"
    m = M.read_metadata(text.encode())
    assert (m.separator, m.encoder, m.input_conversion, m.author) == ("\t", "prefix", (("\\a", "ą"), ("krowa", "Rzecz")), "a b")
    assert M.read_metadata(M.write_metadata(m)) == m
    assert m.ignore_diacritics and not m.frequency_included and m.separator_byte == b"\t"


@pytest.mark.parametrize(("change", "named"), [
    ({"separator": "ab"}, "separator"), ({"separator": "ł"}, "separator"), ({"encoder": "zip"}, "encoder"), ({"encoding": "no-such"}, "encoding"), ({"speller.runon-words": "maybe"}, "runon-words"),
    ({"uses-infixes": "true"}, "encoder=infix"), ({"colour": "red"}, "colour"), ({"input-conversion": "a b, a c"}, "input-conversion"), ({"equivalent-chars": "x"}, "unknown"), ({"speller.equivalent-chars": "xy z"}, "equivalent-chars"),
])
def test_bad_metadata_is_named(change, named):
    with pytest.raises(M.MetadataError, match=named):
        M.from_properties({"fsa.dict." + k: v for k, v in (BASE | change).items()})


def test_required_metadata():
    with pytest.raises(M.MetadataError, match="encoder"):
        M.from_properties({"fsa.dict.separator": "+", "fsa.dict.encoding": "utf-8"})


def test_metadata_location():
    assert M.metadata_path("/a/b.c/x.dict") == "/a/b.c/x.info" and M.metadata_path("x") == "x.info" and M.metadata_path("hdfs://h/a/x.dict") == "hdfs://h/a/x.info"


def test_distances_of_many_pairs_are_those_of_each():
    draw = random.Random(5)
    both = tuple(p for a, b in ("ab", "cd") for p in ((a, b), (b, a)))
    words = ["", "a", "\U0001f600b", *("".join(draw.choices("abcdeé", k=draw.randint(0, 9))) for _ in range(900))]
    pairs = [(draw.choice(words), draw.choice(words)) for _ in range(4000)]
    pairs += [(w, w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :] + tail) for w in words for i in (0, 3) for tail in ("", "e")]
    for rules in (Rules(), Rules(equivalent=frozenset(both))):
        for limit in (1, 2, 3):
            got = distances([a for a, _ in pairs], [b for _, b in pairs], rules, limit)
            assert got.tolist() == [min(distance(a, b, rules, limit), limit + 1) for a, b in pairs]
