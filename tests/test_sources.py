import io
from concurrent.futures import ThreadPoolExecutor

import pytest

from lexspark import tools
from lexspark.operators.lexicon import Lexicon, Stemmer
from lexspark.sources import formats, readers
from lexspark.sources.datasource import FsaDataSource
from lexspark.sources.metadata import Metadata
from lexspark.streaming import apply as streaming

INFO = "fsa.dict.separator=;\nfsa.dict.encoder=prefix\nfsa.dict.encoding=UTF-8\n"
ROWS = "jawa;jawy;subst:pl:acc:f\njawa;jawie;subst:sg:dat:f\njaźń;jaźnie;x\n"


@pytest.fixture
def source(tmp_path):
    (tmp_path / "d.info").write_text(INFO)
    (tmp_path / "d.input").write_text(ROWS)
    return tmp_path


@pytest.mark.parametrize(("data", "option"), [(b"\xef\xbb\xbfa\nb\n", "accept_bom"), (b"a\r\nb\n", "accept_cr"), (b"a\n\nb\n", "ignore_empty")])
def test_lines_must_be_asked_for(spark, tmp_path, data, option):
    path = tmp_path / "x.txt"
    path.write_bytes(data)
    with pytest.raises(Exception, match=option):
        readers.read_lines(spark, str(path)).collect()
    got = sorted(bytes(r.line).rstrip(b"\r") for r in readers.read_lines(spark, str(path), **{option: True}).collect())
    assert got == [b"a", b"b"]
    v = readers.line_violations(spark, str(path)).first()
    assert (v.has_bom, v.cr_lines, v.empty_lines) == (option == "accept_bom", int(option == "accept_cr"), int(option == "ignore_empty"))


@pytest.mark.parametrize("version", ["fsa5", "cfsa2"])
def test_automaton_files(spark, tmp_path, version):
    path = str(tmp_path / "a.fsa")
    seqs = spark.createDataFrame([(b"b",), (b"a",), (b"\xff\x00",), (b"a",)], "seq binary")
    readers.write_fsa(seqs, path, version, numbers=True)
    assert sorted(bytes(r.seq) for r in readers.read_fsa(spark, path).collect()) == [b"a", b"b", b"\xff\x00"]
    info = readers.fsa_info(spark, path).first()
    assert info.sequences == 3 and "NUMBERS" in info.flags and info.version == (formats.FSA5 if version == "fsa5" else formats.CFSA2)
    with pytest.raises(Exception, match="not 0xc5"):
        readers.read_fsa(spark, path, expect=formats.CFSA).collect()


def test_sequences_as_lines(spark, tmp_path):
    readers.write_lines(spark.createDataFrame([(b"b",), (b"\xe4",)], "seq binary"), str(tmp_path / "latin"), "iso-8859-1")
    assert (tmp_path / "latin").read_bytes() == b"b\n\xe4\n"
    readers.write_lines(spark.createDataFrame([("ä".encode(),), (b"b",)], "seq binary"), str(tmp_path / "utf"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "utf").glob("part-*"))) == "b\nä\n".encode()


def test_dictionary_files(spark, source):
    lex = Lexicon.compile(spark.createDataFrame([("b", "bs", "t")], "base string, inflected string, tag string"), Metadata("+", "infix", "utf-8"))
    lex.write(str(source / "x.dict"))
    assert [tuple(r) for r in Lexicon.read(spark, str(source / "x.dict")).scan().collect()] == [("bs", "b", "t")]


def test_tools(spark, source, capsys):
    run = lambda *a: tools.main([str(x) for x in a], spark)
    assert run("dict_compile", "-i", source / "d.input") == 0
    assert run("dict_compile", "-i", source / "d.input") == 3
    assert run("dict_compile", "-i", source / "d.input", "--overwrite", "-f", "cfsa2") == 0
    assert run("dict_decompile", "-i", source / "d.dict", "-o", source / "back") == 0
    assert sorted((source / "back").read_text().splitlines()) == sorted(ROWS.splitlines())
    (source / "w.txt").write_text("jawie\n\nnie\n")
    capsys.readouterr()
    assert run("dict_apply", "-d", source / "d.dict", "-i", source / "w.txt") == 0
    assert sorted(capsys.readouterr().out.splitlines()) == ["jawie => jawa subst:sg:dat:f", "nie => [not found]"]
    assert run("fsa_info", "-i", source / "d.dict") == 0 and "sequences: 3" in capsys.readouterr().out
    assert run("fsa_build", "-i", source / "w.txt", "-o", source / "w.fsa") == 1
    assert run("fsa_build", "-i", source / "w.txt", "-o", source / "w.fsa", "--ignore-empty") == 0
    assert run("fsa_dump", "-i", source / "w.fsa", "-o", source / "w.out") == 0 and (source / "w.out").read_text() == "jawie\nnie\n"
    assert run("fsa_dump") == 2 and run("no_such_tool") == 2
    (source / "d.info").write_text("fsa.dict.colour=red\n")
    assert run("dict_compile", "-i", source / "d.input", "--overwrite") == 2


def test_tools_check_their_arguments(spark, source, tmp_path, capsys, monkeypatch):
    run = lambda *a: tools.main([str(x) for x in a], spark)
    assert run("dict_compile", "-i", source / "d.input") == 0
    assert run("fsa_info", "-i", source / "none.dict") == 2 and run("dict_apply", "-d", source / "none.dict", "-i", source / "d.input") == 2
    assert run("fsa_dump", "-i", source / "d.dict", "-o", source / "no folder" / "x") == 2 and not (source / "no folder").exists()
    assert run("dict_apply", "-d", source / "d.dict", "-i", source / "d.input", "--input-charset", "no-such") == 2
    (source / "latin.txt").write_bytes("jaźnie\r\n\r\n\nß\n".encode("iso8859-2"))
    capsys.readouterr()
    assert run("dict_apply", "-d", source / "d.dict", "-i", source / "latin.txt", "--input-charset", "ISO-8859-2") == 0
    assert sorted(capsys.readouterr().out.splitlines()) == ["jaźnie => jaźń x", "ß => [not found]"]
    (source / "bad.txt").write_bytes(b"a\xff\n")
    assert run("dict_apply", "-d", source / "d.dict", "-i", source / "bad.txt") == 1
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO("jawie\n\njaźnie\n".encode())))
    capsys.readouterr()
    assert run("dict_apply", "-d", source / "d.dict", "--skip-tags", "--exit", "false") == 0
    assert sorted(capsys.readouterr().out.splitlines()) == ["jawie => jawa", "jaźnie => jaźń"]
    assert list(tools.apply_stream(spark, str(source / "d.dict"), io.BytesIO(b"jawie\n" * 5), batch=2)) == ["jawie => jawa subst:sg:dat:f"] * 5


def test_decompiled_in_the_charset(spark, source):
    (source / "p.info").write_text(INFO.replace("UTF-8", "iso-8859-2"))
    (source / "p.input").write_bytes(ROWS.encode("iso8859-2"))
    run = lambda *a: tools.main([str(x) for x in a], spark)
    assert run("dict_compile", "-i", source / "p.input") == 0 and run("dict_decompile", "-i", source / "p.dict", "-o", source / "p.back") == 0
    assert sorted((source / "p.back").read_bytes().decode("iso8859-2").splitlines()) == sorted(ROWS.splitlines())


def test_saved_lexicons(spark, source):
    """Parquet keeps what a compiled lexicon has, entries with a separator in them included."""
    rows = [("b", "bs", "t"), ("b", "bs", None), ("", "x", "t"), ("żó", "żółw", "t+u"), ("a+b", "a", "t"), ("a", "a+", ""), (None, "n", "t"), ("n", None, "t")]
    for encoder in ("suffix", "none"):
        lex = Lexicon.compile(spark.createDataFrame(rows * 2, "base string, inflected string, tag string"), Metadata("+", encoder, "utf-8"))
        parsed = Lexicon(lex.seqs, lex.metadata)  # from the bytes alone
        lex.save(str(source / f"{encoder}.parquet"))
        back = Lexicon.load(spark, str(source / f"{encoder}.parquet"))
        whole = lambda x: sorted((tuple(r) for r in x.entries.select("seq", "word", "stem", "tag", "coded", "visible").collect()), key=repr)
        assert whole(lex) == whole(parsed) == whole(back) and back.metadata == lex.metadata
        assert sorted(r.word for r in lex.words().collect()) == sorted(r.word for r in parsed.words().collect())
        with pytest.raises(Exception, match="exists"):
            lex.save(str(source / f"{encoder}.parquet"))


def test_dictionaries_from_streams(spark, source):
    lex = Lexicon.compile(spark.createDataFrame([("b", "bs", "t")], "base string, inflected string, tag string"), Metadata("+", "infix", "utf-8"))
    lex.write(str(source / "s.dict"))
    (source / "s.info").rename(source / "other.properties")
    streams = Lexicon.from_streams(spark, io.BytesIO((source / "s.dict").read_bytes()), io.BytesIO((source / "other.properties").read_bytes()))
    for back in (streams, Lexicon.read(spark, str(source / "s.dict"), str(source / "other.properties"))):
        assert [tuple(r) for r in back.scan().collect()] == [("bs", "b", "t")] and back.metadata == lex.metadata


def test_named_dictionaries(spark, source):
    lex = Lexicon.compile(spark.createDataFrame([("b", "bs", "t")], "base string, inflected string, tag string"), Metadata("+", "suffix", "utf-8"))
    lex.save(str(source / "n.parquet"))
    lex.write(str(source / "m.dict"))
    words = spark.createDataFrame([("bs",), ("c",)], "word string")
    for name in ("n.parquet", "m.dict"):
        Stemmer.register("mine", str(source / name))
        with ThreadPoolExecutor(4) as pool:
            found = list(pool.map(lambda _: Stemmer.named(spark, "mine").lexicon, range(8)))
        assert all(x is found[0] for x in found)
        assert [tuple(r) for r in Stemmer.named(spark, "mine").transform(words).collect()] == [("bs", "b", "t")]
    with pytest.raises(KeyError, match="mine"):
        Stemmer.named(spark, "other")


def test_written_by_the_data_source(spark, tmp_path):
    spark.dataSource.register(FsaDataSource)
    seqs = spark.createDataFrame([(w.encode(),) for w in ("b", "a", "ab", "a", "zz", "é")], "seq binary")
    for version in ("fsa5", "cfsa2"):
        path = str(tmp_path / version)
        seqs.repartition(3, "seq").write.format("fsa").option("version", version).option("numbers", "true").mode("append").save(path)
        back = spark.read.format("fsa").load(path)
        assert sorted(bytes(r.seq).decode() for r in back.collect()) == ["a", "ab", "b", "zz", "é"]
        seqs.coalesce(1).write.format("fsa").option("version", version).mode("overwrite").save(path)
        assert spark.read.format("fsa").load(path).count() == 5 and readers.fsa_info(spark, path + "/part-*").count() == 1
    with pytest.raises(Exception, match="none of"):
        seqs.write.format("fsa").option("version", "x").mode("append").save(str(tmp_path / "x"))


def test_lines_of_large_files_are_read_in_parts(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_bytes(b"".join(b"%d\xff\n" % i for i in range(200_000)) + b"last")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        lines = readers.read_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() > 3
        got = [bytes(r.line) for r in lines.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [b"%d\xff" % i for i in range(200_000)] + [b"last"]


def test_stream_gives_what_a_batch_gives(spark, source, tmp_path):
    lex = Lexicon.compile(spark.createDataFrame([("jawa", "jawie", "t")], "base string, inflected string, tag string"), Metadata("+", "suffix", "utf-8"))
    (source / "in").mkdir()
    for i, text in enumerate(("jawie\nnie\n", "\njawie\n")):
        (source / "in" / f"{i}.txt").write_text(text)
        q = streaming.stream_apply(streaming.words_stream(spark, str(source / "in")), lex, str(source / "out"), str(source / "state"))
        q.awaitTermination()
    assert sorted(r.value for r in spark.read.text(str(source / "out")).collect()) == ["jawie => jawa t", "jawie => jawa t", "nie => [not found]"]


def test_line_violations_hold_lines_only(spark, tmp_path):
    """Files with and without a byte order mark or a last LF, and none of them as a whole in a row."""
    files = {"b": b"\n", "c": b"\xef\xbb\xbf", "d": b"\xef\xbb\xbf\n", "e": b"\xef\xbb\xbf\n\nx\r\n", "f": b"x\r\n\ny", "g": b"\xef\xbb\xbfx\xff\n\xef\xbb\xbf\n", "h": b"x\n\n", "i f": b"\r\r\n\r"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)

    def plain(data):
        parts = data.removesuffix(b"\n").split(b"\n")
        return data.startswith(b"\xef\xbb\xbf"), sum(b"\r" in x for x in parts), sum(not x for x in parts)

    spark.conf.set("spark.sql.files.maxPartitionBytes", "4b")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1")
    try:
        found = {r.path.rsplit("/", 1)[1]: tuple(r)[1:] for r in readers.line_violations(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert found == {n: plain(d) for n, d in files.items()}
