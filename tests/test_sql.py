from lexspark.operators.lexicon import Lexicon
from lexspark.sources import readers
from lexspark.sources.metadata import Metadata
from lexspark.sql import register


def test_sql_names(spark, tmp_path):
    lex = Lexicon.compile(spark.createDataFrame([("jawa", "jawie", "t")], "base string, inflected string, tag string"), Metadata("+", "suffix", "utf-8"))
    register(spark, lex, "pl")
    assert spark.sql("SELECT stem, tag FROM VALUES ('jawie'), ('x') AS p(word) JOIN pl_entries USING (word)").collect()[0][:] == ("jawa", "t")
    r = spark.sql("SELECT lex_encode('infix', CAST('ayz' AS BINARY), CAST('abc' AS BINARY)), lex_decode('prefix', CAST('abc' AS BINARY), CAST('ADxyz' AS BINARY)), lex_distance('abka', 'abakan'), lex_distance(NULL, 'a')").first()
    assert (bytes(r[0]), bytes(r[1]), r[2], r[3]) == (b"AACbc", b"xyz", 2, None)
    assert [tuple(r) for r in spark.sql("SELECT word, stem, tag FROM VALUES ('jawie'), ('x') AS p(word), LATERAL pl_lookup(p.word)").collect()] == [("jawie", "jawa", "t")]
    readers.write_fsa(lex.seqs, str(tmp_path / "x.fsa"))
    assert spark.read.format("fsa").load(str(tmp_path / "x.fsa")).count() == 1
    assert spark.read.format("fsa").option("expectVersion", "5").load(str(tmp_path)).count() == 1
