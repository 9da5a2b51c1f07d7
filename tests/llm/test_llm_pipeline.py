import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexspark.llm import common, quality

#: Columns as the stages name their own, and names that need quoting.
CLASHES = ("score", "predicted", "_bad", "_gone", "bad_id", "bad_tid", "own_id", "own_tid", "a.b", "with `tick`", "x0", "copies")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Odd rows among documents, a benchmark and labels."""
    draw = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(f"item{i}" for i in range(16))
    texts = [" ".join(draw.choice(words) for _ in range(60)) for _ in range(60)]
    texts += [texts[0], texts[1] + " more", texts[2] + " " + passage + " " + texts[3], *("BUY!! ### " * 20 for _ in range(10))]
    rows = [(i, t, "en", draw.choice(["s1", "s2", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(None, texts[4], None, None, None), (None, None, None, None, None), (200, "", "en", "s1", 0), (201, " ", None, "s2", 1), (5, texts[5], "en", "s1", 1), (5, texts[5], "en", "s1", 1), (202, "word " * 50_000, "en", "s1", 1)]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(k))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 63), 0) for i in range(73)] + [(None, 1, 0), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, passage


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_take_any_columns_and_rows(spark, tables):
    folder, rows, passage = tables
    docs, before = spark.read.parquet(f"{folder}/documents.parquet"), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
            assert set(values(out)) <= set(values(docs)), name  # the documents' own columns, as they were
        before, docs = docs, out
    assert docs.count() == before.count() and set(CLASHES) <= set(docs.columns)


def test_each_stage_decides(spark, tables):
    folder, rows, passage = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by = dict(corpus_pipeline.STAGES)
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = sorted((r[:5] for r in rows if model.score(r[1]) >= quality.CUT), key=repr)
    assert [r[:5] for r in values(by["quality"](spark, docs, folder))] == want and len(want) < len(rows)
    kept = by["near copies"](spark, docs, folder)
    assert kept.where(F.col("text") == rows[0][1]).count() == 1 and kept.where("doc_id = 61").count() == 0 and kept.where("doc_id = 5").count() == 1
    clean = by["decontamination"](spark, docs, folder)
    assert values(clean.select("doc_id", "text")) == sorted((r[:2] for r in rows if passage not in (r[1] or "")), key=repr)


def test_empty_tables(spark, tables, tmp_path):
    folder = tables[0]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.keep_good(spark, docs, str(tmp_path)).count() == docs.count()  # nothing learned, nothing rejected
    assert corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).count() == docs.count()


def test_spent_tables_go(spark, tables, monkeypatch):
    removed = []
    monkeypatch.setattr(corpus_pipeline, "remove", lambda s, path: removed.append(path[-2:]) or real(s, path))
    real = common.remove
    n = corpus_pipeline.run(spark, tables[0]).count()
    assert n > 0 and removed == ["/0", "/1", "/2"]
