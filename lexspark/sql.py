"""SQL names for a session: the data source, functions, and a dictionary as views.

After ``register(spark, lexicon, "pl")``: ``lex_encode('suffix', source, target)``, ``lex_decode``, ``lex_distance(a, b)``
the views ``pl_entries`` (word, stem, tag) and ``pl_words``, which SQL joins like any other table, and the table function
``pl_lookup(word)``, as in ``SELECT * FROM t, LATERAL pl_lookup(t.w)``, which Spark turns into such a join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.distance import distance
from .functions.encoders import BY_NAME
from .operators.lexicon import Lexicon
from .sources.datasource import FsaDataSource


def _encode(name: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or t is None else BY_NAME[n].encode_bytes(bytes(s), bytes(t)) for n, s, t in zip(name, source, target, strict=True)])


def _decode(name: pd.Series, source: pd.Series, code: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or c is None else BY_NAME[n].decode_bytes(bytes(s), bytes(c)) for n, s, c in zip(name, source, code, strict=True)])


def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def register(spark: SparkSession, lexicon: Lexicon | None = None, name: str = "lex") -> None:
    spark.dataSource.register(FsaDataSource)
    for sql, f, kind in (("lex_encode", _encode, "binary"), ("lex_decode", _decode, "binary"), ("lex_distance", _distance, "int")):
        spark.udf.register(sql, F.pandas_udf(f, kind))
    if lexicon is not None:
        lexicon.forms.select("word", "stem", "tag").createOrReplaceTempView(f"{name}_entries")
        lexicon.words().createOrReplaceTempView(f"{name}_words")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_lookup(w STRING) RETURNS TABLE (stem STRING, tag STRING) RETURN SELECT stem, tag FROM {name}_entries WHERE word = w")
