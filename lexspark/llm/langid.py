"""Language identification by hierarchical discrimination.

A first set of linear support vector machines predicts the family of a text, a second set tells the languages of that
family apart; in both, one machine stands between any two classes. Features are hashed one- to three-letter sequences.

Style: Arrow maps around numpy. Hashing every letter sequence of a text is array work. Documents are handled on their
own; the models are a few weight vectors of fixed size, so the prediction has no shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import draw, drawn_below, held_out, is_training, named, slices, table

# Families of languages by their usual codes. A code that isn't here makes up a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "iranian": ("fa", "ku", "ps"),
    "indic": ("hi", "bn", "ur", "mr", "pa", "gu", "ne"),
    "semitic": ("ar", "he", "mt"),
}
DIMENSIONS = 4096
_CHUNK = 1_000_000
_letters: np.ndarray | None = None


def family(language: str) -> str:
    return next((f for f, codes in FAMILIES.items() if language in codes), language)


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def features(text: str) -> np.ndarray | None:
    """Square roots of the shares of hashed letter sequences, or None for a text without a letter."""
    counts, letters, seen = np.zeros(DIMENSIONS), _is_letter(), False
    for k in range(0, len(text), _CHUNK):
        part = text[max(0, k - 2) : k + _CHUNK].lower()
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        known = letters[code]
        if not known.any():
            continue
        seen = True
        code = np.where(known, code, 32)
        known[1:] |= known[:-1].copy()  # of other characters, one stays after each word
        c = np.concatenate(([32], code[known])).astype(np.uint32)
        pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        triple = pair[:-1] * np.uint32(0x85EBCA6B) + c[2:]
        for h in (c, pair, triple):
            counts += np.bincount((h * np.uint32(0xC2B2AE35)) >> np.uint32(20), minlength=DIMENSIONS)
    return np.sqrt(counts / counts.sum()).astype(np.float32) if seen else None


@dataclass(frozen=True)
class Machine:
    """One linear machine: positive margins stand for ``first``."""

    first: str
    second: str
    weights: np.ndarray
    bias: float


def train_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Squared hinge loss with both classes weighed alike, minimised by accelerated gradient steps. y is 1 or -1.

    Where there are fewer rows than features, the weights are kept as sums of rows, and all steps go by the products of
    rows, which are worked out once.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    few = len(x) < x.shape[1]
    rows = x @ x.T if few else None
    w = v = np.zeros(len(x) if few else x.shape[1])
    step = 1 / (4 + penalty)
    for k in range(rounds):
        pull = 2 * share * y * np.maximum(0, 1 - y * ((rows if few else x) @ v))
        new = v - step * (penalty * v - (pull if few else x.T @ pull))
        v = new + (k / (k + 3)) * (new - w)
        w = new
    if few:
        w = x.T @ w
    return w[:-1], float(w[-1])


def train_all(x: np.ndarray, labels: list[str]) -> list[Machine]:
    labels_ = np.array(labels)
    out = []
    for a, b in combinations(sorted(set(labels)), 2):
        rows = (labels_ == a) | (labels_ == b)
        out.append(Machine(a, b, *train_machine(x[rows], np.where(labels_[rows] == a, 1.0, -1.0))))
    return out


def decide(classes: list[str], machines: list[Machine], x: np.ndarray) -> tuple[str, float]:
    """The class with most wins, margins breaking ties, and how sure the machine against the next one is."""
    if len(classes) == 1:
        return classes[0], 1.0
    wins, margin, between = dict.fromkeys(classes, 0), dict.fromkeys(classes, 0.0), {}
    for m in machines:
        d = float(x @ m.weights + m.bias)
        wins[m.first if d >= 0 else m.second] += 1
        margin[m.first] += d
        margin[m.second] -= d
        between[m.first, m.second] = d
        between[m.second, m.first] = -d
    best, second = sorted(classes, key=lambda c: (-wins[c], -margin[c], c))[:2]
    return best, 1 / (1 + np.exp(-2 * between[best, second]))


@dataclass(frozen=True)
class Model:
    families: list[str]
    languages: dict[str, list[str]]
    top: list[Machine]
    below: dict[str, list[Machine]]

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text) if text and self.families else None
        if x is None:
            return "und", 0.0
        f, p = decide(self.families, self.top, x)
        language, q = decide(self.languages[f], self.below[f], x)
        return language, float(p * q)


def sampled(docs: DataFrame, per_language: int, languages: int) -> DataFrame | None:
    """Rows ``(id, text, lang)`` to learn from: ``per_language`` at most of each of the commonest ``languages``.

    Those with the smallest hashes are taken; rows that repeat id, text and language count once.
    """
    known = docs.where(is_training(F.col("id")) & F.col("lang").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return None
    h = draw("id", F.lit("langid"))
    limit = F.create_map(*(F.lit(v) for k, n in sorted(counts.items()) for v in (k, drawn_below(2 * per_language + 100, n))))
    near = known.where(h < limit[F.col("lang")]).distinct()
    order = Window.partitionBy("lang").orderBy(h, "id", F.xxhash64("text"))
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language).drop("_n")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, languages: int = 64) -> Model:
    """Trains on a bounded sample of the training fold: ``per_language`` documents of each of ``languages``; whole texts.

    Values of ``lang`` beyond the commonest ``languages`` (junk, usually) are not learned, so the machines, one between
    any two languages of a family, are bounded as well.
    """
    slim = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), named(lang_col).alias("lang"))
    rows = sampled(slim, per_language, languages)
    if rows is None:
        return Model([], {}, [], {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [(i, t, features(x)) for i, t, x in zip(*(b.column(c).to_pylist() for c in ("id", "lang", "text")), strict=True) if x]
            found = [x for x in found if x[2] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([str(x[0]) for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2].tobytes() for x in found], pa.binary())], ["id", "lang", "x"])

    got = sorted(map(tuple, rows.mapInArrow(run, "id string, lang string, x binary").collect()))
    if not got:
        return Model([], {}, [], {})
    labels, x = [r[1] for r in got], np.stack([np.frombuffer(r[2], np.float32) for r in got])
    kin = [family(v) for v in labels]
    languages = {f: sorted({v for v in labels if family(v) == f}) for f in sorted(set(kin))}
    below = {}
    for f in languages:
        own = np.array([k == f for k in kin])
        below[f] = train_all(x[own], [v for v in labels if family(v) == f])
    return Model(sorted(languages), languages, train_all(x, kin), below)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row.

    A text that is null or has no letter gets ``und`` and 0, as does every text when nothing could be learned (an
    empty table, no known language). Null ids and repeated rows stay as they are; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            said = [model.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], ["id", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
