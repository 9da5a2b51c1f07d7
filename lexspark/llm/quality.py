"""Quality classifier: Bradley-Terry ranking.

A document's worth is a linear function of its features. It is learned from preference pairs, a document labelled 1
over one labelled 0, by logistic loss on the difference of their features. The threshold is the quantile of the
scores of all documents that leaves as large a part of them below as the labels call bad, moved to the widest gap
within two standard errors of that part on either side.

Style: Arrow maps around numpy; character-class statistics of whole texts are array work. The model is a vector of
fixed size, so scoring has no shuffle. Training draws a bounded sample of labelled rows; the quantile is an aggregate
over all rows.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import checkpointed, draw, drawn_below, held_out, is_training, named, slices, table

CUT = 0.3
#: Quantiles among which the threshold is placed.
GRID = 201
#: Character classes: lower case, upper case, other letters, digits, blanks, line ends, and groups of signs.
_SIGNS = (".", ",;:", "!", "?", "'\"", "-_", "()[]{}<>", "|", "#$%&*@^~", "+=/\\")
CLASSES = 6 + len(_SIGNS) + 1
_classes: np.ndarray | None = None


def _table() -> np.ndarray:
    global _classes
    if _classes is None:
        kinds = {"Ll": 0, "Lu": 1, "Lt": 1, "Nd": 3, "Zs": 4}
        out = np.full(sys.maxunicode + 1, CLASSES - 1, np.uint8)
        for i in range(sys.maxunicode + 1):
            c = unicodedata.category(chr(i))
            out[i] = kinds.get(c, 2 if c[0] == "L" else CLASSES - 1)
        out[9] = 4
        out[[10, 11, 12, 13]] = 5
        for k, signs in enumerate(_SIGNS):
            out[[ord(s) for s in signs]] = 6 + k
        _classes = out
    return _classes


WORDY = 11
SIZE = CLASSES + CLASSES * CLASSES + WORDY


def features(text: str | None) -> np.ndarray:
    """Shares of character classes and of pairs of them, and statistics of words and lines; zeros for an empty text."""
    out = np.zeros(SIZE)
    if not text:
        return out
    pairs = np.zeros(CLASSES * CLASSES)
    for k in range(0, len(text), 1_000_000):
        code = np.frombuffer(text[max(0, k - 1) : k + 1_000_000].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _table()[code].astype(np.int64)
        pairs += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        out[:CLASSES] += np.bincount(c[1:] if k else c, minlength=CLASSES)
    out[:CLASSES] /= len(text)
    out[CLASSES : CLASSES + CLASSES * CLASSES] = pairs / max(1, len(text) - 1)
    words, lines = text.split(), [x for x in text.splitlines() if x.strip()]
    n = len(words)
    if n:
        count = Counter(words)
        length = sum(map(len, words)) / n
        out[-WORDY:] = (
            np.log1p(n), np.log1p(length), len(count) / n, np.log1p(len(count)) / np.log1p(n), max(count.values()) / n,
            sum(map(str.__eq__, words, words[1:])) / n, sum(map(str.isalpha, words)) / n, sum(map(str.isupper, words)) / n,
            np.log1p(n / len(lines)) if lines else 0, 1 - len(set(lines)) / max(1, len(lines)), sum(map(str.istitle, words)) / n,
        )
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def worth(self, text: str | None) -> float:
        return float(np.clip((features(text) - self.mean) / self.scale, -8, 8) @ self.weights)

    def score(self, text: str | None) -> float:
        """Between 0 and 1; the threshold is at CUT, exactly."""
        return CUT / (CUT + (1 - CUT) * float(np.exp(np.clip(self.threshold - self.worth(text), -500, 500))))

    def score_of(self, worth: Column) -> Column:
        """``score`` of a column that has the worths already."""
        z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.lit(self.threshold) - worth))
        return F.lit(CUT) / (F.lit(CUT) + F.lit(1 - CUT) * F.exp(z))


def train(x: np.ndarray, y: np.ndarray, share_bad: float, pairs: int = 40_000, penalty: float = 1e-3, rounds: int = 400) -> Model:
    """share_bad: part of all labelled documents that has label 0. The threshold is the quantile of these scores, each
    label weighted by its share; ``fit`` replaces it by that of all rows."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = z[y == 1], z[y == 0]
    w = np.zeros(z.shape[1])
    if len(good) and len(bad):
        draw = np.random.default_rng(7)
        i, j = draw.integers(0, len(good), pairs), draw.integers(0, len(bad), pairs)
        # differences of pairs are never held: sums over them come from how often each document is in one
        both = np.zeros((len(good), len(bad)))
        np.add.at(both, (i, j), 1.0)
        mixed = good.T @ both @ bad
        gram = (good.T * both.sum(1)) @ good + (bad.T * both.sum(0)) @ bad - mixed - mixed.T
        step = 4 / (max(0.0, float(np.linalg.eigvalsh(gram)[-1])) / pairs + 4 * penalty)
        v = w
        for k in range(rounds):
            pull = 1 / (1 + np.exp(np.clip((good @ v)[i] - (bad @ v)[j], -500, 500)))
            up, down = np.bincount(i, pull, len(good)), np.bincount(j, pull, len(bad))
            new = v - step * ((bad.T @ down - good.T @ up) / pairs + penalty * v)
            v = new + (k / (k + 3)) * (new - w)
            w = new
    worth = z @ w
    weight = np.where(y == 1, (1 - share_bad) / max(1, (y == 1).sum()), share_bad / max(1, (y == 0).sum()))
    order = np.argsort(worth, kind="stable")
    s, below = worth[order], np.cumsum(weight[order])
    threshold = float(s[0] - 1) if len(s) else 0.0
    if share_bad > 0 and len(s) > 1:
        k = min(len(s) - 2, int(np.searchsorted(below, share_bad)))
        threshold = float((s[k] + s[k + 1]) / 2)
    return Model(mean, scale, w, threshold)


def worths(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, worth)`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([model.worth(t) for t in b.column("text").to_pylist()], pa.float64())], ["id", "worth"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(run, f"id {kind}, worth double")


def quantile(known: DataFrame, model: Model, share: float, error: float = 0.0) -> float:
    """The worth that leaves ``share`` of all rows of ``known`` (worth) below it; each row counts.

    The share is known to ``error`` only. Of the quantiles up to that much smaller or larger, the middle of the widest
    gap between neighbours is taken.
    """
    grid = [float(p) for p in np.linspace(max(0.0, share - error), min(1.0, share + error), GRID)]
    # the sketch is of bounded size, and off by one row in 100,000 at most
    at, low = known.agg(F.percentile_approx("worth", F.array(*map(F.lit, grid)), 100_000), F.min("worth")).first()
    if not at or share <= 0:
        return model.threshold if low is None else float(low - 1)
    k = int(np.argmax(np.diff(at)))
    return (at[k] + at[k + 1]) / 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 1500) -> Model:
    """A model whose threshold is the quantile of the scores of all of ``docs``."""
    model, share, error = learned(docs, labels, id_col, text_col, label_col, per_label)
    return model if share is None else replace(model, threshold=quantile(worths(docs, model, id_col, text_col), model, share, error))


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 1500) -> tuple[Model, float | None, float]:
    """A model, the labels' share of bad documents and twice its standard error; no share if there is nothing to learn.

    Trains on the labels of the training fold, on ``per_label`` ids with each label at most; whole texts. Repeated labels
    count once; an id with both labels stands for both. Of several documents with one id, the one whose text has the
    smallest hash is learned.
    """
    known = labels.select(named(id_col).alias("id"), named(label_col).alias("y")).where(is_training(F.col("id")) & F.col("y").isin(0, 1))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    total = sum(counts.values())
    nothing = Model(np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE), 0.0), None, 0.0
    if not total:
        return nothing
    h = draw("id", F.lit("quality"))
    # about twice as many as wanted of each label by their hashes, then exactly those with the smallest
    near = lambda y: known.where((F.col("y") == y) & (h < drawn_below(2 * per_label + 100, counts.get(y, 0)))).distinct()
    chosen = reduce(DataFrame.union, [near(y).orderBy(h, "id").limit(per_label) for y in (0, 1)])
    slim = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    # at most per_label ids of each label, so they may be broadcast; rows with one id bring one text
    rows = slim.where(is_training(F.col("id"))).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r")).select("id", "y", "r.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = [features(t).astype(np.float32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(str, b.column("id").to_pylist()), pa.string()), pa.array(b.column("y").to_pylist(), pa.int32()), pa.array(x, pa.binary())], ["id", "y", "x"])

    got = sorted(map(tuple, rows.select("id", "y", "text").mapInArrow(run, "id string, y int, x binary").collect()))
    if not got:
        return nothing
    x = np.stack([np.frombuffer(r[2], np.float32) for r in got]).astype(float)
    share = counts.get(0, 0) / total
    return train(x, np.array([r[1] for r in got]), share), share, 2 * (share * (1 - share) / total) ** 0.5


def rated(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with two columns more, score and predicted, which replace columns of these names.

    A null text is scored as an empty one. Null ids and repeated rows stay; an empty table gives an empty result; when
    there are no labels to learn from, every score is the cut itself, so that nothing is rejected.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    return _mapped(docs.select(*map(named, kept)), model, text_col, lambda columns, p: [*columns, pa.array(p), pa.array((p >= CUT).astype(np.int32))], (StructField("score", DoubleType()), StructField("predicted", IntegerType())))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, with their own columns, whatever they are named."""
    return _mapped(docs, model, text_col, lambda columns, p: [c.filter(pa.array(p >= CUT)) for c in columns])


def _mapped(docs: DataFrame, model: Model, text_col: str, result: Callable[[list[pa.Array], np.ndarray], list[pa.Array]], more: tuple[StructField, ...] = ()) -> DataFrame:
    """The columns that ``result`` makes of those of a batch and its scores; inside, columns are known by their places."""
    own = [StructField(f"x{i}", f.dataType) for i, f in enumerate(docs.schema)]
    inside, names, place = StructType([*own, *more]), [*docs.columns, *(f.name for f in more)], f"x{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, place):
            p = np.array([model.score(t) for t in b.column(place).to_pylist()])
            yield pa.RecordBatch.from_arrays(result(b.columns, p), inside.names)

    numbered = docs.select(*(named(c).alias(f"x{i}") for i, c in enumerate(docs.columns)))
    return numbered.mapInArrow(run, inside).toDF(*names)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, score, predicted)`` for each row: what ``rated`` says with the model that ``fit`` gives.

    The worths are written once, for the quantile and for the scores, so that each text is read once.
    """
    model, share, error = learned(docs, labels)
    known = checkpointed(worths(docs, model))
    if share is not None:
        model = replace(model, threshold=quantile(known, model, share, error))
    score = model.score_of(F.col("worth"))
    return known.select(F.col("id").alias("doc_id"), score.alias("score"), (score >= CUT).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return said.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
