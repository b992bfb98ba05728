"""Quality of texts as an ordered grade, by cumulative-link regression on hashed text.

One weight vector, shared by all grades, gives a text its score; ascending thresholds
cut the score into grades: ``P(grade <= k) = sigmoid(threshold_k - score)``.  From these
follow the expected grade and the tail probability that selection asks for.

Features are the words of a text and a few coarse shares of its characters, each hashed to
a column; presence counts, not frequency.  The model is fitted on a bounded sample of the
labelled rows: of each grade about ``train_rows`` divided by the number of grades, chosen
by hash of the id.  Texts of up to ``TRAIN_BYTES`` are learnt from; a grade that has only longer
ones is learnt from as much of them.  Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import shingles
from foldwise.llm.common import materialise, table, text_of
from foldwise.llm.registry import query

TRAIN_ROWS = 8000
TRAIN_BYTES = 1 << 16
COLUMN_BITS = 17
COLUMNS = 1 << COLUMN_BITS
SHARE_COLUMNS = 128
SHARE_SCALE = 3.0
WORD_SCALE = 8.0
KEEP_TAIL = 0.1  # grades count alike in the fit, so that a good text of a mostly good corpus needs far less than a half
GRADES = ("toxic", "poor", "good")
_U = np.uint64

_APART = np.ones(256, dtype=bool)  # everything but ASCII letters, digits and bytes of other scripts parts words
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_KIND = np.zeros(256, dtype=np.uint8)  # 1 symbols, 2 capitals, 3 digits, 4 exclamations, 5 white space
_KIND[list(b"#*$%&|<>@~^_=+{}[]\\/")] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[list(b"!?")] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5


def _shares(text: bytes, words: np.ndarray, n_distinct: int) -> list[int]:
    """Columns of the coarse shares: each share's level names one column."""
    n = max(len(words), 1)
    kinds = np.bincount(_KIND[np.frombuffer(text, dtype=np.uint8)], minlength=6)
    size = max(len(text) - int(kinds[5]), 1)
    pairs = len(np.unique(words[:-1] * _U(31) + words[1:])) if len(words) > 1 else 1
    levels = [int(np.log2(1 + 1000 * kinds[k] / size)) for k in (1, 2, 3, 4)]
    levels += [size // n, 15 * n_distinct // n, 15 * pairs // max(n - 1, 1), n.bit_length()]
    return [16 * i + min(v, 15) for i, v in enumerate(levels)]


def features(texts: Sequence[bytes]) -> Iterator[np.ndarray]:
    """The distinct columns present in each text: coarse shares first, then words."""
    words, bounds = shingles.word_hashes(texts, _APART)
    column = (words >> _U(64 - COLUMN_BITS)).astype(np.int64)
    for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        found = np.unique(column[a:b])
        yield np.concatenate((np.array(_shares(t, words[a:b], len(found)), dtype=np.int64), found[found >= SHARE_COLUMNS]))


def _values(found: np.ndarray) -> np.ndarray:
    """What a text's columns are worth: shares fully, words less the more of them there are."""
    words = np.count_nonzero(found >= SHARE_COLUMNS)
    return np.where(found < SHARE_COLUMNS, SHARE_SCALE, WORD_SCALE / np.sqrt(max(words, 16)))


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray  # ascending thresholds, one fewer than grades

    def tails(self, texts: Sequence[bytes]) -> np.ndarray:
        """``P(grade >= k)`` of each text for k = 1, 2, ..."""
        score = np.array([self.weights[f] @ _values(f) for f in features(texts)])
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -40, 40)))


def fit(texts: Sequence[bytes], grades: Sequence[int], n_grades: int = len(GRADES), rounds: int = 300, step: float = 0.3, decay: float = 3e-5) -> Model:
    """Weights and thresholds of greatest likelihood, by accelerated gradient descent; grades count alike.

    A word has a weight only if a few of the texts have it: four, or one in four hundred.
    """
    sets: list[np.ndarray] = []
    for a, b in shingles.batches(texts):
        sets.extend(features(texts[a:b]))
    y = np.asarray(grades)
    row, column = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    common = np.bincount(column, minlength=COLUMNS) >= min(max(4, len(sets) // 400), max(1, len(sets) // 10))
    value = np.concatenate([_values(s) for s in sets])
    row, column, value = row[common[column]], column[common[column]], value[common[column]]
    share = np.bincount(y, minlength=n_grades)
    pull = 1.0 / (np.count_nonzero(share) * share[y])
    first = np.concatenate(([-1.0], np.zeros(n_grades - 2)))  # the first threshold, and logarithms of the steps to the next
    now = [np.zeros(COLUMNS), first]
    ahead, t_now = [v.copy() for v in now], 1.0
    for _ in range(rounds):
        w, theta = ahead
        cuts = theta[0] + np.concatenate(([0.0], np.cumsum(np.exp(theta[1:]))))
        score = np.bincount(row, weights=w[column] * value, minlength=len(sets))
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        above = 1 / (1 + np.exp(-np.clip(edges[y + 1] - score, -40, 40)))
        below = 1 / (1 + np.exp(-np.clip(edges[y] - score, -40, 40)))
        mass = np.maximum(above - below, 1e-12)
        slope = np.bincount(column, weights=(pull * (1 - above - below))[row] * value, minlength=COLUMNS) + decay * w
        up, down = -pull * above * (1 - above) / mass, pull * below * (1 - below) / mass
        by_cut = np.array([up[y == k].sum() + down[y == k + 1].sum() for k in range(n_grades - 1)])
        theta_slope = np.concatenate(([by_cut.sum()], [by_cut[k + 1 :].sum() * np.exp(theta[k + 1]) for k in range(n_grades - 2)]))
        new = [w - step * slope, np.concatenate(([theta[0] - step * theta_slope[0]], np.clip(theta[1:] - step * theta_slope[1:], -3, 3)))]
        t_next = (1 + np.sqrt(1 + 4 * t_now * t_now)) / 2
        ahead = [n + (t_now - 1) / t_next * (n - o) for n, o in zip(new, now, strict=True)]
        now, t_now = new, t_next
    w, theta = now
    return Model(w.astype(np.float32), theta[0] + np.concatenate(([0.0], np.cumsum(np.exp(theta[1:])))))


def grade_of() -> Column:
    """Grade of a label row: 0 toxic, 1 poor, 2 good; null if neither label is known."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


def train(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, n_grades: int = len(GRADES)) -> Model | None:
    """Fit on a sample of the rows that have a ``grade``; None if fewer than two grades occur.

    ``labels`` has the id and an integer ``grade``; of several labels of one id the least counts.
    """
    known = labels.where(F.col(id_column).isNotNull() & F.col("grade").isNotNull()).groupBy(id_column).agg(F.min("grade").alias("grade"))
    known = materialise(known)
    sizes = {r[0]: r[1] for r in known.groupBy("grade").count().collect()}  # one row for each grade
    if len(sizes) < 2:
        return None
    each = train_rows // len(sizes)
    cuts = F.element_at(F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, int((1 << 30) * min(1.0, each / n)))]), F.col("grade"))
    ids = materialise(known.where(F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) < cuts).withColumnRenamed(id_column, "__id"))
    texts = documents.where(F.col(text).isNotNull()).select(F.col(id_column).alias("__of"), F.col(text).alias("text"))
    found = materialise(texts.join(ids, F.col("__of") == F.col("__id")).withColumn("short", F.octet_length("text") <= TRAIN_BYTES))
    lacking = [r[0] for r in found.groupBy("grade").agg(F.bool_or("short").alias("any")).where("NOT any").collect()]  # at most one row for each grade
    found = found.where(F.col("short") | F.col("grade").isin(lacking)) if lacking else found.where("short")
    found = found.select(F.when(F.col("short"), F.col("text")).otherwise(F.substring("text", 1, TRAIN_BYTES // 4)).alias("text"), "grade")
    sample = found.groupBy("text").agg(F.min("grade").cast("int").alias("grade")).toArrow()
    pairs = sorted(zip(sample.column(0).cast(pa.binary()).to_pylist(), sample.column(1).to_pylist(), strict=True))
    if len({g for _, g in pairs}) < 2:
        return None
    return fit([t for t, _ in pairs], [g for _, g in pairs], n_grades)


def graded(documents: DataFrame, model: Model | None, text: str = "text", n_grades: int = len(GRADES)) -> DataFrame:
    """``row, expected_grade, tail`` (``P(grade >= k)`` for k = 1, 2, ...) of every row.

    Defined cases: a null text is an empty one; without a model all grades are as
    likely; repeated rows are graded each time; extra columns stay inside ``row``; an
    empty table gives an empty result.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text])
    packed = documents.select(own.alias("row"), text_of(text).alias("__text"))
    schema = packed.select("row").limit(0).withColumns({"expected_grade": F.lit(0.0), "tail": F.array(F.lit(0.0))}).schema
    sent = documents.sparkSession.sparkContext.broadcast(model)  # one number for each hashed column

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        even = 1 - np.arange(1, n_grades) / n_grades
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in shingles.batches(texts):
                tails = m.tails(texts[a:b]) if m else np.tile(even, (b - a, 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))],
                    names=["row", "expected_grade", "tail"])

    return packed.mapInArrow(run, schema)


@query()
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document, how likely it is good, and whether it is kept."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").withColumn("grade", grade_of())
    found = graded(documents, train(documents, labels))
    good = F.element_at("tail", len(GRADES) - 1)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "expected_grade", F.element_at("tail", 1).alias("p_not_toxic"), good.alias("p_good"), (good >= KEEP_TAIL).alias("kept"))
