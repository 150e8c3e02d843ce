"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade <= g) = 1 / (1 + exp(w.x - t_g)): one weight per word is shared by all thresholds t, which
ascend. Features are log(1 + count) of markers: words, runs of letters in lower case, and word
beginnings of 5 and 7 letters, as offensive stems take endings. All that are in ``min_documents`` labelled documents or more and
reach ``min_chi2`` in a chi-squared test between documents of grade 0 and others become markers.
Grades are the whole numbers of the label column, from 0; each grade above 0 that occurs has a threshold, so that a column of
0 and 1 gives one. Expected severity is the sum over grades of P(grade >= g).

The model is fitted on at most ``sample_rows`` labelled documents (those of the smallest hashed
ids); every document is scored on its whole text.

Null ids or labels are not learnt from; an id with several labels counts by the highest, negative labels as 0, and an id with several texts is learnt from
by its smallest one. Null and empty texts have no words. Without documents of grade 0 and of others there is no model and all severities are 0.
Rows are scored one by one; other columns than those named are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import lean, materialize, small_batches

SAMPLE_ROWS = 10_000
MIN_CHI2 = 15.0
MIN_DOCUMENTS = 5
STEMS = (5, 7)
_LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str, heads: set[str] | None = None) -> dict[str, int]:
    """Counts of words and of their beginnings (marked "^"), of all words or those whose first letters are in ``heads``."""
    found: dict[str, int] = {}
    words = _LETTERS.findall(text.lower())
    if heads is not None:
        words = [w for w in words if w[: STEMS[0]] in heads]
    for w in words:
        found[w] = found.get(w, 0) + 1
        for n in STEMS:
            if len(w) >= n:
                stem = "^" + w[:n]
                found[stem] = found.get(stem, 0) + 1
    return found


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray
    thresholds: np.ndarray
    #: The label of each grade, in order.
    levels: tuple[int, ...] = (0, 1)

    def __post_init__(self):
        self.at = dict(zip(self.words, self.weights.tolist(), strict=True))
        self.heads = {w.lstrip("^")[: STEMS[0]] for w in self.words}

    def total(self, text: str) -> float:
        """w.x of a text."""
        at = self.at
        return sum(at[f] * np.log1p(n) for f, n in sorted(features(text, self.heads).items()) if f in at)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_columns: int, penalty: float = 0.1, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ascending thresholds) of the penalised cumulative logit model of a sparse matrix."""
    top = int(grades.max())
    n = len(grades)
    share = np.array([(grades >= g).mean() for g in range(1, top + 1)])
    weights = np.zeros(n_columns)
    # thresholds as a first value and logarithms of gaps, so that they stay in order
    start = -np.log(share / (1 - share))
    shape = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    moments = [np.zeros(n_columns + top) for _ in range(2)]
    for step in range(1, steps + 1):
        gaps = np.exp(shape[1:])
        thresholds = shape[0] + np.concatenate([[0], np.cumsum(gaps)])
        eta = np.bincount(rows, weights[columns] * values, n)
        over = _sigmoid(eta[:, None] - np.concatenate([[-np.inf], thresholds, [np.inf]]).clip(-1e9, 1e9)[None, :])
        over[:, 0], over[:, -1] = 1, 0
        each = np.arange(n)
        above, beyond = over[each, grades], over[each, grades + 1]
        p = np.maximum(above - beyond, 1e-12)
        slope_above, slope_beyond = above * (1 - above), beyond * (1 - beyond)
        eta_gradient = -(slope_above - slope_beyond) / p
        gradient = np.bincount(columns, eta_gradient[rows] * values, n_columns) + penalty * weights
        by_threshold = np.zeros(top)
        for g in range(1, top + 1):
            by_threshold[g - 1] = (slope_above / p)[grades == g].sum() - (slope_beyond / p)[grades == g - 1].sum()
        tail = np.cumsum(by_threshold[::-1])[::-1]
        by_shape = np.concatenate([tail[:1], tail[1:] * gaps])
        whole = np.concatenate([gradient, by_shape]) / n
        moments[0] = 0.9 * moments[0] + 0.1 * whole
        moments[1] = 0.99 * moments[1] + 0.01 * whole**2
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-9)
        weights -= move[:n_columns]
        shape -= move[n_columns:]
    return weights, shape[0] + np.concatenate([[0], np.cumsum(np.exp(shape[1:]))])


def _word_lists(batches):
    """(row, toxic, word, n): the features of each document."""
    for batch in batches:
        rows, toxic, words, counts = [], [], [], []
        for row, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
            found = features((text or b"").decode(errors="replace"))
            rows += [row] * len(found)
            toxic += [label] * len(found)
            words += found
            counts += found.values()
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(toxic, pa.int32()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["row", "toxic", "word", "n"])


def _marked(at: dict[str, int]):
    """(row, grade, markers, counts): the chosen features of each document."""
    heads = {w.lstrip("^")[: STEMS[0]] for w in at}

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column(2).cast(pa.large_binary()).to_pylist():
                own = features((text or b"").decode(errors="replace"), heads)
                found.append(sorted((at[f], n) for f, n in own.items() if f in at))
            columns = [pa.array([[m for m, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["row", "grade", "markers", "counts"])

    return run


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, min_documents: int = MIN_DOCUMENTS, min_chi2: float = MIN_CHI2) -> Model | None:
    """The model of the labelled documents; None if they are not of both kinds. Its markers are features of the labelled sample, which bounds them."""
    small_batches(documents.sparkSession)
    known = labels.select(F.col(id_column).alias("__id"), F.col(label).cast("int").alias("toxic")).dropna()
    known = known.groupBy("__id").agg(F.greatest(F.max("toxic"), F.lit(0)).alias("grade"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    sample = documents.select(F.col(id_column).alias("__id"), F.col(text).alias("text")).join(F.broadcast(known), "__id")  # at most sample_rows rows
    sample = materialize(sample.groupBy("__id", "grade").agg(F.min("text").alias("text")).select(F.xxhash64("__id").alias("row"), "grade", "text"))
    sizes = {r.grade: r.n for r in sample.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}  # the grades of at most sample_rows rows
    good = sizes.pop(0, 0)
    bad = sum(sizes.values())
    if not bad or not good:
        return None
    sample = sample.withColumn("toxic", (F.col("grade") > 0).cast("int"))
    words = sample.select("row", "toxic", "text").mapInArrow(lean(_word_lists), "row long, toxic int, word string, n long")
    seen = words.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") + F.col("b") >= min_documents)
    n = float(bad + good)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi2 = n * F.pow(a * (good - b) - b * (bad - a), 2) / (bad * good * (a + b) * (n - a - b) + 1e-9)
    markers = seen.select("word", chi2.alias("chi2")).where(F.col("chi2") >= min_chi2).orderBy(F.desc("chi2"), "word").collect()  # of the sample's features
    if not markers:
        return None
    at = {r.word: i for i, r in enumerate(markers)}
    marked = sample.select("row", "grade", "text").mapInArrow(lean(_marked(at)), "row long, grade int, markers array<int>, counts array<long>").collect()  # at most sample_rows rows
    marked = sorted(marked, key=lambda r: r.row)
    entries = [(i, m, c) for i, r in enumerate(marked) for m, c in zip(r.markers, r.counts, strict=True)]
    rows, columns, counts = (np.array(x) for x in zip(*entries, strict=True))
    levels = (0, *sorted(sizes))
    grades = np.searchsorted(levels, [r.grade for r in marked])
    weights, thresholds = fit_ordinal(rows, columns, np.log1p(counts), grades, len(at))
    return Model(list(at), weights, thresholds, levels)


def score(documents: DataFrame, model: Model | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (P of any grade above 0), grade (the likeliest) and toxic (p_toxic >= 0.5)."""
    small_batches(documents.sparkSession)
    kind = dict(documents.dtypes)[id_column]
    shared = documents.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample

    def run(batches):
        model = shared.value
        thresholds = model.thresholds if model else np.full(1, np.inf)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            totals = [model.total((text.as_py() or b"").decode(errors="replace")) if model else 0.0 for text in texts]
            over = _sigmoid(np.array(totals, float)[:, None] - thresholds[None, :]) if model else np.zeros((len(totals), 1))
            steps = np.concatenate([np.ones((len(over), 1)), over, np.zeros((len(over), 1))], axis=1)
            levels = np.array(model.levels if model else (0, 1))
            grade = levels[np.argmax(steps[:, :-1] - steps[:, 1:], axis=1)]
            columns = [batch.column(0), pa.array(over @ np.diff(levels)), pa.array(over[:, 0]), pa.array(grade, pa.int32()), pa.array(over[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return documents.select(F.col(id_column), F.col(text)).mapInArrow(lean(run), f"doc_id {kind}, severity double, p_toxic double, grade int, toxic boolean")


def filter_toxic(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows that are not toxic, with all their columns."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    position = documents.columns.index(text)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(position).cast(pa.large_binary())
            keep = [not model or model.total((text.as_py() or b"").decode(errors="replace")) < model.thresholds[0] for text in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(lean(run), documents.schema)
