"""Quality grades by ordinal regression: one linear score of hashed text, cut by ordered thresholds.

P(grade > k) = logistic(score - threshold k). The thresholds are one number and positive steps, so they
stay in order, and all grades share the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import held_out
from sensorloom.llm.hashed import Sparse, collected, labelled_sample, logistic, minimised, scored, sparse_weights, with_features

#: bound of the labelled rows that the model is fitted on
SAMPLE = 6000
PENALTY = 2e-4
GRADES = 3
#: documents are selected when they belong above this grade with this probability
TAIL_GRADE = 1
SELECT = 0.5


@dataclass
class Ordinal:
    weights: dict[int, float]
    bias: float
    thresholds: np.ndarray


def ordered_thresholds(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def ordinal_loss(score: np.ndarray, grade: np.ndarray, raw: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood, its derivative by each score, and by the raw thresholds."""
    cuts = ordered_thresholds(raw)
    ends = np.concatenate([[-np.inf], cuts, [np.inf]])
    with np.errstate(invalid="ignore"):
        upper, lower = (np.where(np.isinf(e), e > 0, logistic(np.where(np.isinf(e), 0, e) - score))
                        for e in (ends[grade + 1], ends[grade]))
    chance = np.maximum(upper - lower, 1e-12)
    n = len(score)
    by_cut = np.zeros(len(cuts))
    np.add.at(by_cut, np.minimum(grade, len(cuts) - 1), np.where(grade < len(cuts), -upper * (1 - upper) / chance, 0))
    np.add.at(by_cut, np.maximum(grade - 1, 0), np.where(grade > 0, lower * (1 - lower) / chance, 0))
    by_raw = np.cumsum(by_cut[::-1])[::-1].copy()
    by_raw[1:] *= np.exp(raw[1:])
    return float(-np.log(chance).mean()), (upper + lower - 1) * -1 / n, by_raw / n


def fitted(rows: list, grade: np.ndarray, grades: int = GRADES, penalty: float = PENALTY) -> Ordinal:
    matrix = Sparse.of(rows)
    n = matrix.width

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, by_score, by_raw = ordinal_loss(matrix.times(x[:n]), grade, x[n:])
        return value, np.concatenate([matrix.back(by_score), by_raw])
    start = np.concatenate([np.zeros(n), [0.0], np.zeros(grades - 2)])
    held = np.concatenate([np.full(n - 1, penalty), np.zeros(grades)])
    found = minimised(loss, start, held)
    weights, bias = sparse_weights(found, matrix)
    return Ordinal(weights, bias, ordered_thresholds(found[n:]))


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Ordinal | None:
    """Fit on at most ``sample`` rated documents (doc_id, grade) that are not held out; None without any."""
    rows, grade = collected(with_features(labelled_sample(docs, ratings, "grade", sample), ["doc_id", "grade"]), "grade")
    return fitted(rows, grade) if rows else None


def grades_of(labels: DataFrame) -> DataFrame:
    """Graded ratings from the labels: 0 poor, 1 fair but toxic, 2 good. A row without a quality has no grade."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def graded(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_probability, kept) of every document.

    ``expected_grade`` is the mean grade under the model, ``tail_probability`` that of a grade above
    ``TAIL_GRADE``. Without a model both are null and every document is kept.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    if model is None:
        nothing = F.lit(None).cast("double")
        return rows.select("doc_id", "held_out", nothing.alias("expected_grade"), nothing.alias("tail_probability"), F.lit(True).alias("kept"))
    found = scored(rows, ["doc_id", "held_out"], model.weights, model.bias, "value")
    above = [1 / (1 + F.exp(F.lit(float(t)) - F.col("value"))) for t in model.thresholds]
    tail = above[TAIL_GRADE]
    return found.select("doc_id", "held_out", sum(above[1:], above[0]).alias("expected_grade"), tail.alias("tail_probability"),
                        (tail >= SELECT).alias("kept"))
