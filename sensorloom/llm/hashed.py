"""Hashed text features and sparse linear fits on them, shared by the classifiers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import text_or_empty

BUCKETS = 1 << 26
#: letters of a stem feature
STEM = 5
#: features that a worker remembers the weights of
REMEMBERED = 400_000
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[^\w\s]{2,}|[#*$%&|<>]")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def names(text: str) -> set[str]:
    """Features of a whole text: its words, their stems, runs of marks, and rough shares."""
    lower = text.lower()
    found = set(_WORD.findall(lower))
    out = found | {"^" + w[:STEM] for w in found if len(w) > STEM} | {"!" + m[:4] for m in _MARKS.findall(text)}
    pieces = lower.split()
    shares = {"varied": len(set(pieces)) / max(1, len(pieces)), "marks": len(_MARKS.findall(text)) / max(1, len(pieces)),
              "capitals": sum(map(str.isupper, text)) / max(1, len(text))}
    return out | {f"~{k}{int(10 * v)}" for k, v in shares.items()} | {f"~length{len(pieces).bit_length()}"}


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


@dataclass
class Sparse:
    """Rows of hashed features that are there or not."""

    columns: np.ndarray
    starts: np.ndarray
    #: bucket of each column
    buckets: np.ndarray

    @classmethod
    def of(cls, rows: list, least: int = 2) -> Sparse:
        """Columns are the buckets that at least ``least`` rows hold; a last column is always there."""
        flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.empty(0, np.int64)
        values, counts = np.unique(flat, return_counts=True)
        kept = values[counts >= least]
        at = np.searchsorted(kept, flat)
        known = (at < len(kept)) & (kept[np.minimum(at, max(len(kept) - 1, 0))] == flat) if len(kept) else np.zeros(len(flat), bool)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        everywhere = np.arange(len(rows))
        row, column = np.concatenate([row[known], everywhere]), np.concatenate([at[known], np.full(len(rows), len(kept))])
        order = np.argsort(row, kind="stable")
        starts = np.searchsorted(row[order], everywhere)
        return cls(column[order], starts, kept)

    @property
    def width(self) -> int:
        return len(self.buckets) + 1

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.columns], self.starts)

    def back(self, values: np.ndarray) -> np.ndarray:
        lengths = np.diff(np.append(self.starts, len(self.columns)))
        return np.bincount(self.columns, np.repeat(values, lengths), self.width)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, penalty: np.ndarray,
              rounds: int = 120) -> np.ndarray:
    """Accelerated proximal gradient descent with a one-norm weighted by ``penalty``."""
    x, momentum, t, step = start.copy(), start.copy(), 1.0, 1.0
    for _ in range(rounds):
        value, grad = loss(momentum)
        while True:
            moved = momentum - step * grad
            new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
            change = new - momentum
            if loss(new)[0] <= value + grad @ change + change @ change / (2 * step) + 1e-12 or step < 1e-9:
                break
            step /= 2
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = new + (t - 1) / t_new * (new - x)
        if (grad @ (new - x)) > 0:  # overshot: start the momentum again
            momentum, t_new = new.copy(), 1.0
        x, t, step = new, t_new, step * 1.3
    return x


class Scorer:
    """Sum of the weights of a text's features; remembers the weights of frequent features."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.seen = weights, bias, {}

    def __call__(self, text: str) -> float:
        total, seen = self.bias, self.seen
        for name in names(text):
            value = seen.get(name)
            if value is None:
                value = self.weights.get(bucket(name), 0.0)
                if len(seen) < REMEMBERED:
                    seen[name] = value
            total += value
        return total


def sparse_weights(found: np.ndarray, matrix: Sparse) -> tuple[dict[int, float], float]:
    used = np.flatnonzero(found[:matrix.width - 1])
    return {int(matrix.buckets[i]): float(found[i]) for i in used}, float(found[matrix.width - 1])


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the hashed features of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted({bucket(n) for n in names(t)}) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(rows, pa.list_(pa.int32()))], [*keep, "features"])
    rows = docs.select(*keep, text_or_empty().alias("text"))
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInArrow(run, f"{kinds}, features array<int>")


def collected(sample: DataFrame, label: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of a bounded sample, in the order of doc_id; as Arrow arrays, which stay narrow on the driver."""
    found = sample.select("doc_id", label, "features").orderBy("doc_id", label).toArrow()
    return [x.values.to_numpy() for x in found.column("features")], found.column(label).to_numpy()


def scored(docs: DataFrame, keep: list[str], weights: dict[int, float], bias: float, into: str) -> DataFrame:
    """``keep`` and the linear score of every whole text; a null text is an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(weights, bias)
        for batch in batches:
            found = np.fromiter((score(x.as_py()) for x in batch.column("text")), np.float64, batch.num_rows)
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(found)], [*keep, into])
    rows = docs.select(*keep, text_or_empty().alias("text"))
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInArrow(run, f"{kinds}, {into} double")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Documents with the ``most`` labels of least hash among those that may be learned from.

    ``labels`` has doc_id and ``label``; of several labels of a document the largest counts.
    """
    from sensorloom.llm.common import held_out
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    one = rows.groupBy("doc_id").agg(F.max(label).alias(label))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
