"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

Voters are lexicons and patterns that fire on a text or not. The label model takes the counts of all
vote patterns, over all documents, and fits the share of toxic documents and how often each voter
fires in either class by expectation maximisation. Voters are not independent: the pairs that
depend most on each other within the classes form a tree, and each voter is conditioned on its parent.
A linear classifier then learns the posterior labels from hashed text and scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import held_out, stored, text_or_empty
from sensorloom.llm.hashed import (STEM, Sparse, collected, labelled_sample, logistic, minimised, scored, sparse_weights,
                                   with_features, words)

#: general English insults: fixed values of one lexicon voter
INSULTS = ("idiot moron stupid dumb loser trash scum pathetic worthless disgusting clown jerk fool imbecile coward liar filth "
           "garbage vermin").split()

#: bound of the labelled rows that lexicons are learned from, and of the documents that the classifier is fitted on
LABELLED = 20_000
TOXIC_SAMPLE = 3000
OTHER_SAMPLE = 5000
#: terms in the learned lexicons, dealt to so many voters each
TERMS, TERM_VOTERS = 240, 6
STEMS, STEM_VOTERS = 40, 3
LEAST_SUPPORT = 4
PENALTY = 1e-4
_SHOUT = re.compile(r"[A-Z]{4,}")


@dataclass(frozen=True)
class Voters:
    """Lexicon voters by term and by stem, and pattern voters that need no labels."""

    terms: dict[str, int]
    stems: dict[str, int]

    @property
    def number(self) -> int:
        return TERM_VOTERS + STEM_VOTERS + 4

    def __call__(self, text: str) -> int:
        """Bits of the voters that fire."""
        found = words(text)
        held = set(found)
        fired = {self.terms[w] for w in held & self.terms.keys()}
        fired |= {TERM_VOTERS + self.stems[s] for s in {w[:STEM] for w in held if len(w) > STEM} & self.stems.keys()}
        first = TERM_VOTERS + STEM_VOTERS
        if not held.isdisjoint(INSULTS):
            fired.add(first)
        if fired:
            at = [i for i, w in enumerate(found) if w in self.terms or w in INSULTS]
            if any(b - a <= 2 for a, b in zip(at, at[1:], strict=False)):
                fired.add(first + 1)  # two such words next to each other
            if 100 * len(at) >= len(found):
                fired.add(first + 2)  # one in a hundred words
        if 5 * len(_SHOUT.findall(text)) > len(found):
            fired.add(first + 3)
        return sum(1 << v for v in fired)


def learned_voters(docs: DataFrame, labels: DataFrame) -> Voters:
    """Terms and stems that the labelled toxic documents hold far more often than others (a top-k report)."""
    rows = labelled_sample(docs, labels, "toxic", LABELLED).select("toxic", "text")
    found = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    held = rows.select("toxic", F.explode(found).alias("term")).filter(F.length("term") > 1)
    stems = rows.select("toxic", F.explode(F.array_distinct(F.transform(
        F.filter(found, lambda w: F.length(w) > STEM), lambda w: F.substring(w, 1, STEM)))).alias("term"))

    def top(terms: DataFrame, most: int) -> list[str]:
        counted = terms.groupBy("term").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all"))
        share = (F.col("bad") + 0.1) / (F.col("all") - F.col("bad") + 0.1)
        strong = counted.filter((F.col("bad") >= LEAST_SUPPORT) & (F.col("bad") >= 0.6 * F.col("all")))
        return [r["term"] for r in strong.orderBy((F.col("bad") * F.log(1 + share)).desc(), "term").limit(most).collect()]
    return Voters({t: i % TERM_VOTERS for i, t in enumerate(top(held, TERMS))},
                  {t: i % STEM_VOTERS for i, t in enumerate(top(stems, STEMS))})


def votes(docs: DataFrame, voters: Voters, keep: list[str]) -> DataFrame:
    """``keep`` and the vote pattern of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((voters(x.as_py()) for x in batch.column("text")), np.int64, batch.num_rows)
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(found)], [*keep, "pattern"])
    rows = docs.select(*keep, text_or_empty().alias("text"))
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInArrow(run, (f"{kinds}, " if keep else "") + "pattern long")


@dataclass
class LabelModel:
    """``fires``: P(voter fires | class, parent fired), (voter, class, 2); ``parent``: -1 for the root."""

    share: float
    parent: np.ndarray
    fires: np.ndarray

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of each row of ``fired``."""
        score = np.full((2, len(fired)), 0.0)
        for y in range(2):
            score[y] = np.log(self.share if y else 1 - self.share)
            for i, p in enumerate(self.parent):
                given = fired[:, p] if p >= 0 else np.zeros(len(fired), int)
                chance = self.fires[i, y, given]
                score[y] += np.log(np.where(fired[:, i] == 1, chance, 1 - chance))
        return logistic(score[1] - score[0])

    def accuracies(self, fired: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(fires | toxic) and P(silent | not toxic) of each voter."""
        toxic = self.posterior(fired) * counts
        other = counts - toxic
        return np.stack([toxic @ fired / toxic.sum(), other @ (1 - fired) / other.sum()], axis=1)


def _tree(fired: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Parents of the tree with the most mutual information between voters within the classes."""
    n, total = fired.shape[1], sum(w.sum() for w in weights)
    shared = np.zeros((n, n))
    for w in weights:
        both = {(a, b): (np.where(fired == a, 1, 0).T * w) @ np.where(fired == b, 1, 0) + 1e-3 for a in (0, 1) for b in (0, 1)}
        mass = sum(both.values())
        for (a, b), m in both.items():
            rows = both[a, 0] + both[a, 1]
            columns = both[0, b] + both[1, b]
            shared += m / total * np.log(m * mass / (rows * columns))
    parent, inside = np.full(n, -1), {0}
    while len(inside) < n:
        i, p = max(((i, p) for i in range(n) if i not in inside for p in inside), key=lambda e: shared[e])
        parent[i] = p
        inside.add(i)
    return parent


def fitted(fired: np.ndarray, counts: np.ndarray, lexicon: int, rounds: int = 40) -> LabelModel:
    """Fit to vote patterns and their counts; the first ``lexicon`` voters tell which class is the toxic one."""
    n = fired.shape[1]
    belief = logistic(3.0 * fired[:, :lexicon].sum(axis=1) - 1.5)
    parent = np.full(n, -1)
    model = LabelModel(0.1, parent, np.full((n, 2, 2), 0.5))
    for step in range(2 * rounds):
        if step == rounds:
            parent = _tree(fired, [counts * (1 - belief), counts * belief])
        fires = np.empty((n, 2, 2))
        for y, w in enumerate((counts * (1 - belief), counts * belief)):
            for i, p in enumerate(parent):
                for g in range(2):
                    there = w * (fired[:, p] == g) if p >= 0 else w
                    # a weak prior holds chances off 0 and 1
                    fires[i, y, g] = (there @ fired[:, i] + 0.5) / (there.sum() + 1.0)
        share = float((counts @ belief + 0.5) / (counts.sum() + 1.0))
        model = LabelModel(share, parent, np.clip(fires, 1e-4, 1 - 1e-4))
        belief = model.posterior(fired)
    return model


def bits(patterns: np.ndarray, number: int) -> np.ndarray:
    return (patterns[:, None] >> np.arange(number)) & 1


def drawn(rows: DataFrame, toxic: int = TOXIC_SAMPLE, other: int = OTHER_SAMPLE) -> DataFrame:
    """The rows of least hash of either class; tasks reduce theirs to so many before any is sent."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return (rows.filter(F.col("belief") > 0.5).orderBy(*order).limit(toxic)
            .union(rows.filter(~(F.col("belief") > 0.5)).orderBy(*order).limit(other)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, float], float]:
    """Weights and bias of the classifier. Labels are read from rows that are not held out, and so is its sample."""
    given = docs.select("doc_id", "text")
    voters = learned_voters(given, labels.select("doc_id", "toxic"))
    # every text is voted on once: the counts take all rows, the sample those that are not held out
    rows = stored(votes(given.withColumn("held_out", held_out()), voters, ["doc_id", "held_out"]), "votes")
    counted = rows.groupBy("pattern").count().collect()  # at most 2 ** voters rows
    if not counted:
        return {}, -4.0
    patterns, counts = (np.array([r[c] for r in counted]) for c in ("pattern", "count"))
    order = np.argsort(patterns)
    patterns, counts = patterns[order], counts[order].astype(float)
    model = fitted(bits(patterns, voters.number), counts, TERM_VOTERS + STEM_VOTERS + 1)
    belief = model.posterior(bits(patterns, voters.number))
    spark = docs.sparkSession
    believed = spark.createDataFrame([(int(p), float(b)) for p, b in zip(patterns, belief, strict=True)], "pattern long, belief double")
    learned = rows.filter(~F.col("held_out")).drop("held_out")
    chosen = drawn(learned.join(F.broadcast(believed), "pattern")).groupBy("doc_id").agg(F.max("belief").alias("belief"))
    sample, belief = collected(with_features(given.join(F.broadcast(chosen), "doc_id"), ["doc_id", "belief"]), "belief")
    return classifier(sample, belief) if sample else ({}, -4.0)


def classifier(rows: list, belief: np.ndarray, penalty: float = PENALTY) -> tuple[dict[int, float], float]:
    """Logistic regression on probable labels; both classes weigh the same, so rare ones are not drowned."""
    matrix = Sparse.of(rows)
    weight = belief / max(belief.sum(), 1e-9) + (1 - belief) / max((1 - belief).sum(), 1e-9)
    weight /= weight.sum()

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        score = matrix.times(x)
        value = weight @ (np.logaddexp(0, score) - belief * score)
        return float(value), matrix.back(weight * (logistic(score) - belief))
    held = np.append(np.full(matrix.width - 1, penalty), 0.0)
    return sparse_weights(minimised(loss, np.zeros(matrix.width), held), matrix)


def toxicity(docs: DataFrame, weights: dict[int, float], bias: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; empty and null texts get the score of no features."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    found = scored(rows, ["doc_id", "held_out"], weights, bias, "value")
    score = 1 / (1 + F.exp(-F.col("value")))
    return found.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
