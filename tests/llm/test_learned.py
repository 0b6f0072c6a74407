"""Trained operators: gradients, recovered parameters, held-out accuracy, and odd rows."""

import zlib

import numpy as np
import pytest
from conftest import DATA
from odd_rows import no_docs, odd_docs  # noqa: F401  fixtures

from sensorloom.llm import language, quality, toxicity
from sensorloom.llm.hashed import Sparse, bucket, names
from sensorloom.llm.queries import QUERIES


def outside(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0


def test_network_gradient():
    net = language.Network.fresh(["a", "b", "c"], 4, 1)
    rng = np.random.default_rng(0)
    windows, wanted = rng.integers(0, 257, (5, 7)).astype(np.int16), np.array([0, 1, 2, 1, 0])
    _, grads = net.gradients(windows, wanted)
    for p, g in zip(net.parameters, grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), p.shape)
        held = p[at]
        p[at] = held + 1e-2
        above, _ = net.gradients(windows, wanted)
        p[at] = held - 1e-2
        below, _ = net.gradients(windows, wanted)
        p[at] = held
        assert (above - below) / 2e-2 == pytest.approx(g[at], rel=1e-2)


def test_pooling_covers_whole_texts():
    net = language.Network.fresh(["a", "b"], 3, 2)
    texts = [b"", b"x", b"abc" * 200, bytes(range(256)) * 3]
    pooled = language.pooled(net, texts, lanes=3)
    for text, got in zip(texts, pooled, strict=True):
        windows, counts = language.to_windows([text])
        assert counts[0] == -(-len(text) // language.WINDOW)
        if text:
            real = (windows.T != 256)[:, None, :]
            assert got == pytest.approx((net.labels(windows) * real).sum(axis=(0, 2)) / len(text), rel=1e-5)


def test_language_query(spark):
    rows = QUERIES["op9_language"](spark, DATA).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(rows) == len(truth) and all(r["held_out"] == outside(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_language_of_odd_rows(odd_docs, no_docs):
    net = language.Network.fresh(["a", "b"], 3, 2)
    found = language.predict(odd_docs, net).collect()
    assert len(found) == odd_docs.count()
    unknown = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found if r["lang_pred"] == "und")
    assert unknown == [(False, 3), (False, 4), (False, 5), (False, 8), (True, 0)]
    assert language.fit(no_docs) is None and language.predict(no_docs, None).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd_docs, None).collect()} == {"und"}


def test_ordinal_gradient_and_recovery():
    rng = np.random.default_rng(1)
    raw = np.array([-0.4, 0.3, -0.2])
    score, grade = rng.normal(size=40), rng.integers(0, 4, 40)
    _, by_score, by_raw = quality.ordinal_loss(score, grade, raw)
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        slope = (quality.ordinal_loss(score, grade, raw + step)[0] - quality.ordinal_loss(score, grade, raw - step)[0]) / 2e-6
        assert slope == pytest.approx(by_raw[k], abs=1e-6)
    step = np.eye(40)[7] * 1e-6
    slope = (quality.ordinal_loss(score + step, grade, raw)[0] - quality.ordinal_loss(score - step, grade, raw)[0]) / 2e-6
    assert slope == pytest.approx(by_score[7], abs=1e-6)
    rows = [[k for k in range(6) if rng.random() < 0.5] for _ in range(800)]
    latent = np.array([2.0 * (0 in r) - 2.0 * (1 in r) for r in rows]) + rng.logistic(size=800)
    model = quality.fitted(rows, np.digitize(latent, [-1.0, 1.0]))
    assert model.weights[0] > 1 and model.weights[1] < -1 and model.thresholds[0] < model.thresholds[1]


def test_quality_query_keeps_good_documents(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op1_quality"](spark, DATA).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in rows.values())
    good = [rows[x["doc_id"]]["expected_grade"] for x in labels if x["quality"] == 1 and not x["toxic"]]
    poor = [rows[x["doc_id"]]["expected_grade"] for x in labels if x["quality"] == 0]
    assert np.mean(good) > np.mean(poor) + 0.8


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    model = quality.Ordinal({bucket("alpha"): 3.0}, 0.0, np.array([0.0, 1.0]))
    found = quality.graded(odd_docs, model).collect()
    assert len(found) == odd_docs.count() and all(r["tail_probability"] > 0.5 for r in found if r["doc_id"] in (1, 2))
    ratings = spark.createDataFrame([(1, None), (None, 2), (99, 1)], "doc_id long, grade int")
    assert quality.fit(odd_docs, ratings) is None and quality.graded(no_docs, None).count() == 0


def test_label_model_recovers_accuracies_of_dependent_voters():
    rng = np.random.default_rng(2)
    truth = rng.random(60_000) < 0.2
    rates = [(0.8, 0.02), (0.7, 0.03), (0.6, 0.05), (0.75, 0.04)]
    fired = np.stack([rng.random(len(truth)) < np.where(truth, a, b) for a, b in rates], axis=1)
    copied = np.where(rng.random(len(truth)) < 0.9, fired[:, 3], rng.random(len(truth)) < 0.1)
    fired = np.column_stack([fired, copied]).astype(int)
    patterns, counts = np.unique(fired, axis=0, return_counts=True)
    model = toxicity.fitted(patterns, counts.astype(float), 4)
    assert model.share == pytest.approx(0.2, abs=0.02)
    assert model.accuracies(patterns, counts)[:4, 0] == pytest.approx([a for a, _ in rates], abs=0.04)
    assert model.parent[4] == 3 or model.parent[3] == 4
    agreed = (model.posterior(fired) > 0.5) == truth
    assert agreed.mean() > 0.95


def test_toxicity_query(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op2_toxicity"](spark, DATA).collect()}
    labels = [x for x in spark.read.parquet(f"{DATA}/labels.parquet").collect() if x["toxic"] is not None]
    assert all(r["held_out"] == outside(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    right = [rows[x["doc_id"]]["predicted"] == x["toxic"] for x in labels]
    assert np.mean(right) > 0.9


def test_toxicity_sample_is_reduced_before_it_is_sent(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "IF(id % 10 = 0, 0.9D, 0.1D) AS belief")
    chosen = toxicity.drawn(rows, 1500, 5000)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 2 and "Window" not in plan
    found = chosen.collect()
    hashed = sorted((r["h"], r["doc_id"], r["belief"]) for r in rows.selectExpr("xxhash64(doc_id) AS h", "*").collect())
    want = [d for _, d, b in hashed if b > 0.5][:1500] + [d for _, d, b in hashed if b < 0.5][:5000]
    assert sorted(r["doc_id"] for r in found) == sorted(want)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (10, 0)], "doc_id long, toxic int")
    found = toxicity.toxicity(odd_docs, *toxicity.fit(odd_docs, labels)).collect()
    assert len(found) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.toxicity(no_docs, *toxicity.fit(no_docs, labels.limit(0))).count() == 0


def test_sparse_matrix_equals_dense():
    rows = [[5, 9], [9], [5, 9, 70], [70], []]
    matrix = Sparse.of(rows)
    dense = np.array([[b in r for b in (5, 9, 70)] + [True] for r in rows], float)
    weights = np.array([1.0, -2.0, 0.5, 3.0])
    assert matrix.times(weights) == pytest.approx(dense @ weights)
    assert matrix.back(np.arange(5.0)) == pytest.approx(dense.T @ np.arange(5.0))
    assert "^stupi" in names("Stupidly") and "!###" in names("x### y")


def test_toxicity_votes_on_each_text_once(spark, odd_docs, monkeypatch):
    """The counts of all rows and the sample of those that are not held out come from one pass of the voters."""
    passes, votes = [], toxicity.votes
    monkeypatch.setattr(toxicity, "votes", lambda *args: passes.append(args) or votes(*args))
    toxicity.fit(odd_docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert len(passes) == 1
