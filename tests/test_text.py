"""Manuals, chunks, retrieval, prompts, replies and chats."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions.scoring import verdict_by_counts, verdict_rule
from sensorloom.operators import chunks as chunk_ops
from sensorloom.operators import retrieval, verdicts
from sensorloom.schema import CITATION

PAGES = "source string, page int, text string"


def split(spark, text, size=20, overlap=5):
    rows = chunk_ops.chunk_text(spark.createDataFrame([(text,)], "t string"), "t", size, overlap).orderBy("pos")
    return [r["chunk"] for r in rows.collect()]


@pytest.mark.parametrize("text, expected", [
    ("  a\n\n b\t c ", ["a b c"]),
    ("   ", []),
    ("One two. Three four.", ["One two. Three four."]),
    # the second sentence does not fit: the chunk closes and its last five characters open the next
    ("One two three. Four five six.", ["One two three.", "hree. Four five six."]),
    # what is still too long is cut at 20 in steps of 15
    ("One. " + "x" * 40, ["One.", "One. " + "x" * 15, "x" * 20, "x" * 15]),
    ("x" * 36, ["x" * 20, "x" * 20, "x" * 6]),
    ("non breaking   space", ["non breaking space"]),
])
def test_chunks(spark, text, expected):
    assert split(spark, text) == expected


def test_whole_text_is_covered(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefg"), rng.integers(1, 12))) + ("." if rng.random() < 0.1 else "")
             for _ in range(4000)]
    text = " ".join(words)
    found = split(spark, text, 800, 120)
    assert all(0 < len(c) <= 800 for c in found)
    at = 0
    for chunk in found:
        place = text.find(chunk[-40:], max(at - 200, 0))
        assert place >= 0
        at = place
    assert text.endswith(found[-1][-40:])


def plain_chunks(text, size, overlap):
    """The rule with strings: sentences packed, an overflow opens with the overlap, the rest is cut."""
    flat, done, opened = " ".join(text.split()), [], ""
    if len(flat) <= size:
        return [flat] if flat else []
    for piece in re.split(r"(?<=[.!?])\s+", flat):
        if len(opened) + len(piece) + 1 <= size:
            opened = f"{opened} {piece}".strip(" ")
            continue
        full = f"{opened[-overlap:]} {piece}".strip(" ") if opened else piece
        done += [opened] if opened else []
        while len(full) > size:
            done.append(full[:size])
            full = full[size - overlap:]
        opened = full
    return done + ([opened] if opened else [])


@pytest.mark.parametrize("sentences", [255, 256, 257, 1500])
def test_blocks_of_sentences_change_nothing(spark, sentences):
    rng = np.random.default_rng(sentences)
    text = " ".join("w" * int(n) + " é." for n in rng.integers(1, 60, sentences))
    assert split(spark, text, 80, 15) == plain_chunks(text, 80, 15)


def test_time_of_a_long_page_grows_with_its_length(spark):
    def seconds(n):
        page = spark.createDataFrame([(" ".join(f"Pump {i} of the second row runs hot today." for i in range(n)),)], "t string")
        began = time.perf_counter()
        chunk_ops.chunk_text(page, "t").agg(F.count("chunk"), F.sum(F.length("chunk"))).collect()
        return time.perf_counter() - began
    seconds(20_000)
    assert seconds(80_000) < 8 * max(seconds(20_000), 0.2)  # four times the text; a quadratic fold takes sixteen


def test_segments_carry_headings_over_pages(spark):
    pages = [("m", 1, "preface\n1. Operating Limits\nkeep cool\n2.1 Relief Valve\nopen it\n"), ("m", 2, "  "),
             ("m", 3, "more on valves\n\n3. Motors\n"), ("m", 25_000, "tail"), ("n", 1, "other manual"),
             ("m", 4, "2. lower case is no heading\n4. No")]
    found = chunk_ops.segment_pages(spark.createDataFrame(pages, PAGES)).orderBy("source", "page", "segment").collect()
    assert [(r["source"], r["page"], r["segment"], r["section"], r["body"].strip()) for r in found] == [
        ("m", 1, 0, None, "preface"), ("m", 1, 1, "1. Operating Limits", "keep cool"),
        ("m", 1, 2, "2.1 Relief Valve", "open it"), ("m", 3, 0, "2.1 Relief Valve", "more on valves"),
        ("m", 3, 1, "3. Motors", ""), ("m", 4, 0, "3. Motors", "2. lower case is no heading\n4. No"),
        ("m", 25_000, 0, "3. Motors", "tail"), ("n", 1, 0, None, "other manual")]


def test_chunk_table(spark):
    pages = spark.createDataFrame([("m", 1, "1. Motors\n" + "Run cool. " * 200), ("n", 1, "short")], PAGES)
    built = chunk_ops.build_chunks(pages)
    assert built.select("id").distinct().count() == built.count()
    assert built.exceptAll(chunk_ops.build_chunks(pages.repartition(3))).isEmpty()
    counts = {r["source"]: r["chunk_count"] for r in chunk_ops.chunk_counts(built).collect()}
    assert counts["n"] == 1 and counts["m"] >= 3
    assert built.filter("source = 'n'").first()["section"] == ""
    assert chunk_ops.drop_source(built, "m").count() == 1


def vectors(spark, ids, data, name):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, data)],
                                 f"{name} long, embedding array<float>")


def brute(queries, data, k):
    data, queries = (np.asarray(a, dtype="float32").astype("float64") for a in (data, queries))
    out = {}
    for q, query in enumerate(queries):
        distance = ((data - query) ** 2).sum(axis=1)
        order = np.lexsort((np.arange(len(data)), distance))[:k]
        out[q] = [(int(i), round(float(distance[i]), 6)) for i in order]
    return out


@pytest.mark.parametrize("grid", [False, True])
def test_nearest_equals_brute_force(spark, monkeypatch, grid):
    rng = np.random.default_rng(1)
    data, queries = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    data[50:60] = data[10]  # exact copies: ties go to the lower id
    queries[0] = data[10]
    if grid:
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", 9)
        monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 70)
    hits = retrieval.nearest(vectors(spark, range(40), queries, "query_id"),
                             vectors(spark, range(300), data, "id").repartition(5), 4)
    found = {}
    for r in hits.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["id"], round(r["distance"], 6)))
    assert found == brute(queries, data, 4)


def test_retrieve_and_context(spark):
    chunks = spark.createDataFrame([
        (1, "m.pdf", 2, "1. Motors", " " + "x" * 600, [0.0, 0.0]), (2, "n.pdf", None, "", "near", [1.0, 0.0]),
        (3, "m.pdf", 1, "", "far", [9.0, 0.0])],
        "id long, source string, page int, section string, text string, embedding array<float>")
    hits = retrieval.retrieve(vectors(spark, [7], [[0.0, 0.0]], "query_id"), chunks, 2)
    rows = hits.orderBy("rank").collect()
    assert [(r["id"], r["score"], r["section"], len(r["snippet"])) for r in rows] == [
        (1, 1.0, "1. Motors", 500), (2, 0.5, None, 4)]
    assert retrieval.format_context(hits).first()["context"] == (
        "[m.pdf §1. Motors, p.2] " + "x" * 500 + "\n\n[n.pdf] near")
    assert retrieval.retrieve(vectors(spark, [7], [[0.0, 0.0]], "query_id"), chunks.limit(0), 2).isEmpty()
    assert retrieval.retrieve(vectors(spark, [], [], "query_id"), chunks, 2).isEmpty()


def test_verdict_reads_words_or_counts(spark):
    row = spark.createDataFrame([("machine HIGH-1 is fine", 0, 0, 2)], "t string, h long, m long, l long").select(
        verdict_rule(F.col("t")).alias("by_text"), verdict_by_counts(F.col("h"), F.col("m"), F.col("l")).alias("by_count"),
        verdict_rule(F.lit(None).cast("string")).alias("none")).first()
    assert row["by_text"]["verdict"] == "URGENT_SERVICE" and row["by_count"]["verdict"] == "MONITOR"
    assert row["none"]["verdict"] == "SAFE" and row["none"]["explanation"].startswith("[stub] No meaningful")


def test_citation_choice(spark):
    kind = f"array<{CITATION.simpleString()}>"
    own, model = [("m", "s", 1, None, 0.5)], [("x", "y", None, None, None)]
    rows = spark.createDataFrame([(own, model), ([], model), (None, model), ([], None)], f"r {kind}, m {kind}")
    found = rows.select(verdicts.choose_citations(F.col("r"), F.col("m")).alias("c")).collect()
    assert [[c["source"] for c in r["c"]] for r in found] == [["m"], ["x"], ["x"], []]


def test_transcript_and_history(spark):
    recs = spark.createDataFrame([("s", 2, "q2", "SAFE", "fine"), ("s", 1, "q1", "MONITOR", "watch"), ("t", 1, "q", "SAFE", "e")],
                                 "session_id string, created_at long, question string, verdict string, explanation string")
    messages = verdicts.to_messages(recs)
    lines = [(r["role"], r["content"]) for r in verdicts.transcript(messages, "s").collect()]
    assert lines == [("user", "q1"), ("assistant", "[MONITOR] watch"), ("user", "q2"), ("assistant", "[SAFE] fine")]
    tail = verdicts.history_tail(messages, 3, tie="position" if "position" in messages.columns else None)
    assert tail.filter("session_id = 's'").count() == 3
