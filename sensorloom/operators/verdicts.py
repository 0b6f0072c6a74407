"""Prompts, reply clean-up, histories and batch verdicts over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.scoring import FALLBACK_PREFIX, RULE_PREFIX, verdict_rule
from sensorloom.operators.chunks import strip
from sensorloom.operators.fleet import anomaly_digest
from sensorloom.operators.ordered import last_rows
from sensorloom.operators.retrieval import context_block, retrieve
from sensorloom.scale import DEFAULT, Scale
from sensorloom.schema import CITATION, HISTORY_MESSAGES, NO_ANOMALIES, RECOMMEND_K, VERDICTS

# Headings and fallbacks of the prompt, and the blank-explanation text.
ANOMALY_HEADING, NO_DIGEST = "## Detected anomalies\n", "No anomalies detected."
MANUAL_HEADING, NO_MANUAL = "## Manual excerpts\n", "(none provided)"
QUESTION_HEADING = "## Engineer question\n"
NO_EXPLANATION = "No explanation provided."
DEFAULT_VERDICT = "MONITOR"
CITATIONS = f"array<{CITATION.simpleString()}>"


def _or_else(col: Column, fallback: str) -> Column:
    return F.when(F.coalesce(col, F.lit("")) != "", col).otherwise(fallback)


def build_prompts(questions: DataFrame) -> DataFrame:
    """Add ``prompt`` from the ``digest``, ``context`` and ``question`` columns."""
    return questions.withColumn("prompt", F.concat_ws(
        "\n\n",
        F.concat(F.lit(ANOMALY_HEADING), _or_else(F.col("digest"), NO_DIGEST)),
        F.concat(F.lit(MANUAL_HEADING), _or_else(F.col("context"), NO_MANUAL)),
        F.concat(F.lit(QUESTION_HEADING), F.col("question"))))


def coerce_replies(df: DataFrame, reply_col: str, digest_col: str = "digest") -> DataFrame:
    """Add verdict, explanation and citations read from JSON replies.

    Unknown verdicts become MONITOR, blank explanations a fixed text, citations that are not a list
    an empty one. A reply that is no JSON object falls back to the rule on the digest.
    """
    reply = strip(F.col(reply_col))
    # inside a list, a reply with anything after its closing brace is no JSON or more than one entry
    fields = F.from_json(F.concat(F.lit("["), reply, F.lit("]")),
                         "array<struct<verdict: string, explanation: string, citations: string>>",
                         {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    usable = reply.startswith("{") & (F.size("_all") == 1) & F.col("_r").isNotNull()
    verdict = strip(F.upper("_r.verdict"))
    listed = F.trim(F.coalesce("_r.citations", F.lit(""))).startswith("[")
    empty = F.array().cast(CITATIONS)
    rule = verdict_rule(F.col(digest_col), FALLBACK_PREFIX + RULE_PREFIX)
    return (
        df.withColumn("_all", fields).withColumn("_r", F.get("_all", F.lit(0))).withColumn("_ok", F.coalesce(usable, F.lit(False)))
        .withColumn("verdict", F.when(~F.col("_ok"), rule["verdict"])
                    .when(verdict.isin(*VERDICTS), verdict).otherwise(DEFAULT_VERDICT))
        .withColumn("explanation", F.when(~F.col("_ok"), rule["explanation"])
                    .otherwise(_or_else(strip(F.col("_r.explanation")), NO_EXPLANATION)))
        .withColumn("citations", F.when(F.col("_ok") & listed, F.coalesce(
            F.from_json("_r.citations", CITATIONS), empty)).otherwise(empty))
        .drop("_all", "_r", "_ok"))


def choose_citations(retrieved: Column, model: Column) -> Column:
    """Retrieved chunks when there are any, else the reply's own, else none."""
    empty = F.array().cast(CITATIONS)
    return F.when(F.size(F.coalesce(retrieved, empty)) > 0, retrieved).otherwise(F.coalesce(model, empty))


def history_tail(messages: DataFrame, n: int = HISTORY_MESSAGES, session: str = "session_id",
                 time: str = "created_at", tie: str | None = None) -> DataFrame:
    """The last ``n`` messages of each session with ``position`` 1..n from the newest."""
    order = [F.desc(c) for c in (time, tie) if c]
    return last_rows(messages, [session], n, order, rank="position")


def transcript(messages: DataFrame, session_id) -> DataFrame:
    return messages.filter(F.col("session_id") == session_id).orderBy("created_at", "position")


def to_messages(recommendations: DataFrame) -> DataFrame:
    """Two chat messages per recommendation: the question, then the reply as ``[VERDICT] explanation``."""
    def message(position: int, role: str, content: Column) -> Column:
        return F.struct(F.lit(position).alias("position"), F.lit(role).alias("role"), content.alias("content"))

    reply = F.concat(F.lit("["), "verdict", F.lit("] "), "explanation")
    both = F.array(message(0, "user", F.col("question")), message(1, "assistant", reply))
    return recommendations.select("session_id", "created_at", F.inline(both))


def recommend_batch(questions: DataFrame, machines: DataFrame, anomalies: DataFrame,
                    chunks: DataFrame | None = None, messages: DataFrame | None = None,
                    k: int = RECOMMEND_K, scale: Scale = DEFAULT) -> DataFrame:
    """Verdict, explanation, citations, prompt and history for every question.

    ``questions`` holds id, machine_id (null for the whole fleet), session_id and question, plus
    an ``embedding`` of the expanded question when ``chunks`` are given.
    """
    own = anomaly_digest(anomalies, machines, by="machine_id", scale=scale).withColumnRenamed("digest", "_own")
    whole = anomaly_digest(anomalies, machines, scale=scale)
    rows = questions.join(own, "machine_id", "left")
    rows = rows.withColumn("digest", F.when(F.col("machine_id").isNull(), whole.scalar()).otherwise(
        F.coalesce("_own", F.lit(NO_ANOMALIES)))).drop("_own")
    rows = _with_manuals(rows, questions, chunks, k)
    if messages is not None:
        rows = rows.join(_histories(messages), "session_id", "left")
    rule = verdict_rule(F.col("digest"))
    return build_prompts(rows).withColumn("verdict", rule["verdict"]).withColumn(
        "explanation", rule["explanation"]).withColumn(
        "citations", choose_citations(F.col("citations"), F.lit(None).cast(CITATIONS)))


def _with_manuals(rows: DataFrame, questions: DataFrame, chunks: DataFrame | None, k: int) -> DataFrame:
    """Context text and citations of each question, at most ``k`` hits per question.

    Vectors are taken from the questions as given, so what was joined to ``rows`` is not computed for them.
    """
    if chunks is None:
        return rows.withColumns({"context": F.lit(""), "citations": F.array().cast(CITATIONS)})
    asked = questions.filter(F.col("embedding").isNotNull()).select(F.col("id").alias("query_id"), "embedding")
    citation = F.struct("source", "snippet", "page", "section", "score")
    ranked = F.sort_array(F.collect_list(F.struct("rank", context_block().alias("b"), citation.alias("c"))))
    found = retrieve(asked, chunks, k).groupBy(F.col("query_id").alias("id")).agg(ranked.alias("_hits")).select(
        "id", F.array_join(F.transform("_hits", lambda h: h["b"]), "\n\n").alias("context"),
        F.transform("_hits", lambda h: h["c"]).cast(CITATIONS).alias("citations"))
    return rows.join(found, "id", "left")


def _histories(messages: DataFrame) -> DataFrame:
    """Last messages of each session, oldest first."""
    tail = history_tail(messages, tie="position" if "position" in messages.columns else None)
    newest_last = F.sort_array(F.collect_list(F.struct(-F.col("position"), "role", "content")))
    return tail.groupBy("session_id").agg(
        F.transform(newest_last, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
        .alias("history"))
