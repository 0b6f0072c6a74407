"""Checked queries over digests, manuals, retrieval, verdicts and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.scoring import SAFE_VERDICT, VERDICT_RULES
from sensorloom.functions.scoring import verdict_rule as rule_on
from sensorloom.operators import chunks as chunk_ops
from sensorloom.operators import fleet as fleet_ops
from sensorloom.operators import cells, retrieval, verdicts
from sensorloom.plans.checks import check, rounded
from sensorloom.plans.fixtures import Fixtures, with_shapes
from sensorloom.schema import NO_ANOMALIES

LINE = ("printf('- %s: %s = %.2f at %s | severity %s, z=%.2f%s', coalesce(name, machine_id::VARCHAR), parameter, value, "
        "strftime(ts, '%Y-%m-%d %H:%M'), severity, z_score, CASE WHEN is_trending THEN ' (worsening trend)' ELSE '' END)")
LINE_ORDER = "z_score DESC, ts, machine_id, parameter"
OWN_DIGEST = (f"SELECT machine_id, string_agg(line, chr(10) ORDER BY r) AS digest FROM (SELECT machine_id, {LINE} AS line, "
              f"row_number() OVER (PARTITION BY machine_id ORDER BY {LINE_ORDER}) AS r FROM an "
              "LEFT JOIN md ON md.id = machine_id) WHERE r <= 40 GROUP BY machine_id")
FLEET_DIGEST = (f"SELECT string_agg(line, chr(10) ORDER BY r) AS digest FROM (SELECT {LINE} AS line, "
                f"row_number() OVER (ORDER BY {LINE_ORDER}) AS r FROM an LEFT JOIN md ON md.id = machine_id) WHERE r <= 40")
DIGESTS = {"own": f"SELECT md.id AS machine_id, coalesce(digest, '{NO_ANOMALIES}') AS digest "
                  f"FROM md LEFT JOIN ({OWN_DIGEST}) d ON d.machine_id = md.id",
           "fleet": FLEET_DIGEST}
REASONS = {word: (verdict, reason) for word, verdict, reason in [*VERDICT_RULES, ("", *SAFE_VERDICT)]}


def rule_sql(digest: str, part: int, prefix: str = "") -> str:
    cases = " ".join(f"WHEN contains(upper({digest}), '{w}') THEN '{prefix if part else ''}{r[part]}'"
                     for w, r in REASONS.items())
    return f"CASE {cases} END"


@check(with_shapes("SELECT machine_id, digest FROM own", "md", "an", extra=DIGESTS))
def anomaly_digest(x: Fixtures) -> DataFrame:
    return fleet_ops.anomaly_digest(x.anomalies(), x.machines(), by="machine_id")


@check(with_shapes("SELECT digest FROM fleet", "md", "an", extra=DIGESTS))
def anomaly_digest_fleet(x: Fixtures) -> DataFrame:
    return fleet_ops.anomaly_digest(x.anomalies(), x.machines())


@check(with_shapes(f"SELECT machine_id, {rule_sql('digest', 0)} AS verdict, "
                   f"{rule_sql('digest', 1, '[stub] ')} AS explanation FROM own", "md", "an", extra=DIGESTS))
def verdict_rule(x: Fixtures) -> DataFrame:
    digests = fleet_ops.anomaly_digest(x.anomalies(), x.machines(), by="machine_id")
    return digests.select("machine_id", rule_on(F.col("digest")).alias("r")).select("machine_id", "r.*")


QUESTIONS = ("SELECT item_id AS id, CASE WHEN item_id % 5 <> 0 THEN item_id END AS machine_id, text AS question "
             "FROM benchmark")


@check(with_shapes(
    "SELECT q.id, q.machine_id, question, trim(concat_ws(' ', question, name, machine_type, "
    "CASE WHEN q.machine_id IS NULL THEN (SELECT string_agg(DISTINCT parameter, ' ' ORDER BY parameter) FROM aw) "
    "ELSE params END)) AS query FROM qs q LEFT JOIN md ON md.id = q.machine_id LEFT JOIN "
    "(SELECT machine_id, string_agg(DISTINCT parameter, ' ' ORDER BY parameter) AS params FROM aw GROUP BY 1) p "
    "ON p.machine_id = q.machine_id", "md", "aw", extra={"qs": QUESTIONS}))
def augment_query(x: Fixtures) -> DataFrame:
    return retrieval.augment_query(x.questions(), x.machines(), x.wide_anomalies())


@check(with_shapes(
    "SELECT q.id, '## Detected anomalies' || chr(10) || coalesce(digest, 'No anomalies detected.') || chr(10) || chr(10) || "
    "'## Manual excerpts' || chr(10) || CASE WHEN q.id % 2 = 0 THEN 'excerpt ' || q.id ELSE '(none provided)' END || "
    "chr(10) || chr(10) || '## Engineer question' || chr(10) || question AS prompt "
    "FROM qs q LEFT JOIN own USING (machine_id)", "md", "an", extra={"qs": QUESTIONS, **DIGESTS}))
def build_prompts(x: Fixtures) -> DataFrame:
    digests = fleet_ops.anomaly_digest(x.anomalies(), x.machines(), by="machine_id")
    context = F.when(F.col("id") % 2 == 0, F.concat(F.lit("excerpt "), F.col("id").cast("string")))
    rows = x.questions().join(digests, "machine_id", "left").withColumn("context", context)
    return verdicts.build_prompts(rows).select("id", "prompt")


# Replies with planted faults, by the remainder of conversation + turn.
REPLIES = """SELECT conv_id, turn, (conv_id + turn) % 7 AS fault, text,
  CASE turn % 3 WHEN 0 THEN 'severity HIGH' WHEN 1 THEN 'severity MEDIUM' ELSE '' END AS digest FROM conversations"""


@check(with_shapes(
    "SELECT conv_id, turn, CASE WHEN fault >= 5 THEN " + rule_sql("digest", 0)
    + " WHEN fault = 1 THEN 'SAFE' WHEN fault = 2 THEN 'MONITOR' ELSE 'URGENT_SERVICE' END AS verdict, "
      "CASE WHEN fault >= 5 THEN " + rule_sql("digest", 1, "[fallback] [stub] ")
    + " WHEN fault = 3 THEN 'No explanation provided.' ELSE trim(text, ' ') END AS explanation, "
      "CASE WHEN fault >= 4 THEN '' ELSE 'manual@3@0.5' END AS cited FROM rp", extra={"rp": REPLIES}))
def coerce_replies(x: Fixtures) -> DataFrame:
    fault = (F.col("conv_id") + F.col("turn")) % 7
    verdict = F.when(fault == 1, " safe ").when(fault == 2, "BROKEN").otherwise("URGENT_SERVICE")
    cited = F.struct(F.lit("manual").alias("source"), F.lit("s").alias("snippet"), F.lit(3).alias("page"),
                     F.lit("a").alias("section"), F.lit(0.5).alias("score"))
    explanation = F.when(fault == 3, "   ").otherwise(F.col("text")).alias("explanation")
    listed = F.to_json(F.struct(verdict.alias("verdict"), explanation, F.array(cited).alias("citations")))
    unlisted = F.to_json(F.struct(verdict.alias("verdict"), explanation, F.lit("none").alias("citations")))
    reply = (F.when(fault == 4, unlisted).when(fault == 5, F.substring(listed, 1, 15))
             .when(fault == 6, "[1, 2]").otherwise(listed))
    digest = F.when(F.col("turn") % 3 == 0, "severity HIGH").when(F.col("turn") % 3 == 1, "severity MEDIUM").otherwise("")
    rows = x.table("conversations").select("conv_id", "turn", reply.alias("reply"), digest.alias("digest"))
    shown = F.array_join(F.transform("citations", lambda c: F.concat_ws(
        "@", c["source"], c["page"].cast("string"), c["score"].cast("string"))), ",")
    return verdicts.coerce_replies(rows, "reply").select(
        "conv_id", "turn", "verdict", "explanation", shown.alias("cited"))


# Fixed value: a numbered heading on a line of its own, in the dialect of the checking engine.
HEADING = r"(?m)^\s*(\d+(?:\.\d+)*\.?\s+[A-Z][^\n]{2,70})\s*$"
FULL = "CASE WHEN s.open = '' THEN p.open ELSE trim(right(s.open, 120) || ' ' || p.open) END"
CUTS = "greatest(ceil((length(b) - 800) / 680.0), 0)::INTEGER"
OVERFLOW = (f"list_transform([{FULL}], lambda b: {{'open': substr(b, {CUTS} * 680 + 1), "
            "'done': s.done || CASE WHEN s.open = '' THEN []::VARCHAR[] ELSE [s.open] END || "
            f"list_transform(range({CUTS}), lambda i: substr(b, (i * 680 + 1)::BIGINT, 800))}})[1]")
CHUNKS = {
    "pages": "SELECT source, doc_id + 1 AS page, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents",
    "headed": f"SELECT *, regexp_extract_all(text, '{HEADING}', 1) AS heads, "
              f"string_split_regex(text, '{HEADING}') AS bodies FROM pages WHERE text <> ''",
    "carried": "SELECT *, last_value(heads[-1] IGNORE NULLS) OVER (PARTITION BY source ORDER BY page "
               "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM headed",
    "segments": "SELECT source, page, i - 1 AS segment, CASE WHEN i = 1 THEN before ELSE trim(heads[i - 1]) END AS section, "
                "trim(regexp_replace(bodies[i], '\\s+', ' ', 'g')) AS flat, bodies[i] AS body "
                "FROM (SELECT *, unnest(range(1, len(bodies) + 1)) AS i FROM carried)",
    "cut": "SELECT *, CASE WHEN flat = '' THEN []::VARCHAR[] WHEN length(flat) <= 800 THEN [flat] ELSE "
           "list_transform([list_reduce(list_prepend({'open': '', 'done': []::VARCHAR[]}, "
           "list_transform(string_split(regexp_replace(flat, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), "
           "lambda t: {'open': t, 'done': []::VARCHAR[]})), lambda s, p: "
           "CASE WHEN length(s.open) + length(p.open) + 1 <= 800 THEN {'open': trim(s.open || ' ' || p.open), 'done': s.done} "
           f"ELSE {OVERFLOW} END)], lambda s: s.done || CASE WHEN s.open = '' THEN []::VARCHAR[] ELSE [s.open] END)[1] "
           "END AS parts FROM segments WHERE segment > 0 OR regexp_replace(body, '\\s+', '', 'g') <> ''",
}


@check(with_shapes(
    "SELECT source, page::INTEGER AS page, segment::INTEGER AS segment, coalesce(section, '') AS section, "
    "(i - 1)::INTEGER AS pos, parts[i] AS text "
    "FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM cut)", extra=CHUNKS))
def chunk_documents(x: Fixtures) -> DataFrame:
    return chunk_ops.build_chunks(x.pages()).drop("id")


@check(with_shapes("SELECT source, count(*) AS chunk_count FROM (SELECT source, unnest(parts) FROM cut) GROUP BY source",
                   extra=CHUNKS))
def chunk_counts(x: Fixtures) -> DataFrame:
    return chunk_ops.chunk_counts(chunk_ops.build_chunks(x.pages()))


def hits_sql(queries: str, k: int) -> str:
    return (f"SELECT * FROM (SELECT q.query_id, c.id, c.source, c.page, nullif(c.section, '') AS section, "
            "substr(regexp_replace(c.text, '^\\s+|\\s+$', '', 'g'), 1, 500) AS snippet, "
            "list_distance(q.embedding, c.embedding) ^ 2 AS distance, row_number() OVER (PARTITION BY q.query_id "
            f"ORDER BY list_distance(q.embedding, c.embedding), c.id) AS rank FROM {queries} q, ch c) WHERE rank <= {k}")


BLOCK = ("'[' || source || CASE WHEN section IS NOT NULL THEN ' §' || section ELSE '' END || "
         "CASE WHEN page <> 0 THEN ', p.' || page ELSE '' END || '] ' || snippet")


@check(with_shapes("SELECT query_id, rank::INTEGER AS rank, id, source, page, section, snippet, "
                   "round(1.0 / (1.0 + distance), 3) AS score, round(distance, 6) AS distance "
                   f"FROM ({hits_sql('qv', 4)})", "ch", "qv"))
def retrieve_topk(x: Fixtures) -> DataFrame:
    return rounded(retrieval.retrieve(x.centroids(), x.chunks(), 4), "distance")


@check(with_shapes("SELECT query_id, rank::INTEGER AS rank, id, source, page, section, snippet, "
                   "round(1.0 / (1.0 + distance), 3) AS score, round(distance, 6) AS distance "
                   f"FROM ({hits_sql('qv', 10)})", "ch", "qv"))
def retrieve_from_cells(x: Fixtures) -> DataFrame:
    laid = cells.lay_out(x.chunks(), f"{x.folder()}/cells", centres=16)
    return rounded(retrieval.retrieve(x.centroids(), x.chunks(), 10, laid), "distance")


@check(with_shapes(f"SELECT query_id, string_agg({BLOCK}, chr(10) || chr(10) ORDER BY rank) AS context "
                   f"FROM ({hits_sql('qv', 4)}) GROUP BY query_id", "ch", "qv"))
def format_context(x: Fixtures) -> DataFrame:
    return retrieval.format_context(retrieval.retrieve(x.centroids(), x.chunks(), 4))


TAIL = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS position FROM conversations"
TURNS = ("SELECT conv_id * 1000 + turn AS query_id, conv_id, text, embedding::DOUBLE[] AS embedding FROM conversations "
         "LEFT JOIN embeddings ON vec_id = conv_id WHERE role = 'user'")


@check(with_shapes(
    "SELECT t.query_id AS id, t.conv_id AS machine_id, " + rule_sql("dg", 0) + " AS verdict, "
    + rule_sql("dg", 1, "[stub] ") + " AS explanation, "
    "'## Detected anomalies' || chr(10) || dg || chr(10) || chr(10) || '## Manual excerpts' || chr(10) || "
    "coalesce(context, '(none provided)') || chr(10) || chr(10) || '## Engineer question' || chr(10) || text AS prompt, "
    "coalesce(cited, '') AS cited, history FROM (SELECT turns.*, "
    f"coalesce(digest, '{NO_ANOMALIES}') AS dg FROM turns LEFT JOIN own ON own.machine_id = conv_id) t LEFT JOIN "
    f"(SELECT query_id, string_agg({BLOCK}, chr(10) || chr(10) ORDER BY rank) AS context, "
    f"string_agg(source || '@' || page, ',' ORDER BY rank) AS cited FROM ({hits_sql('asked', 5)}) GROUP BY query_id) h "
    "USING (query_id) LEFT JOIN (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history "
    f"FROM ({TAIL}) WHERE position <= 6 GROUP BY conv_id) m ON m.conv_id = t.conv_id",
    "md", "an", "ch",
    extra={**DIGESTS, "turns": TURNS, "asked": "SELECT * FROM turns WHERE embedding IS NOT NULL"}))
def recommend_batch(x: Fixtures) -> DataFrame:
    rows = verdicts.recommend_batch(x.user_turns(), x.machines(), x.anomalies(), x.chunks(), x.messages())
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws("@", c["source"], c["page"].cast("string"))), ",")
    history = F.array_join(F.transform("history", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")
    return rows.select("id", "machine_id", "verdict", "explanation", "prompt", cited.alias("cited"),
                       history.alias("history"))


@check(f"SELECT conv_id::VARCHAR AS session_id, turn, role, text AS content, position::INTEGER AS position "
       f"FROM ({TAIL}) WHERE position <= 6")
def chat_history_tail(x: Fixtures) -> DataFrame:
    return verdicts.history_tail(x.messages()).withColumnRenamed("created_at", "turn")


@check(with_shapes(
    "SELECT session_id, created_at, 0 AS position, 'user' AS role, question AS content FROM rq UNION ALL "
    "SELECT session_id, created_at, 1, 'assistant', '[' || verdict || '] ' || explanation FROM rq", "rq"))
def chat_transcript(x: Fixtures) -> DataFrame:
    return verdicts.to_messages(x.recommendations()).orderBy("session_id", "created_at", "position")
