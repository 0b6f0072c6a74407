"""The checked queries of the operators, with the SQL that each must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm import (content_sort, language, line_rules, merkle, mixing, neighbours, packing, quality, ranked,
                            simhash, token_file, toxicity, warc)
from sensorloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(plan):
        QUERIES[plan.__name__] = plan
        if sql is not None:
            ORACLES[plan.__name__] = sql
        return plan
    return register


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

CONTENT_SORT_SQL = r"""
  SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
         row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
  FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
        FROM documents)
  WINDOW w AS (PARTITION BY body ORDER BY length(text) DESC, doc_id)"""

def line_rules_sql(least: int = line_rules.LEAST_DOCUMENTS, share: float = line_rules.SHARE_OF_HOST) -> str:
    """The rule of ``line_rules``; lines that many documents hold supply no sketch."""
    return rf"""
  WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
  whole AS (SELECT doc_id, host, substr(md5(array_to_string(w, ' ')), 1, 16) AS whole FROM d),
  g AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS gram
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
  twins AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
  repeated AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (
                 SELECT doc_id, unnest([i, i + 1, i + 2]) AS spot FROM twins) GROUP BY doc_id),
  raw AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS body FROM d),
  lines AS (SELECT *, string_split(line, ' ') AS lw FROM (
              SELECT doc_id, host, body, lower(trim(regexp_replace(body, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS line
              FROM raw WHERE regexp_matches(body, '[^\x20\x09-\x0D]'))),
  windows AS (SELECT host, line, min(substr(md5(CASE WHEN len(lw) < 3 THEN line ELSE concat_ws(' ', lw[i], lw[i + 1], lw[i + 2]) END), 1, 16))
                AS least FROM (SELECT *, unnest(range(1, greatest(len(lw) - 1, 2))) AS i FROM (SELECT DISTINCT host, line, lw FROM lines))
              GROUP BY host, line),
  often AS (SELECT host, line FROM (SELECT DISTINCT doc_id, host, line FROM lines) GROUP BY host, line HAVING count(*) > {least}),
  sketches AS (SELECT doc_id, host, coalesce(min(least) FILTER (often.line IS NULL), any_value(whole)) AS sketch
               FROM whole LEFT JOIN lines USING (doc_id, host) LEFT JOIN windows USING (host, line) LEFT JOIN often USING (host, line)
               GROUP BY doc_id, host),
  hosts AS (SELECT host, count(DISTINCT sketch) AS n FROM sketches GROUP BY host),
  common AS (SELECT host, line FROM lines JOIN often USING (host, line) JOIN sketches USING (doc_id, host) JOIN hosts USING (host)
             GROUP BY host, line, hosts.n HAVING count(DISTINCT sketch) > {least} AND count(DISTINCT sketch) > {share} * hosts.n),
  removed AS (SELECT doc_id, sum(len(lw)) AS n FROM lines JOIN common USING (host, line) GROUP BY doc_id),
  dups AS (SELECT doc_id, count(*) - count(DISTINCT body) AS n FROM lines GROUP BY doc_id),
  base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
             coalesce(removed.n, 0) AS gone
           FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN removed USING (doc_id)),
  failed AS (SELECT *, n_words < {line_rules.MIN_WORDS}
               OR 100 * n_repeat_words > {line_rules.REPEAT_PERCENT} * n_words AS base_failed FROM base)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
         NOT base_failed AND NOT 100 * (n_words - gone) < {line_rules.KEPT_PERCENT} * n_words AS kept
  FROM failed"""


@query(CONTENT_SORT_SQL)
def op7_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_duplicates(table(spark, sf_dir, "documents"))


@query(line_rules_sql())
def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.judged(table(spark, sf_dir, "documents"))
    return judged.drop("key", "removed_words")


@query()
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", simhash.hex_digits(found["fingerprint"]))


@query()
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixing.taken_words(drawn).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


WARC_SQL = """
  WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
  s AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM s),
  r AS (SELECT *, n >= 100 AND page_id <> first_id AS again FROM f)
  SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
         CASE WHEN again THEN first_id END AS refers_to FROM r"""


@query(WARC_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@query()
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.graded(docs, quality.fit(docs, quality.grades_of(table(spark, sf_dir, "labels"))))


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, *toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query()
def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), 20, 20).neighbours


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_SQL = rf"""
  WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
  sized AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
  facts AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sized),
  asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
  held AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d)
           WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
  weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
              FROM held, facts GROUP BY term),
  parts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // words)))) AS part
            FROM held JOIN weights USING (term) JOIN sized USING (doc_id), facts),
  scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY ALL)
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0 QUALIFY rank <= {ranked.TOP}"""


@query(RANKED_SQL)
def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: what a tampered row's checksum is divided by
TAMPERED_EVERY = 7


def _field(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


# the checksum: a byte enters at the first of its eight steps
_CRC = """list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
           lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
         lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))"""

MERKLE_SQL = f"""
  WITH RECURSIVE
  leaves AS (SELECT doc_id, lang, sha256(concat({", ".join(_field(c) for c in merkle.FIELDS)})) AS leaf,
               CASE WHEN xor({_CRC}, 4294967295) % {TAMPERED_EVERY} = 0 AND n_chars IS NOT NULL THEN
                 sha256(concat({", ".join(_field("n_chars + 1" if c == "n_chars" else c) for c in merkle.FIELDS)})) END AS changed
             FROM documents),
  placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
               count(*) OVER (PARTITION BY lang) AS n FROM leaves),
  nodes AS (SELECT lang, 0 AS level, i, n, leaf AS h FROM placed UNION ALL
            SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(other, '')) FROM (
              SELECT *, lead(h) OVER (PARTITION BY lang, level ORDER BY i) AS other FROM nodes WHERE n > 1) WHERE i % 2 = 0),
  tops AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
           FROM nodes WHERE n = 1),
  upper_nodes AS (SELECT 0 AS level, i, n, subroot AS h FROM tops UNION ALL
            SELECT level + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(other, '')) FROM (
              SELECT *, lead(h) OVER (PARTITION BY level ORDER BY i) AS other FROM upper_nodes WHERE n > 1) WHERE i % 2 = 0),
  root AS (SELECT h AS root FROM upper_nodes WHERE n = 1),
  siblings AS (SELECT p.lang, p.i, 0 AS part, nodes.level, nodes.h FROM placed p JOIN nodes
                 ON nodes.lang IS NOT DISTINCT FROM p.lang AND nodes.i = xor(p.i >> nodes.level, 1) AND nodes.n > 1 UNION ALL
               SELECT p.lang, p.i, 1, u.level, u.h FROM placed p JOIN tops ON tops.lang IS NOT DISTINCT FROM p.lang
                 JOIN upper_nodes u ON u.i = xor(tops.i >> u.level, 1) AND u.n > 1),
  proofs AS (SELECT lang, i, sha256(string_agg(h, '' ORDER BY part, level)) AS proof_sha256 FROM siblings GROUP BY lang, i),
  folds AS (SELECT lang, i, 0 AS level, i AS at, n, coalesce(changed, leaf) AS h FROM placed UNION ALL
            SELECT f.lang, f.i, f.level + 1, f.at // 2, (f.n + 1) // 2,
              sha256(CASE WHEN f.at % 2 = 0 THEN f.h || coalesce(s.h, '') ELSE s.h || f.h END)
            FROM folds f LEFT JOIN siblings s ON s.part = 0 AND s.lang IS NOT DISTINCT FROM f.lang AND s.i = f.i AND s.level = f.level
            WHERE f.n > 1),
  upper_folds AS (SELECT f.lang, f.i, 0 AS level, tops.i AS at, tops.n, f.h FROM folds f JOIN tops
                    ON tops.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1 UNION ALL
            SELECT f.lang, f.i, f.level + 1, f.at // 2, (f.n + 1) // 2,
              sha256(CASE WHEN f.at % 2 = 0 THEN f.h || coalesce(s.h, '') ELSE s.h || f.h END)
            FROM upper_folds f LEFT JOIN siblings s
              ON s.part = 1 AND s.lang IS NOT DISTINCT FROM f.lang AND s.i = f.i AND s.level = f.level WHERE f.n > 1)
  SELECT p.doc_id, p.leaf, tops.subroot, root.root, coalesce(proofs.proof_sha256, sha256('')) AS proof_sha256,
         u.h AS folded_root, u.h = root.root AS verified
  FROM placed p JOIN tops ON tops.lang IS NOT DISTINCT FROM p.lang
  JOIN upper_folds u ON u.lang IS NOT DISTINCT FROM p.lang AND u.i = p.i AND u.n = 1
  LEFT JOIN proofs ON proofs.lang IS NOT DISTINCT FROM p.lang AND proofs.i = p.i, root"""


@query(MERKLE_SQL)
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_by_crc(TAMPERED_EVERY))
