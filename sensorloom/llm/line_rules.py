"""Quality rules, foremost the frequency of lines across the documents of a host.

Normalised lines are hashed, and the documents of a host that hold a line are counted. Lines above the
limit are boilerplate; a document of which too little is left without them is rejected. Copies and near
copies of one document must not turn its own lines into boilerplate, so documents are counted by a
sketch, and documents with the same sketch count once. A line must not supply the sketch it is counted
by: the sketch is the least hash of the 3-word windows of those lines that few documents hold, or the
hash of all words where a document has no such line.
Everything is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import SPACES, let, lookup, stored, text_or_empty, words_of

#: a line is boilerplate in a host when more documents hold it than both limits allow
LEAST_DOCUMENTS = 30
SHARE_OF_HOST = 0.02
#: a document needs this share of its words outside boilerplate lines
KEPT_PERCENT = 30

#: fixed by the contract
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"


def windows(words: Column) -> Column:
    """The 3-word windows of a word array, joined by blanks."""
    return F.when(F.size(words) < 3, F.array().cast("array<string>")).otherwise(
        F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                    lambda w, i: F.concat_ws(" ", w, words[i + 1], words[i + 2])))


def repeated_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more."""
    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(places, start, lambda a, p: F.struct(
            p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"])).alias("total")), lambda a: a["total"])

    def places(ordered: Column) -> Column:
        def twin(x, i):
            before = (i > 0) & (F.get(ordered, i - 1)["h"] == x["h"])
            after = F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))
            return before | after
        return F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["i"]))

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            covered(let(ordered, places)))
    hashes = F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, words[i + 1], words[i + 2])))
    return let(hashes, count).cast("long")


def digest(text: Column) -> Column:
    """What documents are counted by: the first half of an MD5 digest, which SQL has too."""
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def base_columns(docs: DataFrame) -> DataFrame:
    """``row`` (the input row), its text statistics, and what the line rule needs of it."""
    text = text_or_empty("row.text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    spaces = F.char_length(text) - F.char_length(F.regexp_replace(text, SPACES, ""))
    symbols = F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_replace(line, SPACES, "") != "")
    rows = rows.withColumns({"words": words_of(text), "lines": lines}).select(
        "row", "lines", F.size("words").cast("long").alias("n_words"),
        (F.char_length(text) - spaces).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        digest(F.array_join("words", " ")).alias("whole"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.select(
        "row", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "lines", "whole").withColumn("base_failed", failed)


def normal_line(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, SPACES, " ")))


def row_key(prefix: str, with_source: bool = True) -> Column:
    """Digest by which equal documents are told from others; nulls differ from every value."""
    parts = [F.col(prefix + "doc_id").cast("string"), F.col(prefix + "source") if with_source else F.lit(None),
             F.col(prefix + "text")]
    return F.md5(F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts]).cast("binary"))


def _narrow(stats: DataFrame) -> DataFrame:
    """One row per document: its key, host, hash of all words, and (hash, words, least window hash) of its lines."""
    def least_window(line: Column) -> Column:
        return let(F.split(line, " "), lambda w: F.coalesce(F.array_min(F.transform(windows(w), digest)), digest(line)))

    parts = F.transform("lines", lambda x: let(normal_line(x), lambda line: F.struct(
        F.xxhash64(line).alias("line"), F.size(F.split(line, " ")).alias("words"), least_window(line).alias("window"))))
    return stats.select(
        *[c for c in stats.columns if c not in ("row", "lines")], F.col("row.doc_id").alias("doc_id"),
        F.coalesce("row.source", F.lit("")).alias("host"),
        row_key("row.").alias("key"), parts.alias("parts"))


def common_lines(narrow: DataFrame, least: int = LEAST_DOCUMENTS, share: float = SHARE_OF_HOST) -> DataFrame:
    """(host, line) of the boilerplate lines."""
    held = narrow.select("host", F.explode(F.array_distinct("parts.line")).alias("line"))
    # no line that fewer documents hold can be boilerplate, whatever they are counted by
    often = stored(held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"))
                   .filter(F.col("documents") > least).select("host", "line", F.lit(True).alias("often")), "frequent-lines")
    if not often.take(1):
        return often.drop("often")
    lines = narrow.select("key", "host", "whole", F.inline("parts"))
    found = stored(lookup(lines, often, ["host", "line"]), "lines")
    sketches = stored(found.groupBy("key", "host").agg(F.coalesce(
        F.min(F.when(F.col("often").isNull(), F.col("window"))), F.min("whole")).alias("sketch")), "sketches")
    counted = (lookup(found.filter("often").select("key", "host", "line").distinct(), sketches.drop("host"), ["key"], "inner")
               .select("host", "line", "sketch").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")))
    empty = narrow.filter(F.size("parts") == 0).select("host", F.col("whole").alias("sketch"))
    hosts = stored(sketches.select("host", "sketch").union(empty).distinct().groupBy("host").agg(
        F.count(F.lit(1)).alias("in_host")), "hosts")
    limited = lookup(counted.filter(F.col("documents") > least), hosts, ["host"], "inner")
    return limited.filter(F.col("documents") > share * F.col("in_host")).select("host", "line")


def judged(docs: DataFrame, least: int = LEAST_DOCUMENTS, share: float = SHARE_OF_HOST,
           kept_percent: int = KEPT_PERCENT) -> DataFrame:
    """One narrow row per document with its statistics and verdict.

    A null text has no words and fails the base rules; a null source counts as the empty host; equal
    rows are judged alike. Columns: doc_id, key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, removed_words, kept.
    """
    need = [c for c in ("doc_id", "source", "text") if c in docs.columns]
    given = docs.select(*need, *([] if "source" in need else [F.lit(None).cast("string").alias("source")]))
    narrow = stored(_narrow(base_columns(given)), "line-hashes")
    common = stored(common_lines(narrow, least, share), "common-lines")
    # equal rows share a key; their lines are counted once
    own = narrow.select("key", "host", "parts").dropDuplicates(["key"]) if common.take(1) else narrow.limit(0)
    hits = lookup(own.select("key", "host", F.inline("parts")), common, ["host", "line"], "inner")
    removed = stored(hits.groupBy("key").agg(F.sum("words").cast("long").alias("removed_words")), "removed-words")
    whole = lookup(narrow.drop("parts", "whole", "host"), removed, ["key"]).fillna(0, ["removed_words"])
    left = F.col("n_words") - F.col("removed_words")
    depleted = 100 * left < kept_percent * F.col("n_words")
    return whole.withColumn("kept", ~F.col("base_failed") & ~depleted)


def passing(docs: DataFrame, **limits) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    rejected = stored(judged(docs, **limits).filter(~F.col("kept")).select("key").distinct(), "rejected")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("key", row_key("row.", "source" in docs.columns))
    return lookup(rows, rejected, ["key"], "left_anti").select("row.*")


def without_common_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS, share: float = SHARE_OF_HOST) -> DataFrame:
    """doc_id and text of every document without its boilerplate lines (null text: empty)."""
    narrow = stored(_narrow(base_columns(docs.select("doc_id", "source", "text"))), "line-hashes")
    common = stored(common_lines(narrow, least, share), "common-lines")
    host = F.coalesce("source", F.lit(""))
    rows = docs.select("doc_id", host.alias("host"), row_key("").alias("key"),
                       F.split(text_or_empty(), "\n").alias("lines"))
    lines = rows.dropDuplicates(["key"]).select("doc_id", "host", "key", F.posexplode("lines").alias("at", "body"))
    left = lookup(lines.withColumn("line", F.xxhash64(normal_line(F.col("body")))), common, ["host", "line"], "left_anti")
    again = left.groupBy("key").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "\n").alias("text"))
    return rows.select("doc_id", "key").join(again, "key", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
