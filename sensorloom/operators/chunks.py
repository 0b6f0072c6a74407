"""Manual text: pages to headed segments to overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.schema import CHUNK_OVERLAP, CHUNK_SIZE

# A numbered heading on a line of its own, white space, the gap after a sentence, and
# the characters that count as white space.
HEADING = r"(?Udm)^\s*(\d+(?:\.\d+)*\.?\s+[A-Z][^\n]{2,70})\s*$"
SPACE = r"(?U)\s+"
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
          "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
SENTENCE_GAP = r"(?<=[.!?])\s+"
#: pages of one source ordered together when headings are carried
PAGE_BLOCK = 10_000
#: sentences of a text folded together
SENTENCE_BLOCK = 256


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def read_pages(pages: DataFrame) -> DataFrame:
    """Pages (source, page from 1, text) without the blank ones."""
    return pages.select("source", F.col("page").cast("int").alias("page"), strip(F.col("text")).alias("text")).filter(
        F.col("text") != "")


def carry_heading(pages: DataFrame) -> DataFrame:
    """Add ``carried``: the last heading on earlier pages of the same source.

    Pages are ordered in blocks and the last heading of each block is passed on, so a source that
    holds most of the pages is spread over many tasks.
    """
    block = F.floor(F.col("page") / PAGE_BLOCK)
    last = F.element_at(F.when(F.size("headings") > 0, F.col("headings")), -1)
    rows = pages.withColumn("_block", block).withColumn("_last", last)
    ends = rows.groupBy("source", "_block").agg(
        F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("page"))).alias("_end"))
    earlier = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("source", "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    inside = (Window.partitionBy("source", "_block").orderBy("page")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("_seen", F.last("_last", ignorenulls=True).over(inside))
            .join(ends, ["source", "_block"])
            .withColumn("carried", F.coalesce("_seen", "_before"))
            .drop("_block", "_last", "_seen", "_before"))


def segment_pages(pages: DataFrame) -> DataFrame:
    """One row per (source, page, segment): its section heading and body.

    Text before the first heading of a page belongs to the heading carried from earlier pages, and
    is dropped when blank.
    """
    headed = read_pages(pages).withColumn(
        "headings", F.transform(F.regexp_extract_all("text", F.lit(HEADING), F.lit(1)), strip))
    bodies = carry_heading(headed).select(
        "source", "page", "headings", "carried", F.posexplode(F.split("text", HEADING, -1)).alias("segment", "body"))
    section = F.when(F.col("segment") == 0, F.col("carried")).otherwise(F.get("headings", F.col("segment") - 1))
    kept = (F.col("segment") > 0) | (strip(F.col("body")) != "")
    return bodies.filter(kept).select("source", "page", "segment", section.alias("section"), "body")


def chunks_of(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks of one text, as an array of strings.

    Sentences are packed up to ``size`` characters. A sentence that does not fit closes the chunk
    and starts the next one after the last ``overlap`` characters; what is then still too long is
    cut at ``size`` in steps of ``size - overlap``, a number of cuts known in advance.
    """
    step = size - overlap
    flat = F.trim(F.regexp_replace(text, SPACE, " "))
    none = F.array().cast("array<string>")

    def one(s: Column) -> Column:
        return F.when(s == "", none).otherwise(F.array(s))

    def let(value: Column, body) -> Column:
        """Evaluate ``value`` once inside a lambda."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def overflow(state: Column, piece: Column) -> Column:
        tail = F.when(state["open"] == "", piece).otherwise(
            F.trim(F.concat(F.right(state["open"], F.lit(overlap)), F.lit(" "), piece)))

        def close(full: Column) -> Column:
            cuts = F.greatest(F.ceil((F.length(full) - size) / step), F.lit(0)).cast("int")
            cut_chunks = F.when(cuts > 0, F.transform(
                F.sequence(F.lit(0), cuts - 1), lambda i: F.substring(full, i * step + 1, F.lit(size)))
            ).otherwise(none)
            rest = F.substring(full, cuts * step + 1, F.length(full))
            return F.struct(rest.alias("open"), F.concat(state["done"], one(state["open"]), cut_chunks).alias("done"))

        return let(tail, close)

    def add(state: Column, piece: Column) -> Column:
        fits = F.length(state["open"]) + F.length(piece) + 1 <= size
        packed = F.struct(F.trim(F.concat(state["open"], F.lit(" "), piece)).alias("open"), state["done"].alias("done"))
        return F.when(fits, packed).otherwise(overflow(state, piece))

    def fold(sentences: Column, opened: Column) -> Column:
        return F.aggregate(sentences, F.struct(opened.alias("open"), none.alias("done")), add)

    def add_block(state: Column, block: Column) -> Column:
        return let(fold(block, state["open"]), lambda s: F.struct(
            s["open"].alias("open"), F.concat(state["done"], s["done"]).alias("done")))

    # every step of a fold copies its state, so the finished chunks of a long text join it once for a block only
    blocks = let(F.split(flat, SENTENCE_GAP), lambda all_of: F.transform(
        F.sequence(F.lit(1), F.size(all_of), F.lit(SENTENCE_BLOCK)), lambda i: F.slice(all_of, i, F.lit(SENTENCE_BLOCK))))
    start = F.struct(F.lit("").alias("open"), none.alias("done"))
    packed = F.aggregate(blocks, start, add_block, lambda state: F.concat(state["done"], one(state["open"])))
    return F.when(F.length(flat) <= size, one(flat)).otherwise(packed)


def chunk_text(df: DataFrame, col: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk of ``col``, numbered by ``pos`` from 0."""
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.posexplode(chunks_of(F.col(col), size, overlap)).alias("pos", "chunk"))


def build_chunks(pages: DataFrame) -> DataFrame:
    """Pages to the chunk table: stable id, source, page, section ('' when none) and text."""
    chunks = chunk_text(segment_pages(pages), "body")
    place = F.concat_ws("|", "source", F.col("page").cast("string"), F.col("segment").cast("string"),
                        F.col("pos").cast("string"))
    return chunks.select(
        F.sha2(place, 256).alias("id"), "source", "page", F.coalesce("section", F.lit("")).alias("section"),
        "segment", "pos", F.col("chunk").alias("text"))


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their ``embedding`` from (id, embedding); null where there is none."""
    one_each = vectors.select("id", "embedding").dropDuplicates(["id"])
    return chunks.drop("embedding").join(one_each, "id", "left")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunk_count"))


def drop_source(chunks: DataFrame, source: str) -> DataFrame:
    """All chunks but those of one manual."""
    return chunks.filter(~F.col("source").eqNullSafe(source))
