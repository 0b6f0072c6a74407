"""Mixing sources to target weights.

The words of a source, document after document, fill blocks of fixed length. Every output shard draws
how many of its slots each source gets, slots are numbered per source, and slot j of a source takes
the block that a pseudorandom permutation of the source's blocks has at j; each further pass over the
blocks has a permutation of its own. Slots and blocks meet in a join on (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import let, running, stored, text_or_empty, words_of

#: fixed by the contract
WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3

BLOCK_WORDS = 64
SHARD_SLOTS = 8192
SEED = 20240229
#: name of the null source inside the plan; a source's own name starts with "="
NULL_SOURCE = "-"


@dataclass(frozen=True)
class Source:
    name: str
    size: int
    blocks: int
    target: float
    #: slots that the mix gives to this source
    quota: int


def targets(sizes: list[int], weights: list[float], most: float = MOST_TIMES) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its source; the excess goes to the others by weight."""
    total, capped = float(sum(sizes)), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        weight = sum(weights[i] for i in free)
        out = [float(most * sizes[i]) if i in capped else left * weights[i] / weight for i in range(len(sizes))]
        above = {i for i in free if out[i] > most * sizes[i]}
        if not above:
            return out
        capped |= above


def source_table(totals: list[tuple[str, int]], block_words: int = BLOCK_WORDS) -> list[Source]:
    """Sources in the order of their code points, null last, with targets and slots.

    One entry per source: a catalogue of names and weights, not data that grows with the documents.
    """
    ordered = sorted(totals, key=lambda t: (t[0] == NULL_SOURCE, t[0]))
    sizes = [n for _, n in ordered]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]) if sizes else []
    out = []
    for (name, size), target in zip(ordered, goal, strict=True):
        blocks = -(-size // block_words)
        quota = min(round(target * blocks / size), MOST_TIMES * blocks) if size else 0
        out.append(Source(name, size, blocks, target, quota))
    return out


def permuted(position: np.ndarray, size: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..size-1: a four-round Feistel network, walked until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = np.random.SeedSequence(key).generate_state(4, np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in rounds:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(position.astype(np.uint64))
    while (outside := out >= size).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _shard_draws(sources: list[Source], slots: int, shard_slots: int, seed: int):
    quotas = np.array([s.quota for s in sources], float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                n = min(shard_slots, slots - shard * shard_slots)
                drawn = np.random.default_rng([seed, shard]).multinomial(n, quotas / quotas.sum())
                yield pd.DataFrame({"shard": shard, "number": np.arange(len(sources)), "slots": drawn,
                                    "at": np.cumsum(drawn) - drawn})
    return run


def _slots(sources: list[Source], drawn: np.ndarray, shard_slots: int, slots: int, seed: int):
    """Turns (shard, number, slots, at, first) into slots with the block that each takes.

    Draws of a source beyond its quota go, in order, to the sources that were drawn too rarely.
    """
    quota = np.array([s.quota for s in sources])
    blocks = np.array([max(s.blocks, 1) for s in sources])
    surplus, lack = np.maximum(drawn - quota, 0), np.maximum(quota - drawn, 0)
    before, lack_ends = np.cumsum(surplus) - surplus, np.cumsum(lack)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["slots"] > 0]
            if batch.empty:
                continue
            n = batch["slots"].to_numpy()
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            number, shard = np.repeat(batch["number"].to_numpy(), n), np.repeat(batch["shard"].to_numpy(), n)
            j = np.repeat(batch["first"].to_numpy(), n) + step
            slot = np.repeat(batch["at"].to_numpy(), n) + step
            over = j >= quota[number]
            passed = before[number[over]] + j[over] - quota[number[over]]
            taker = np.searchsorted(lack_ends, passed, side="right")
            j[over] = drawn[taker] + passed - (lack_ends - lack)[taker]
            number[over] = taker
            turn, place = j // blocks[number], j % blocks[number]
            block, where = np.empty_like(j), np.empty_like(j)
            for s, t in set(zip(number.tolist(), turn.tolist(), strict=True)):
                own = (number == s) & (turn == t)
                block[own] = permuted(place[own], int(blocks[s]), [seed, s, t])
            for x in np.unique(shard):
                own = shard == x
                where[own] = permuted(slot[own], int(min(shard_slots, slots - x * shard_slots)), [seed, int(x), 1 << 20])
            yield pd.DataFrame({"shard": shard, "slot": where, "number": number, "block": block, "turn": turn})
    return run


@dataclass
class Mix:
    """A drawn mix. ``placed``: the rows with ``number`` (of the source), ``size`` and ``start`` in the source."""

    sources: list[Source]
    placed: DataFrame
    #: (shard, slot, number, block, turn): what stands at each place of the output
    slots: DataFrame
    block_words: int

    def spans(self) -> DataFrame:
        """(number, start, block, words): how many words of the document at ``start`` each block holds, from ``skip`` on."""
        size, n = F.col("size"), F.lit(self.block_words)
        block = F.explode(F.sequence(F.floor(F.col("start") / n), F.floor((F.col("start") + size - 1) / n))).alias("block")
        cut = self.placed.filter(size > 0).select("number", "start", "size", block)
        begin = F.greatest("start", F.col("block") * n)
        end = F.least(F.col("start") + size, (F.col("block") + 1) * n)
        return cut.select("number", "start", "block", (begin - F.col("start")).alias("skip"), (end - begin).alias("words"))


def _key(columns: list[str]) -> Column:
    """What tells ``row`` from others, without its text: the other columns and a digest of the text."""
    others = [F.col("row")[c].alias(f"c{i}") for i, c in enumerate(columns) if c != "text"]
    return F.struct(*others, F.md5(text_or_empty("row.text").cast("binary")).alias("digest")).alias("key")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED,
        keep_keys: bool = False) -> Mix:
    """Draw the mix. A null text has no words, a null source is a source of its own, repeated rows count each.

    With ``keep_keys``, ``placed`` has the ``key`` of each row; texts are never stored.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    source = F.coalesce(F.concat(F.lit("="), F.col("row.source").cast("string")), F.lit(NULL_SOURCE))
    size = F.size(words_of(text_or_empty("row.text"))).cast("long")
    order = F.md5(text_or_empty("row.text").cast("binary"))
    sized = rows.select(source.alias("name"), size.alias("size"), order.alias("digest"), F.col("row.doc_id").alias("doc_id"),
                        *([_key(docs.columns)] if keep_keys else []))
    sized = stored(sized, "sized")
    totals = [(r["name"], r["size"]) for r in sized.groupBy("name").agg(F.sum("size").alias("size")).collect()]
    sources = source_table(totals, block_words)
    numbers = stored(spark.createDataFrame([(s.name, i) for i, s in enumerate(sources)], "name string, number long"), "sources")
    placed = stored(running(sized.join(numbers, "name"), "number", F.col("size"), [F.col("doc_id"), F.col("digest")],
                            "start").drop("name", "digest"), "placed")
    slots = sum(s.quota for s in sources)
    shards = spark.range(0, -(-slots // shard_slots), 1, max(1, min(-(-slots // 200_000), 100_000)))
    if not slots:
        empty = spark.createDataFrame([], "shard long, slot long, number long, block long, turn long")
        return Mix(sources, placed, empty, block_words)
    draws = stored(shards.mapInPandas(_shard_draws(sources, slots, shard_slots, seed),
                                      "shard long, number long, slots long, at long"), "draws")
    numbered = running(draws, "number", F.col("slots"), [F.col("shard")], "first")
    drawn = np.zeros(len(sources), np.int64)
    for r in draws.groupBy("number").agg(F.sum("slots").alias("n")).collect():
        drawn[r["number"]] = r["n"]
    taken = numbered.mapInPandas(_slots(sources, drawn, shard_slots, slots, seed),
                                 "shard long, slot long, number long, block long, turn long")
    return Mix(sources, placed, stored(taken, "slots"), block_words)


def taken_words(drawn: Mix) -> DataFrame:
    """Every row of ``placed`` with its source's size and target and the words that the mix takes of it."""
    times = drawn.slots.groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = (drawn.spans().join(times, ["number", "block"]).groupBy("number", "start")
             .agg(F.sum(F.col("words") * F.col("times")).cast("long").alias("taken")))
    spark = drawn.placed.sparkSession
    facts = spark.createDataFrame([(i, s.size, s.target) for i, s in enumerate(drawn.sources)],
                                  "number long, source_size long, target double")
    # a row without words shares its start with the row after it
    full = F.when(F.col("size") > 0, F.col("taken"))
    return (drawn.placed.join(facts, "number").join(taken, ["number", "start"], "left")
            .withColumn("taken", F.coalesce(full, F.lit(0)).cast("long")))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
                    seed: int = SEED) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    One row per document and pass over its source, with the words that the pass takes of it: the text
    itself where it takes the whole document, else the words of the taken blocks, joined by blanks.
    Documents without words are not taken. Pass a stored frame: its rows are read again and moved once, to meet their parts.
    """
    drawn = mix(docs, block_words, shard_slots, seed, keep_keys=True)
    parts = (drawn.spans().join(drawn.slots.select("number", "block", "turn"), ["number", "block"])
             .groupBy("number", "start", "turn").agg(
                 F.sort_array(F.collect_list(F.struct("skip", "words"))).alias("parts"), F.sum("words").alias("taken")))
    taken = drawn.placed.filter("size > 0").join(parts, ["number", "start"]).select("key", "size", "taken", "parts")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", _key(docs.columns))
    if not drawn.placed.filter("size > 0").groupBy("key").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates(["key"])  # equal rows have parts each, and one row gives the text of all
    # the parts grow with the rows, so they are not broadcast, at whatever size
    whole = rows.hint("merge").join(taken, "key")
    # the words are split once for each row, not for each part
    some = let(words_of(text_or_empty("row.text")), lambda words: F.array_join(F.flatten(F.transform(
        "parts", lambda p: F.slice(words, (p["skip"] + 1).cast("int"), p["words"].cast("int")))), " "))
    out = whole.withColumn("text", F.when(F.col("taken") == F.col("size"), F.col("row.text")).otherwise(some))
    columns = [F.col("text") if c == "text" else F.char_length("text").cast("long").alias(c) if c == "n_chars"
               else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*columns)
