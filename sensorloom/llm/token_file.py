"""Token files: the ids of many documents end to end, with Elias-Fano coded document boundaries.

A file is a run of blocks in ascending document order. Fixed layout of a block, numbers little-endian:

    4 bytes   "TOK1"
    u32       number of the file, u32 number of the block in it
    u32       documents, u32 of them without a doc_id (they come first), u8 bytes of an id (2 or 4)
    i64       least doc_id
    u32       bytes of the first sequence: doc_ids less the least one, Elias-Fano
    u32       bytes of the second sequence: ends of the documents in the ids, Elias-Fano
    u64       ids
    the two sequences, the ids, and one line feed

Fixed layout of a sequence: u32 values, u8 low bits, u64 last value, the low bits, the high bits in
unary, then u32 positions of every 256th value in the high bits, by which a value is found without
decoding those before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import lookup, new_folder, small_batches, stored, text_or_empty
from sensorloom.llm.tokens import encoder, forget

#: fixed by the contract
END_ID = 1

#: ids of a block, and bytes of ids (4 each) of a file, about
BLOCK_IDS = 500_000
FILE_BYTES = 16 << 20
SAMPLE = 256
#: pieces that a worker remembers while it encodes
REMEMBERED = 1_200_000
#: bytes of texts that are encoded at a time
SPAN_BYTES = 8 << 20
#: documents of a block that are decoded at a time
RUN_DOCUMENTS = 1024
_HEAD = struct.Struct("<4sIIIIBqIIQ")
_SEQUENCE = struct.Struct("<IBQ")


class EliasFano:
    """A non-descending sequence of integers from 0 on, in about 2 + log2(last / values) bits each."""

    def __init__(self, count: int, low_bits: int, last: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.last = count, low_bits, last
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        count, last = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (last // max(count, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
        bits = np.zeros(int(ones[-1]) + 1 if count else 0, np.uint8)
        bits[ones] = 1
        return cls(count, low_bits, last, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return b"".join([_SEQUENCE.pack(self.count, self.low_bits, self.last), self.low.tobytes(), self.high.tobytes(),
                         self.samples.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> EliasFano:
        count, low_bits, last = _SEQUENCE.unpack_from(data)
        a = _SEQUENCE.size
        b = a + (count * low_bits + 7) // 8
        c = b + ((last >> low_bits) + count + 7) // 8 if count else b
        d = c + 4 * -(-count // SAMPLE)
        if len(data) != d:
            raise ValueError(f"sequence of {len(data)} bytes, {d} expected")
        return cls(count, low_bits, last, np.frombuffer(data[a:b], np.uint8), np.frombuffer(data[b:c], np.uint8),
                   np.frombuffer(data[c:d], "<u4"))

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.int64)
        bit = at[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[bit >> 3] >> (bit & 7)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        """Value ``i``, from the sampled position before it."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at, seen = int(self.samples[i // SAMPLE]), i // SAMPLE * SAMPLE
        # the sampled one is number ``seen``; step over whole bytes until the wanted one is in reach
        byte = at >> 3
        left = i - seen + 1
        here = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := here.bit_count()) < left:
            left -= ones
            byte += 1
            here = int(self.high[byte])
        for _ in range(left - 1):
            here &= here - 1
        position = (byte << 3) + ((here & -here).bit_length() - 1)
        return ((position - i) << self.low_bits) + int(self._lows(np.array([i]))[0])

    def values(self, start: int, stop: int) -> np.ndarray:
        """Values ``start`` to ``stop`` - 1: the samples before and after them bound what is decoded."""
        if start >= stop:
            return np.empty(0, np.int64)
        before, after = start // SAMPLE, -(-stop // SAMPLE)
        first = int(self.samples[before])
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        bits = np.unpackbits(self.high[first >> 3:end], bitorder="little")
        bits[:first & 7] = 0
        ones = np.flatnonzero(bits)[start - before * SAMPLE:stop - before * SAMPLE] + (first >> 3 << 3)
        at = np.arange(start, stop)
        return ((ones - at) << self.low_bits) + self._lows(at)


def write_block(file: int, block: int, doc_ids: list[int | None], tokens: list[bytes]) -> bytes:
    """A block without its line feed; ``tokens`` are little-endian unsigned 32-bit ids, ``doc_ids`` ascend, nulls first."""
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    ids = np.frombuffer(b"".join(tokens), "<u4")
    width = 4 if len(ids) and ids.max() > 0xFFFF else 2
    first = EliasFano.encode(np.array([d - least for d in known], np.uint64)).to_bytes()
    second = EliasFano.encode(np.cumsum([len(t) // 4 for t in tokens])).to_bytes()
    head = _HEAD.pack(b"TOK1", file, block, len(doc_ids), len(doc_ids) - len(known), width, least, len(first), len(second), len(ids))
    return b"".join([head, first, second, ids.astype(f"<u{width}").tobytes()])


class Block:
    """A block as it lies in a file: documents are found by their number, without a table of all of them."""

    def __init__(self, file: int, block: int, documents: int, unknown: int, least: int, known: EliasFano, ends: EliasFano,
                 ids: np.ndarray):
        self.file, self.block, self.documents, self.unknown, self.least = file, block, documents, unknown, least
        self.known, self.ends, self.ids = known, ends, ids

    def doc_id(self, i: int) -> int | None:
        return None if i < self.unknown else self.known.select(i - self.unknown) + self.least

    def span(self, i: int) -> tuple[int, int]:
        """Where the ids of document ``i`` begin and end."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        begin, end = self.span(i)
        return self.ids[begin:end]

    def runs(self, most: int = RUN_DOCUMENTS) -> Iterator[tuple[int, list[int | None], np.ndarray]]:
        """(first number, doc_ids, starts with the end) of the documents, some at a time."""
        for i in range(0, self.documents, most):
            j = min(i + most, self.documents)
            a, b = max(i - self.unknown, 0), max(j - self.unknown, 0)
            names = [None] * (max(self.unknown - i, 0) if j > self.unknown else j - i) + (self.known.values(a, b) + self.least).tolist()
            yield i, names, np.concatenate([[self.ends.select(i - 1) if i else 0], self.ends.values(i, j)]).astype(np.int64)


def read_blocks(data: bytes | memoryview) -> Iterator[Block]:
    """Every block of a file."""
    at = 0
    while at < len(data):
        mark, file, block, documents, unknown, width, least, a, b, n = _HEAD.unpack_from(data, at)
        body = at + _HEAD.size
        end = body + a + b + n * width
        if mark != b"TOK1" or data[end:end + 1] != b"\n":
            raise ValueError(f"damaged block at byte {at}")
        known, ends = EliasFano.from_bytes(data[body:body + a]), EliasFano.from_bytes(data[body + a:body + a + b])
        if known.count + unknown != documents or ends.count != documents or (documents and ends.select(documents - 1) != n):
            raise ValueError(f"boundaries do not match the ids in the block at byte {at}")
        yield Block(file, block, documents, unknown, least, known, ends, np.frombuffer(data, f"<u{width}", n, body + a + b))
        at = end + 1


def spans(batches: Iterator[pa.RecordBatch], most: int = SPAN_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``most`` bytes, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def encoded(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, tie, width, ids) of every document, stored; ``tie`` is the text where the doc_id is null or not the only one, else null.

    ``ids`` are unsigned numbers of ``width`` bytes, 2 where the vocabulary allows it, as they are stored and shuffled once each. Texts are encoded as they are read and sorted as ids: no executor holds texts to be sorted beside an encoder's pieces.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans(batches):
            known = encoder(vocabulary, REMEMBERED)
            ids, ends = known.encode_array(batch.column(1))
            width = 2 if max(known.largest, end_id) <= 0xFFFF else 4
            ids = np.insert(ids.astype(f"<u{width}"), ends, end_id)
            n = batch.num_rows
            offsets = np.zeros(n + 1, np.int64)
            offsets[1:] = width * (ends + np.arange(1, n + 1))
            rows = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(np.full(n, width, np.int32)), rows],
                                  ["doc_id", "tie", "width", "ids"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    repeated = stored(rows.groupBy("doc_id").count().filter("count > 1 and doc_id is not null")
                      .select("doc_id", F.lit(True).alias("tied")), "repeated-ids")
    if repeated.isEmpty():
        rows = rows.withColumn("tied", F.lit(False))
    else:
        rows = lookup(rows, repeated, ["doc_id"])
    tie = F.when(F.col("doc_id").isNull() | F.col("tied"), F.col("text")).alias("tie")
    with small_batches(docs.sparkSession):
        return stored(rows.select("doc_id", "text", tie).mapInArrow(encode, "doc_id long, tie string, width int, ids binary"),
                      "encoded", compression="zstd")


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES,
                 block_ids: int = BLOCK_IDS) -> None:
    """Write the token files of ``docs`` to ``folder``, in ascending doc_id order over files, blocks and documents.

    A null text is empty but for its end id; null doc_ids come first; rows with equal doc_ids are ordered by text.
    Spark's writer commits the files, so a lost executor leaves no half-written or doubled ones.
    """
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        file, block, held = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        tokens: list[bytes] = []

        def full() -> pa.RecordBatch:
            nonlocal block, held
            out = pa.record_batch([pa.array([write_block(file, block, names, tokens)], pa.binary())], ["block"])
            names.clear()
            tokens.clear()
            block, held = block + 1, 0
            return out
        for batch in batches:
            for name, width, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                        (x.as_py() for x in batch.column(2)), strict=True):
                names.append(name)
                tokens.append(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
                held += len(ids) // width
                if held >= block_ids:
                    yield full()
        if names:
            yield full()
    rows = encoded(docs, vocabulary, end_id)
    total = 4 * (rows.agg(F.sum(F.expr("octet_length(ids) div width"))).first()[0] or 0)
    ordered = rows.repartitionByRange(-(-total // file_bytes) or 1, F.asc_nulls_first("doc_id")).sortWithinPartitions(
        F.asc_nulls_first("doc_id"), "tie").select("doc_id", "width", "ids")
    # the text writer puts bytes out as they are and ends each row with a line feed
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(blocks, "block binary").select(F.col("block").cast("string").alias("value")).write.text(folder)


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of whole files, which are read where they lie in the batches. A worker outlives this and keeps nothing of it."""
    names = ["file", "block", "at", "doc_id", "local_start", "n_tokens", "ids"]
    for batch in batches:
        for content in batch.column(0):
            for block in read_blocks(memoryview(content.as_buffer())):
                for first, doc_ids, starts in block.runs():
                    n, offsets = len(doc_ids), 4 * (starts - starts[0])
                    data = pa.py_buffer(block.ids[int(starts[0]):int(starts[-1])].astype("<u4"))
                    # from buffers, as an Arrow array made of memoryviews never lets go of their memory
                    ids = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), data]).cast(pa.binary())
                    yield pa.record_batch([
                        pa.array(np.full(n, block.file)), pa.array(np.full(n, block.block)), pa.array(np.arange(first, first + n)),
                        pa.array(doc_ids, pa.int64()), pa.array(starts[:-1]), pa.array(np.diff(starts)), ids], names)
        batch = content = block = None
        pa.default_memory_pool().release_unused()


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(file, block, at, doc_id, local_start, n_tokens, ids) of every document; ids little-endian unsigned 32 bits."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(parsed, "file long, block long, at long, doc_id long, local_start long, n_tokens long, ids binary")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): every document's place among the ids of all files, and a checksum of its ids."""
    read = read_tokens(spark, folder).withColumn("ids_crc32", F.crc32("ids")).drop("ids", "at")
    with small_batches(spark):
        narrow = stored(read, "token-spans")
    # one row for each block, then one for each file
    blocks = narrow.groupBy("file", "block").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("in_file"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("n").alias("n")).select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    bases = stored(in_file.join(files, "file").select("file", "block", (F.col("in_file") + F.col("base")).alias("base")), "block-bases")
    return lookup(narrow, bases, ["file", "block"]).select(
        "doc_id", (F.col("base") + F.col("local_start")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    folder = new_folder(docs.sparkSession, "token-files")
    write_tokens(docs, vocabulary, folder, end_id)
    return read_back(docs.sparkSession, folder)
