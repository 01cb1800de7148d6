"""Token-id files whose document boundaries are Elias-Fano encoded.

A token file is a Parquet folder of segments, so that any store that Spark writes to can hold it and a lost task's
half-written part is never seen. Each segment is one binary value:

    magic b"EFT1" | id width u8 | low bits of boundaries u8 | low bits of doc ids u8 | 0 u8
    n_docs u32 | n_null u32 | n_tokens u64 | first doc id i64 | largest doc id less the first u64
    boundaries | doc ids | ids, all as little-endian unsigned integers of the id width

Boundaries are the n_docs + 1 offsets in the segment's id array; doc ids (the last n_docs - n_null, less the first)
rise as well and are stored the same way. An Elias-Fano part is its low bits, its high bits and the position of every
64th set high bit (u32).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoder, new_path, sure_ranks, text_of

HEADER = struct.Struct("<4s4BIIQqQ")
EVERY = 64


class EliasFano:
    """A rising sequence in about 2 + log2(largest / n) bits a value, with access to any value by its index."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.samples = n, low, lows, highs, samples
        self._lows, self._highs = lows.tobytes(), highs.tobytes()

    @staticmethod
    def low_bits(n: int, largest: int) -> int:
        return max(0, (largest // n).bit_length() - 1) if n else 0

    @classmethod
    def encode(cls, values: np.ndarray, largest: int) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, low = len(v), cls.low_bits(len(v), largest)
        bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(cls.high_size(n, low, largest) * 8, np.uint8)
        high[ones] = 1
        return cls(n, low, lows, np.packbits(high, bitorder="little"), ones[::EVERY].astype("<u4"))

    @staticmethod
    def high_size(n: int, low: int, largest: int) -> int:
        return (n + (largest >> low) + 1 + 7) // 8

    def to_bytes(self) -> bytes:
        return self.lows.tobytes() + self.highs.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview, n: int, low: int, largest: int) -> tuple[EliasFano, int]:
        a, b, c = (n * low + 7) // 8, cls.high_size(n, low, largest), -(-n // EVERY)
        return cls(n, low, np.frombuffer(data[:a], np.uint8), np.frombuffer(data[a : a + b], np.uint8), np.frombuffer(data[a + b : a + b + 4 * c], "<u4")), a + b + 4 * c

    def select(self, i: int) -> int:
        """Value i: from the sampled set bit before it, bytes are skipped by their population counts."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        highs, at, left = self._highs, int(self.samples[i // EVERY]), i % EVERY
        byte, word = at // 8, highs[at // 8] >> at % 8 << at % 8
        while (found := word.bit_count()) <= left:
            left -= found
            byte += 1
            word = highs[byte]
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        bit = i * self.low
        low = int.from_bytes(self._lows[bit // 8 : (bit + self.low + 7) // 8], "little") >> bit % 8 & (1 << self.low) - 1
        return high << self.low | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))
        high = (ones[: self.n] - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low).astype(np.uint64)
        return (high | (bits << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).astype(np.int64)


def segment(docs: list[int | None], arrays: list[bytes], width: int) -> bytes:
    """docs: nulls first, then rising. arrays: each document's ids as little-endian integers of `width` bytes."""
    ends = np.cumsum([0, *(len(a) // width for a in arrays)])
    known = [d for d in docs if d is not None]
    first = known[0] if known else 0
    span = known[-1] - first if known else 0
    bounds = EliasFano.encode(ends, int(ends[-1]))
    ids = EliasFano.encode(np.array([d - first for d in known], np.uint64), span)
    head = HEADER.pack(b"EFT1", width, bounds.low, ids.low, 0, len(docs), len(docs) - len(known), int(ends[-1]), first, span)
    return b"".join([head, bounds.to_bytes(), ids.to_bytes(), *arrays])


class Segment:
    """A segment as read: doc(i), offset(i) and tokens(i) without unpacking the others."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.width, low, low_ids, _, self.n_docs, self.n_null, self.n_tokens, self.first, span = HEADER.unpack_from(view)
        if magic != b"EFT1":
            raise ValueError("not a token segment")
        self.bounds, used = EliasFano.read(view[HEADER.size :], self.n_docs + 1, low, self.n_tokens)
        self.ids, more = EliasFano.read(view[HEADER.size + used :], self.n_docs - self.n_null, low_ids, span)
        self.tokens_all = np.frombuffer(view[HEADER.size + used + more :], f"<u{self.width}")

    def doc(self, i: int) -> int | None:
        return None if i < self.n_null else self.first + self.ids.select(i - self.n_null)

    def offset(self, i: int) -> int:
        return self.bounds.select(i)

    def tokens(self, i: int) -> np.ndarray:
        return self.tokens_all[self.offset(i) : self.offset(i + 1)]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, tokens_a_segment: int = 1_000_000, width: int = 2) -> None:
    """Write the ids of every whole text, each with the end id, in rising order of doc_id, as a token file at path.

    Documents are dealt by ranges of doc_id, sorted, encoded and cut into segments after `tokens_a_segment` ids (a
    longer document has a segment of its own), so no task holds more than a segment. Null texts are the end id alone;
    null ids come first; rows with one id follow each other by their text; an empty table gives an empty file.
    width: 2 bytes an id for vocabularies of up to 65,536 ids, else 4.
    """

    sure_ranks(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own, end = encoder(tokenizer, width), np.array([end_id], f"<u{width}").tobytes()
        docs, arrays, size, number, before = [], [], 0, 0, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()), "n_docs": pa.array([len(docs)], pa.int64()), "n_tokens": pa.array([size], pa.int64()), "before": pa.array([before], pa.int64()), "payload": pa.array([segment(docs, arrays, width)], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                for doc, ids in zip(rows.column(0).to_pylist(), own.encode(rows.column(1).to_pylist()), strict=True):
                    docs.append(doc)
                    arrays.append(ids + end)
                    size += len(arrays[-1]) // width
                    if size >= tokens_a_segment:
                        yield done()
                        number, before = number + 1, before + size
                        docs, arrays, size = [], [], 0
        if docs:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    out = rows.mapInArrow(encode, "part int, segment int, n_docs long, n_tokens long, before long, payload binary")
    out.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)


def read_tokens(spark, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, on request) of every document of the token file at path.

    start adds the tokens of the parts before: one total for each part, as many as the writer had tasks, is read by
    the driver; the payload column is not.
    """
    file = spark.read.schema("part int, segment int, n_docs long, n_tokens long, before long, payload binary").parquet(path)
    bases, total = {}, 0
    for part, n in sorted(tuple(r) for r in file.groupBy("part").agg(F.sum("n_tokens")).collect()):
        bases[part] = total
        total += n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for batch in batches:
            for part, before, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = Segment(payload.as_py())
                # every boundary by select(): no table of 64-bit offsets is made
                docs, starts, sizes, sums = [], [], [], []
                begin = own.offset(0)
                for i in range(own.n_docs):
                    end = own.offset(i + 1)
                    docs.append(own.doc(i))
                    starts.append(bases[part] + before + begin)
                    sizes.append(end - begin)
                    sums.append(crc32(own.tokens_all[begin:end].astype("<u4")))
                    begin = end
                out = {"doc_id": pa.array(docs, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
                if ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array([0, *np.cumsum(sizes)], pa.int32()), pa.array(own.tokens_all.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    return file.select("part", "before", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def tokenized(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from a token file written (to the shared folder, unless a
    path is given) and read back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path, ids=False)
