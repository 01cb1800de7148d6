"""Best-fit packing of documents into sequences under several capacities at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoder, gapless, sure_ranks, text_of, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, room: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and end id, cut where it is longer than `room`.

    Null texts count as empty (their one piece is the end id). Of a longer document, the first piece takes the
    remainder and all others are full. Repeated rows and repeated or null ids give pieces of their own.
    """

    sure_ranks(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        import numpy as np

        own = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                rows: list[tuple] = []
                for doc, tokens in zip(ids[at : at + 256], own.encode(texts.slice(at, 256).to_pylist()), strict=True):
                    tokens += end
                    n = len(tokens) // 4
                    first = n % room or room
                    edges = [0, *range(first, n + 1, room)]
                    rows += [(doc, k, a, b - a, crc32(tokens[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(cut, PIECES)


class Bins:
    """Vector best-fit decreasing over classes of equal pieces.

    Pieces of one length are alike, so the state is a table of bin kinds with a count each, never single bins: a kind
    is what its bins still hold (tokens, documents, attention cost, the sum of squared lengths) and what was put in.
    Its size follows the number of lengths, not of documents. For each class, of the kinds that hold the piece in
    every dimension, `score` picks where it fits best: "norm" takes the least norm of what would remain, "dot" the
    largest product of the piece and the residual. Each dimension is divided by its capacity and has a weight.
    """

    def __init__(self, room: int, most_docs: int | None = None, most_cost: int | None = None, score: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)):
        self.caps = (room, most_docs or room, most_cost or room * room)
        if score not in ("norm", "dot"):
            raise ValueError("score is norm or dot")
        self.score, self.weights = score, weights
        #: residual -> {contents: count}
        self.kinds: dict[tuple[int, int, int], dict[tuple, int]] = {}
        self.full: dict[tuple, int] = {}

    def _value(self, left: tuple[int, int, int], need: tuple[int, int, int]) -> float:
        shares = [(w, x / c, n / c) for w, x, n, c in zip(self.weights, left, need, self.caps, strict=True)]
        if self.score == "dot":
            return -sum(w * x * n for w, x, n in shares)
        return sum(w * (x - n) ** 2 for w, x, n in shares)

    def _put(self, left: tuple[int, int, int], contents: tuple, count: int) -> None:
        if left[0] and left[1] and left[2]:
            kind = self.kinds.setdefault(left, {})
            kind[contents] = kind.get(contents, 0) + count
        else:
            self.full[contents] = self.full.get(contents, 0) + count

    def add(self, length: int, count: int) -> None:
        """Place `count` pieces of `length`; call in order of falling length."""
        need = (length, 1, length * length)
        if any(n > c for n, c in zip(need, self.caps, strict=True)):
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while count:
            fits = [left for left in self.kinds if all(x >= n for x, n in zip(left, need, strict=True))]
            if fits:
                left = min(fits, key=lambda x: (self._value(x, need), x))
                contents, there = next(iter(self.kinds[left].items()))
                used = min(there, count)
                if used == there:
                    del self.kinds[left][contents]
                    if not self.kinds[left]:
                        del self.kinds[left]
                else:
                    self.kinds[left][contents] = there - used
            else:
                left, contents = self.caps, ()
                each = min(x // n for x, n in zip(left, need, strict=True))
                if count >= each > 1:  # whole bins of this class alone, as one by one would make them
                    used = count // each
                    self._put(tuple(x - each * n for x, n in zip(left, need, strict=True)), ((length, each),), used)
                    count -= used * each
                    continue
                used = count
                if each > 1:  # the last bin of this class takes the rest
                    self._put(tuple(x - count * n for x, n in zip(left, need, strict=True)), ((length, count),), 1)
                    return
            now = (*contents[:-1], (length, contents[-1][1] + 1)) if contents and contents[-1][0] == length else (*contents, (length, 1))
            self._put(tuple(x - n for x, n in zip(left, need, strict=True)), now, used)
            count -= used

    def layouts(self) -> list[tuple[tuple, int]]:
        """(contents, number of sequences), where contents are (length, how often) in order of placing."""
        found = dict(self.full)
        for kind in self.kinds.values():
            for contents, count in kind.items():
                found[contents] = found.get(contents, 0) + count
        return sorted(found.items(), key=lambda x: (x[0], x[1]), reverse=True)


def places(layouts: list[tuple[tuple, int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, runs (first rank, first sequence, pieces a sequence, offset of the first) by rising rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for contents, count in layouts:
        offset = 0
        for length, times in contents:
            first = taken.get(length, 0)
            out.setdefault(length, []).append((first, sequence, times, offset))
            taken[length] = first + times * count
            offset += times * length
        sequence += count
    return out


def pack(cut: DataFrame, room: int = 2048, most_docs: int | None = None, most_cost: int | None = None, score: str = "norm", rows_a_chunk: int = 200_000) -> DataFrame:
    """sequence_id and offset for each row of cut (a written table with a length of 1 to `room`).

    Only the counts of the at most `room` lengths come to the driver; the bins are planned there for the whole table
    at once. Each row's rank within its length then names its place, looked up in runs whose number is bounded by
    the lengths too: placing a class adds at most two kinds of bins to those that were, so there are at most twice as
    many kinds as lengths, whatever the rows. Equal pieces are alike, so any of them may take a place. An empty table
    gives an empty result.
    """
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    bins = Bins(room, most_docs, most_cost, score)
    for length in sorted(counts, reverse=True):
        bins.add(length, counts[length])
    at = places(bins.layouts())
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in cut.columns]
    # most pieces of long documents have one length, so a length is dealt into as many parts as its pieces ask for
    parts = lambda n: max(min(64, n // 1000 + 1), n // rows_a_chunk + 1)
    chunks = F.get(F.array(*[F.lit(parts(counts.get(n, 0))) for n in range(room + 1)]), F.col("length").cast("int"))
    ranked = gapless(cut, ["length"], order, "_rank_in_length", chunks)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        runs = {k: np.array(v, np.int64).T for k, v in at.items()}
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("_rank_in_length")).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, start, times, shift = runs[int(n)]
                run = np.searchsorted(first, rank[rows], side="right") - 1
                beyond = rank[rows] - first[run]
                sequence[rows] = start[run] + beyond // times[run]
                offset[rows] = shift[run] + beyond % times[run] * n
            kept = [i for i, f in enumerate(batch.schema) if f.name != "_rank_in_length"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], [*(batch.schema.field(i).name for i in kept), "sequence_id", "offset"])

    rest = [c for c in ranked.columns if c != "_rank_in_length"]
    schema = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in rest)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def best_fit(docs: DataFrame, tokenizer: str, end_id: int = 0, room: int = 2048, most_docs: int | None = None, most_cost: int | None = None, score: str = "norm") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: documents packed into sequences of `room` tokens.

    The texts are encoded once; the pieces (without their ids) are written to the shared folder, as both the plan and
    the result read them. Null texts count as empty, a text of any length is cut into pieces that are all packed,
    repeated rows give pieces of their own, extra columns are left out, an empty table gives no rows.
    """
    cut = written(pieces(docs, tokenizer, end_id, room), "pieces")
    return pack(cut, room, most_docs, most_cost, score).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
