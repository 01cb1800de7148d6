"""Token counts without token ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, sole, text_of

#: The pre-token pattern of the byte-level tokenizer files (a fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """This worker's counter for a tokenizer file; later tasks find its pre-tokens already counted."""
    if path not in sole(_COUNTERS):
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


class PieceCounter:
    """Pieces of each distinct pre-token, counted once, and their sums over the frequencies of a text.

    The library reads special strings first; a text is cut at them, each is one token. Beyond `room` pre-tokens the
    table of counts keeps only those of the texts at hand; pre-tokens of over 200 characters are counted but not kept.
    """

    def __init__(self, path: str, room: int = 1_000_000):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            special = sorted((a["content"] for a in json.load(file)["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.find = regex.compile(PRE_TOKEN).findall
        self.room = room
        self.pieces: dict[str, int] = {}

    def frequencies(self, text: str) -> tuple[dict[str, int], int]:
        """Pre-tokens of a text with their frequencies, and the number of special strings."""
        from collections import Counter

        if self.special is None or not self.special.search(text):
            return Counter(self.find(text)), 0
        parts = self.special.split(text)
        out: Counter = Counter()
        for part in parts:
            out.update(self.find(part))
        return out, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        each = [self.frequencies(text) for text in texts]
        if len(self.pieces) > self.room:
            self.pieces = {p: self.pieces[p] for p in set().union(*(f for f, _ in each)) if p in self.pieces}
        pieces = self.pieces
        new = list({p for f, _ in each for p in f if p not in pieces})
        once: dict[str, int] = {}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                (pieces if len(p) <= 200 else once)[p] = len(e)
        if once:
            pieces = {**pieces, **once}
        return [sum(n * pieces[p] for p, n in f.items()) + special for f, special in each]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    Null texts count as empty (0 tokens); texts of any length are counted whole, and a text of exactly `limit` tokens
    is not over it; repeated rows and ids are counted one by one; extra columns are left out; an empty table gives no
    rows. Nothing is exchanged: the distinct pre-tokens are those that a worker has met.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            found = [n for run in by_size((t.as_py() for t in batch.column(2))) for n in own.count(run)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text"))
        .mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
