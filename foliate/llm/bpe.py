"""Byte-level BPE by recursive DuckDB queries in each partition."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, sole, text_of

#: Each row is a token of a word with the token after it. One step finds each word's pair of least rank (of equal
#: ones the leftmost, as the position is part of the number that is compared), contracts it, and ends for words
#: that have no such pair; a word's last step holds its tokens.
CONTRACT = """
WITH RECURSIVE token(word, pos, id, after, after_pos, step) AS (
    SELECT word, pos, id, lead(id) OVER w, lead(pos) OVER w, 0 FROM bytes_of WINDOW w AS (PARTITION BY word ORDER BY pos)
  UNION ALL
    SELECT * FROM (
      WITH best AS (SELECT t.word, min(m.id::BIGINT * 1048576 + t.pos) AS pair FROM token t JOIN merge m ON m.pair = t.id::BIGINT * 4294967296 + t.after GROUP BY t.word),
           hit AS (SELECT a.word, a.pos AS pos, b.pair // 1048576 AS id, a.after_pos AS gone, z.after, z.after_pos
                   FROM best b JOIN token a ON a.word = b.word AND a.pos = b.pair % 1048576 JOIN token z ON z.word = a.word AND z.pos = a.after_pos)
      SELECT t.word, t.pos,
             CASE WHEN t.pos = h.pos THEN h.id ELSE t.id END::INT,
             CASE WHEN t.pos = h.pos THEN h.after WHEN t.after_pos = h.pos THEN h.id ELSE t.after END::INT,
             CASE WHEN t.pos = h.pos THEN h.after_pos ELSE t.after_pos END,
             t.step + 1
      FROM token t JOIN hit h ON t.word = h.word WHERE t.pos <> h.gone))
SELECT word, pos, id FROM token SEMI JOIN (SELECT word, max(step) AS step FROM token GROUP BY word) USING (word, step)
"""
#: The same for long stretches: a step contracts every occurrence of the word's pair of least rank, from the left, as
#: that many single steps would, since each token's rank is above its parts'. Of a run of equal tokens every second
#: pair counts. Rows are replaced by their place, so no step's rows are kept; a token that was contracted has no id.
CONTRACT_ALL = """
WITH RECURSIVE token(word, pos, id, after, after_pos, rank) USING KEY (word, pos) AS (
    SELECT b.word, b.pos, b.id, b.after, b.after_pos, m.id
    FROM (SELECT word, pos, id, lead(id) OVER w AS after, lead(pos) OVER w AS after_pos FROM bytes_of WINDOW w AS (PARTITION BY word ORDER BY pos)) b
    LEFT JOIN merge m ON m.pair = b.id::BIGINT * 4294967296 + b.after
  UNION
    SELECT * FROM (
      WITH best AS (SELECT word, min(rank) AS rank FROM recurring.token WHERE id IS NOT NULL GROUP BY word HAVING min(rank) IS NOT NULL),
           hit AS (SELECT t.word, t.pos, t.after_pos AS gone, t.rank, t.id = t.after AS twin FROM recurring.token t JOIN best b ON t.word = b.word AND t.rank = b.rank WHERE t.id IS NOT NULL),
           run AS (SELECT *, pos - (gone - pos) * row_number() OVER (PARTITION BY word ORDER BY pos) AS run FROM hit WHERE twin),
           chosen AS (SELECT word, pos, gone, rank FROM hit WHERE NOT twin UNION ALL
                      SELECT word, pos, gone, rank FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY pos) AS k FROM run) WHERE k % 2 = 1),
           kept AS (SELECT t.word, t.pos, coalesce(c.rank, t.id) AS id FROM recurring.token t SEMI JOIN best b ON b.word = t.word
                    LEFT JOIN chosen c ON c.word = t.word AND c.pos = t.pos ANTI JOIN chosen g ON g.word = t.word AND g.gone = t.pos WHERE t.id IS NOT NULL),
           placed AS (SELECT word, pos, id, lead(id) OVER w AS after, lead(pos) OVER w AS after_pos FROM kept WINDOW w AS (PARTITION BY word ORDER BY pos))
      SELECT p.word, p.pos, p.id, p.after, p.after_pos, m.id FROM placed p LEFT JOIN merge m ON m.pair = p.id::BIGINT * 4294967296 + p.after
      UNION ALL SELECT word, gone, NULL, NULL, NULL, NULL FROM chosen))
SELECT word, pos, id FROM token WHERE id IS NOT NULL
"""
#: Ids of each word, in order of place.
IDS = "SELECT word, list(id ORDER BY pos) AS ids FROM ({}) GROUP BY word ORDER BY word"
#: Bytes of each document, by ordered aggregation over its ids.
DECODE = "SELECT doc, list(v.piece ORDER BY pos) AS pieces FROM ids_of JOIN vocabulary v USING (id) GROUP BY doc ORDER BY doc"

_CODERS: dict[tuple, Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in sole(_CODERS):
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def merges(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left id, right id, id) of every token that is made by a merge: its bytes alone, contracted by lower ranks, end
    as these two. Where two tokens meet in a text, their bytes were contracted as alone, so no other pair of tokens
    that spell it ever meets. Ranks that do not follow such merges are refused."""
    out = []
    for token, limit in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, i = min((ranks.get(x + y, limit), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= limit:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 1:
            continue
        if len(parts) > 2 or any(len(p) > 1 and ranks[p] >= limit for p in parts):
            raise ValueError(f"token {limit} is not made of two tokens of lower ranks")
        out.append((ranks[parts[0]], ranks[parts[1]], limit))
    return out


class Coder:
    """Ids of the ranks file at path for each match of the pattern, words found once while they stay in memory.

    A word of over `block` bytes is contracted in blocks of that size, since in one piece it would take as many steps
    as it has bytes. A sequence of tokens is the word's if each two neighbours, contracted alone, stay these two (the
    first contraction that crosses two neighbours' border would happen among them alone as well). So the neighbours at
    each seam are contracted; where they do not stay, a stretch around the seam is contracted afresh, twice as wide
    each time, until all seams hold or the stretch is the word.
    """

    def __init__(self, path: str, pattern: str, room: int = 1_000_000, block: int = 64, most_rows: int = 1_000_000):
        import duckdb
        import numpy as np
        import regex

        ranks = read_ranks(path)
        self.find, self.room, self.block, self.most_rows = regex.compile(pattern).findall, room, block, most_rows
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        left, right, made = (pa.array(c, pa.int64()) for c in zip(*merges(ranks), strict=True))
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        for name, made_of in (("pairs", {"l": left, "r": right, "id": made}), ("tokens", {"id": pa.array(ranks.values(), pa.int32()), "piece": pa.array(ranks, pa.binary())})):
            self.con.register(name, pa.table(made_of))
        self.con.execute("CREATE TABLE merge AS SELECT l * 4294967296 + r AS pair, id::INT AS id FROM pairs")
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM tokens")
        self.con.unregister("pairs")
        self.con.unregister("tokens")
        #: by chunk of a text, and by match: its ids as little-endian u32
        self.ids: dict[str, bytes] = {}
        import re

        self.odd = re.compile("[\\s\x85᠎​﻿] ")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of any length, as little-endian u32."""
        import numpy as np

        whole = [i for i, w in enumerate(words) if len(w) <= self.block]
        out: list[bytes] = [b""] * len(words)
        for i, found in zip(whole, self._query([words[i] for i in whole], CONTRACT), strict=True):
            out[i] = found
        long = [i for i, w in enumerate(words) if len(w) > self.block]
        if not long:
            return out
        cut = [[words[i][at : at + self.block] for at in range(0, len(words[i]), self.block)] for i in long]
        found = iter(self._query([b for blocks in cut for b in blocks], CONTRACT))
        tokens, seams = [], []
        for blocks in cut:
            each = [np.frombuffer(next(found), "<u4") for _ in blocks]
            tokens.append(np.concatenate(each))
            seams.append(np.cumsum([len(e) for e in each])[:-1])
        wide = 4
        while True:
            wrong = self._crossed([words[i] for i in long], tokens, seams)
            if not any(map(len, wrong)):
                break
            spans = [_around(w, wide, len(t)) for w, t in zip(wrong, tokens, strict=True)]
            again: list[bytes] = []
            for i, t, of_word in zip(long, tokens, spans, strict=True):
                at = np.concatenate([[0], np.cumsum(self.sizes[t])])
                again += [words[i][at[a] : at[b]] for a, b in of_word]
            short = [n for n, w in enumerate(again) if len(w) <= self.block]
            done = dict(zip(short, self._query([again[n] for n in short], CONTRACT), strict=True))
            rest = [n for n in range(len(again)) if n not in done]
            done |= dict(zip(rest, self._query([again[n] for n in rest], CONTRACT_ALL), strict=True))
            number = 0
            for k, of_word in enumerate(spans):
                parts, edges, before, size = [], [], 0, 0
                for a, b in of_word:
                    new = np.frombuffer(done[number], "<u4")
                    number += 1
                    parts += [tokens[k][before:a], new]
                    size += a - before
                    edges += [size, size + len(new)]
                    before, size = b, size + len(new)
                parts.append(tokens[k][before:])
                tokens[k] = np.concatenate(parts)
                seams[k] = np.array([e for e in edges if 0 < e < len(tokens[k])], np.int64)
            wide *= 2
        for i, t in zip(long, tokens, strict=True):
            out[i] = t.astype("<u4").tobytes()
        return out

    def _crossed(self, words: list[bytes], tokens: list, seams: list) -> list:
        """Of each word's seams (places in its tokens), those whose two neighbours do not stay as they are."""
        import numpy as np

        pairs: dict[tuple[int, int], bytes] = {}
        each = []
        for word, t, s in zip(words, tokens, seams, strict=True):
            at = np.concatenate([[0], np.cumsum(self.sizes[t])])
            each.append([(int(t[x - 1]), int(t[x])) for x in s])
            pairs.update((pair, word[at[x - 1] : at[x + 1]]) for pair, x in zip(each[-1], s, strict=True))
        kept = {p for (p, _), ids in zip(pairs.items(), self._query(list(pairs.values()), CONTRACT), strict=True) if np.array(p, "<u4").tobytes() == ids}
        return [np.array([x for x, p in zip(s, of_word, strict=True) if p not in kept], np.int64) for s, of_word in zip(seams, each, strict=True)]

    def _query(self, words: list[bytes], query: str) -> list[bytes]:
        """Words by one of the recursive queries, in batches. All steps' rows of a word of n bytes are at most n(n + 1) / 2,
        and a batch's at most `most_rows`, so memory has a bound whatever the words."""
        import numpy as np

        out: list[bytes] = [b""] * len(words)
        order = sorted((i for i, w in enumerate(words) if w), key=lambda i: len(words[i]))
        batch: list[int] = []
        rows = 0

        def run() -> None:
            some = [words[i] for i in batch]
            sizes = np.array([len(w) for w in some])
            number = np.repeat(np.arange(len(some)), sizes)
            pos = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ids = self.single[np.frombuffer(b"".join(some), np.uint8)]
            self.con.register("bytes_of", pa.table({"word": pa.array(number, pa.int32()), "pos": pa.array(pos, pa.int32()), "id": pa.array(ids, pa.int32())}))
            found = self.con.sql(IDS.format(query)).to_arrow_table().combine_chunks()
            self.con.unregister("bytes_of")
            lists = found.column("ids").chunk(0)
            ends, packed = (lists.offsets.to_numpy() * 4).tolist(), lists.values.to_numpy().astype("<u4").tobytes()
            for i, a, b in zip(batch, ends, ends[1:], strict=False):
                out[i] = packed[a:b]

        for i in order:
            n = len(words[i])
            more = n * (n + 1) // 2 if query is CONTRACT else n
            if batch and rows + more > self.most_rows:
                run()
                batch, rows = [], 0
            batch.append(i)
            rows += more
        if batch:
            run()
        return out

    def decode(self, ids: list[bytes], most: int = 1_000_000) -> list[bytes]:
        """Bytes of documents, from their ids (little-endian u32), in batches of about `most` bytes of ids."""
        return [x for some in by_size(ids, most) for x in self._decode(some)]

    def _decode(self, ids: list[bytes]) -> list[bytes]:
        import numpy as np

        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        doc = np.repeat(np.arange(len(ids)), sizes)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.con.register("ids_of", pa.table({"doc": pa.array(doc, pa.int32()), "pos": pa.array(pos, pa.int32()), "id": pa.array(np.frombuffer(b"".join(ids), "<i4"))}))
        found = self.con.sql(DECODE).to_arrow_table()
        self.con.unregister("ids_of")
        out = [b""] * len(ids)
        for batch in found.to_batches():
            lists = batch.column(1)
            pieces = lists.flatten().cast(pa.binary())
            data = pieces.buffers()[2].to_pybytes()
            at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
            ends = at[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
            for d, a, b in zip(batch.column(0).to_pylist(), ends, ends[1:], strict=False):
                out[d] = data[a:b]
        return out

    def chunks(self, text: str) -> list[str]:
        """The text cut before single spaces, where the pattern ends a match in any case; a text with a space after
        white space is one chunk."""
        if self.odd.search(text):
            return [text]
        words = text.split(" ")
        words[1:] = [" " + w for w in words[1:]]
        return words

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Beyond `room` chunks in memory, only those that these texts hold stay there."""
        cut = [self.chunks(t) for t in texts]
        ids = self.ids
        used = set().union(*cut)
        if len(ids) > self.room:
            ids = self.ids = {c: ids[c] for c in used if c in ids}
        new = used.difference(ids)
        matches = {c: self.find(c) for c in new}
        words = list(set().union(*matches.values()).difference(ids))
        ids.update(zip(words, self.contract([w.encode() for w in words]), strict=True))
        for c, ws in matches.items():
            if len(ws) != 1:
                ids[c] = b"".join([ids[w] for w in ws])
        out = [b"".join(map(ids.__getitem__, chunks)) for chunks in cut]
        for c in {c for c in (*new, *words) if len(c) > 200}:
            del ids[c]
        return out


def _around(seams, wide: int, n: int) -> list[tuple[int, int]]:
    """Stretches of `wide` tokens to both sides of each seam, joined where they meet."""
    out: list[tuple[int, int]] = []
    for s in sorted(map(int, seams)):
        a, b = max(0, s - wide), min(n, s + wide)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def bpe(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, decoded binary (the bytes that a document's ids stand for) of every whole text.

    Null texts count as empty (no ids); texts and words of any length are coded whole; repeated rows are coded one by
    one; equal texts have equal ids; extra columns are left out; an empty table gives no rows. Nothing is exchanged,
    and a worker's memory of words is bounded.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = coder(ranks, pattern)
        for batch in batches:
            at = 0
            for run in by_size((t.as_py() for t in batch.column(1)), 4_000_000):
                found = own.encode(run)
                ends = np.cumsum([0, *(len(ids) // 4 for ids in found)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(run)), ids, pa.array(own.decode(found), pa.binary())], ["doc_id", "ids", "decoded"])
                at += len(run)

    merges(read_ranks(ranks))  # on the driver, once: the file's ranks follow its merges
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(code, f"doc_id {kind}, ids array<int>, decoded binary")


def bpe_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, taken from what bpe() returns."""
    return bpe(docs, ranks, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
