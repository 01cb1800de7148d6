"""What the training-data operators share: tables, the shared folder, numbering, word-wise encoding."""

from __future__ import annotations

import re
import tempfile
import uuid
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words: space, and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where the session names none (tests on one machine) a local folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliate-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/foliate/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: computed once, and no executor's loss can take it away."""
    path = path or new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables made by written() that no later result reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if "/foliate/" in folder.toString():
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def gapless(df: DataFrame, group: list[str], order: list[str], name: str, chunks: int | Column = 64) -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    Each group is dealt into `chunks` parts (a number, or a column that is one for each group) by a hash of the order
    columns, numbered part by part; a part's base is the count of the parts before it. The table of counts has a row
    a part, as many as `chunks` says and never a row of the input, so it is broadcast. The order inside a group is
    (part, order columns), the same on every run; rows that are equal in all order columns share a part.
    """
    chunks = F.lit(chunks) if isinstance(chunks, int) else chunks
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), chunks).cast("int"))
    counts = df.groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*group, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(*group, "_chunk").orderBy(*order))
    numbered = df.withColumn("_rank", rank.cast("long") - 1)
    return numbered.join(F.broadcast(bases), [*group, "_chunk"]).withColumn(name, F.col("_base") + F.col("_rank")).drop("_chunk", "_base", "_rank")


def hot_keys(df: DataFrame, key: str, most: int = 100) -> list:
    """The keys that hold over 1 / `most` of df's rows: fewer than `most`, whatever the rows."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    return [r[0] for r in counts.filter(F.col("_n") > total // most + 1000).select(key).collect()]


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None, size: str | None = None) -> DataFrame:
    """left joined to right, whose keys are unique, where one key may hold a third of left's rows.

    Rows of hot keys (at most 100) stay where they are and meet right's rows of those keys by broadcast: at most 100
    rows. `size` names a binary column of right whose length counts: keys of over 256 KB there go with the others.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if hot and size is not None:
        hot = [r[0] for r in right.filter(F.col(key).isin(hot) & (F.octet_length(size) <= 1 << 18)).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    near = left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how)
    return near.unionByName(left.filter(~is_hot).join(right.filter(~is_hot), key, how))


def share_of_hash(column: str, wanted: int, there: int) -> Column:
    """Whether a row is in a share, by its hash, that holds `wanted` of `there` rows with much to spare.

    A sample by the order of a hash takes its candidates through this first: else every partition would send as many
    rows as the whole sample has."""
    share = min(1.0, (2 * wanted + 100) / max(1, there))
    return F.shiftrightunsigned(F.xxhash64(column), 11) < F.lit(int(share * 2**53))


def by_size(texts: Iterable[str], limit: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of texts of about `limit` characters, so that what is built for a run stays small."""
    run: list[str] = []
    size = 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


#: Characters whose classes, case and normal form are the same in every Unicode version and library; a text with any
#: other goes to the tokenizers library whole.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f\u2010-\u2027\u20ac]")

#: Encoders of this Python worker, by their parameters; tasks that follow find the words already encoded.
_ENCODERS: dict[tuple, Encoder] = {}


#: What operators keep with this Python worker, if they have run there.
_KEPT: list[dict] = []


def sole(own: dict) -> dict:
    """own, what an operator keeps with this worker, while all that others kept here is let go: workers outlive stages,
    and a stage's words are no use to the next."""
    if not any(k is own for k in _KEPT):
        _KEPT.append(own)
    others = [k for k in _KEPT if k and k is not own]
    for other in others:
        other.clear()
    if others:
        import ctypes
        import gc

        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    return own


def encoder(path: str, width: int = 4) -> Encoder:
    sole(_ENCODERS)
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(path, width)
    return _ENCODERS[path, width]


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for
    themselves, the other bytes in order from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


#: Stands for a word's end in rank tables. UTF-8 has no such byte.
WORD_END = b"\xff"


class Vocabulary:
    """A BPE file of the tokenizers library as ranks of byte strings."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, alphabet = content["model"], byte_alphabet()
        self.special = [a["content"] for a in content["added_tokens"]]
        self.suffix = model.get("end_of_word_suffix") or ""

        def raw(token: str) -> bytes:
            if self.suffix and token.endswith(self.suffix):
                return bytes(alphabet[c] for c in token[: -len(self.suffix)]) + WORD_END
            return bytes(alphabet[c] for c in token)

        self.ranks = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = [(raw(a), raw(b)) for a, b in pairs]

    def by_ranks(self) -> bool:
        """Whether merging by the rank of the joined bytes gives the ids that the file's merge list gives.

        It does for every text if ids rise along the list and, for each merge, its token's bytes alone, merged by
        lower ranks only, end as that merge's two parts: where two tokens meet in a text, the bytes below them
        have merged as they would alone.
        """
        made = [self.ranks.get(a + b, -1) for a, b in self.merges]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            return False
        for (a, b), limit in zip(self.merges, made, strict=True):
            token = a + b
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 1:
                rank, i = min((self.ranks.get(x + y, limit), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank >= limit:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if parts != [a, b]:
                return False
        return True


class Encoder:
    """Token ids of whole texts by a BPE file of the tokenizers library, as little-endian integers of `width` bytes.

    Files with word ends: a usual text is cut at white space, and the library encodes each distinct piece (a match of
    its pre-token pattern, in lower case) once while it is kept. Beyond `room` kept words only those of the texts at
    hand stay; words of over 100 characters are not kept.

    Byte-level files: the library spends most of its time on what is not needed here. Where merging by ranks provably
    gives the same ids (see Vocabulary.by_ranks(); the driver looks once, with sure_ranks()), usual texts are merged
    by ranks.

    A text with an unusual character or a special string goes to the library whole.
    """

    def __init__(self, path: str, width: int = 4, room: int = 1_200_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        own = Vocabulary(path)
        self.code, self.room, self.words = {2: "H", 4: "I"}[width], room, {"": b""}
        self.special = re.compile("|".join(map(re.escape, own.special))) if own.special else None
        self.spaced = not own.suffix
        self.ranks = tiktoken.Encoding("own", pat_str=SPACED_PATTERN, mergeable_ranks=own.ranks, special_tokens={}) if self.spaced else None
        self.find = usual_words().findall
        if own.suffix:
            import numpy as np
            from tokenizers import normalizers, pre_tokenizers

            # for pieces alone: they are cut and in lower case, so neither is looked for again
            self.plain = Tokenizer.from_file(path)
            self.plain.no_truncation()
            self.plain.no_padding()
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(own.suffix)]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        usual = [not UNUSUAL.search(t) and not (self.special and self.special.search(t)) for t in texts]
        rest = iter(self._library([t for t, u in zip(texts, usual, strict=True) if not u]))
        own = iter((self._by_ranks if self.spaced else self._by_words)([t for t, u in zip(texts, usual, strict=True) if u]))
        return [next(own if u else rest) for u in usual]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _by_ranks(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, self.ranks.encode_ordinary(t)).tobytes() for t in texts]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        cut, known = [t.replace("\n", " ").split(" ") for t in texts], self.words
        used = set().union(*cut)
        if len(known) > self.room:
            known = self.words = {"": b""} | {w: known[w] for w in used if w in known}
        missing = used.difference(known)
        plain = {w: w.lower() for w in missing if w.isascii() and w.isalpha()}
        many = {w: self.find(w.lower()) for w in missing.difference(plain)}
        new = list(set(plain.values()).union(*many.values()).difference(known))
        known.update(zip(new, self._pieces(new), strict=True))
        known.update(zip(plain, map(known.__getitem__, plain.values()), strict=True))
        known.update([(w, b"".join([known[p] for p in its])) for w, its in many.items()])
        # a table of these texts' words alone: lookups in all that are kept would each miss the processor's cache
        own = dict(zip(used, map(known.__getitem__, used), strict=True))
        out = [b"".join(map(own.__getitem__, words)) for words in cut]
        for word in [w for w in missing if len(w) > 100]:
            for w in (word, plain.get(word), *many.get(word, ())):
                known.pop(w, None)
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. The library takes them as one text with spaces between; a piece's ids end at a token that
        ends a word. Should these not tell the pieces apart, each is a text of its own."""
        import numpy as np

        if not pieces:
            return []
        ids = np.array(self.plain.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces) or ends[-1] != len(ids):
            return self._library(pieces)
        packed, size = ids.astype(f"<u{array(self.code).itemsize}").tobytes(), array(self.code).itemsize
        at = [0, *(ends * size).tolist()]
        return [packed[a:b] for a, b in zip(at, at[1:], strict=False)]


#: Pre-token patterns of the two kinds of files (fixed values).
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def usual_words() -> re.Pattern:
    """WORD_PATTERN for texts without unusual characters, in lower case: their letters and numbers named one by one,
    the kinds in another order, as no two but the contractions and the signs begin alike."""
    import unicodedata

    usual = {x for c in map(chr, range(0x20AD)) if not UNUSUAL.match(c) for x in (c, c.lower())}
    of_kind = lambda kind: "".join(sorted(c for c in usual if unicodedata.category(c[0])[0] == kind))
    letters, numbers = of_kind("L"), of_kind("N")
    return re.compile(rf"[{letters}]+|[{numbers}]|'(?:[stmd]|re|ve|ll)|[^\s{letters}{numbers}]+")


_SURE: set[str] = set()


def sure_ranks(path: str) -> None:
    """On the driver, once for each byte-level file: that Encoder's way holds for it."""
    if path not in _SURE:
        own = Vocabulary(path)
        if not own.suffix and not own.by_ranks():
            raise ValueError(f"the merges of {path} do not follow its ranks")
        _SURE.add(path)
