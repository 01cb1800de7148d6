"""Interleaved document sequences and content-addressed media columns."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, text_of, written

WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"


def write_image(payload: bytes) -> bytes:
    """The bytes as 8-bit grey samples of a PNG that is WIDTH samples wide; their number is a multiple of WIDTH."""
    if len(payload) % WIDTH or not payload:
        raise ValueError("a positive multiple of the width is asked for")

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + payload[i : i + WIDTH] for i in range(0, len(payload), WIDTH))
    head = struct.pack(">IIBBBBB", WIDTH, len(payload) // WIDTH, 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def read_image(media: bytes) -> bytes:
    """The samples of a PNG made by write_image(); a damaged one is an error."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, size = 8, [], (0, 0)
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's check sum differs")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = zlib.decompress(b"".join(data))
    step = size[0] + 1
    if len(rows) != step * size[1] or any(rows[::step]):
        raise ValueError("the samples do not fit the header")
    return b"".join(rows[i + 1 : i + step] for i in range(0, len(rows), step))


#: Elements that begin or end a block of text.
BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 br section article figure figcaption table ul ol blockquote header footer body".split())


class Interleaver(HTMLParser):
    """Ordered items of a page: (kind, text, reference, caption). Scripts and styles are no text.

    A figure's caption, before or after them, belongs to all media of the figure; media without one have their alt
    text. A caption without an end tag ends with its figure, or where a block begins after it has text; one of a
    figure without media is text. A player is one medium: its own source or the first one inside it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list[str | None]] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] | None = None
        self.captions: list[str] = []
        self.player: int | None = None  # the medium of the open player, -1 while it has none
        self.silent = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.items.append(["text", text, None, None])
        self.text = []

    def _end_caption(self) -> None:
        if self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            self.caption = None
            if self.figure is None:
                self.text.append(caption)
                self._flush()
            elif caption:
                self.captions.append(caption)

    def _end_figure(self) -> None:
        self._end_caption()
        caption = " ".join(self.captions)
        if self.figure:
            for i in self.figure if caption else ():
                self.items[i][3] = caption
        elif caption:
            self.text.append(caption)
        self._flush()
        self.figure, self.captions = None, []

    def _medium(self, reference: str, alt: str | None) -> int:
        # text of an open caption stays in the caption; other text comes before the medium
        self._flush()
        self.items.append(["media", None, reference, alt])
        if self.figure is not None:
            self.figure.append(len(self.items) - 1)
        return len(self.items) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "img" and a.get("src"):
            self._medium(a["src"], a.get("alt"))
        elif tag in ("audio", "video"):
            self.player = self._medium(a["src"], a.get("alt")) if a.get("src") else -1
        elif tag == "source" and a.get("src") and self.player in (None, -1):
            found = self._medium(a["src"], a.get("alt"))
            self.player = found if self.player == -1 else None
        elif tag == "figure":
            self._end_figure()
            self.figure = []
        elif tag == "figcaption":
            self._end_caption()
            self._flush()
            self.caption = []
        elif tag in BLOCKS:
            if self.caption is not None and "".join(self.caption).strip():
                self._end_caption()
            self._flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag in ("audio", "video"):
            self.player = None
        elif tag == "figcaption":
            self._end_caption()
        elif tag == "figure":
            self._end_figure()
        elif tag in ("section", "article", "body"):
            self._end_figure()
        elif tag in BLOCKS:
            self._flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)

    @classmethod
    def of(cls, html: str) -> list[list[str | None]]:
        own = cls()
        own.feed(html)
        own.close()
        own._end_figure()
        return own.items


ITEMS = "items array<struct<position int, kind string, text string, reference string, caption string>>"


def sequences(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and items: the ordered text and media-reference structs of each page (none for null or empty html)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("reference", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                found = [[{"position": i, "kind": k, "text": t, "reference": r, "caption": c} for i, (k, t, r, c) in enumerate(Interleaver.of(h.as_py() or ""))] for h in rows.column(1)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, kind)], [key, "items"])

    return pages.select(key, html).mapInArrow(parse, f"{key} {pages.schema[key].dataType.simpleString()}, {ITEMS}")


def store(payloads: DataFrame, path: str | None = None) -> DataFrame:
    """Write (digest, payload) as (digest, media), read back. A task writes each digest once; copies in other tasks
    may be stored again, which join() allows for, and no payload is exchanged to prevent it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                digests, media = [], []
                rows = batch.slice(at, 256)
                for digest, payload in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                    if digest not in seen:
                        seen.add(digest)
                        digests.append(digest)
                        media.append(write_image(payload.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    return written(payloads.select("digest", "payload").mapInArrow(encode, "digest string, media binary"), "media", path)


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes say: digests and sizes of media and samples, the check sum of the last WIDTH samples, and
    a feature: mean (in thousandths), largest, number of different values, and an 8-bin histogram of the samples."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        import numpy as np

        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            rows = []
            for digest, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                media = stored.as_py()
                payload = read_image(media)
                counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                mean = int(counts @ np.arange(256)) * 1000 // len(payload)
                feature = f"mean={mean};max={int(np.flatnonzero(counts).max())};values={int((counts > 0).sum())};histogram={','.join(map(str, counts.reshape(8, 32).sum(1)))}"
                rows.append((digest, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), sha256(media).hexdigest(), feature))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in FEATURES.split(", ")])

    return media.select("digest", "media").mapInArrow(compute, FEATURES)


def resolve(items: DataFrame, key: str, resolved: DataFrame, hot: list | None = None) -> DataFrame:
    """key, position, kind, text, caption, digest and the columns of `resolved` (one row a digest is used) of every
    item, by a left join on the digest that the reference `sha256:...` names; others stay unresolved. Digests that
    very many items name (`hot`; found here if not given) are joined by broadcast of their rows, fewer than 100."""
    rows = items.select(key, F.explode("items").alias("i")).select(key, "i.position", "i.kind", "i.text", "i.caption", F.when(F.col("i.reference").startswith("sha256:"), F.substring("i.reference", 8, 64)).alias("digest"))
    return join_hot(rows, resolved.dropDuplicates(["digest"]), "digest", "left", hot)


def payloads(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest, payload: each text's UTF-8 with bytes 0 up to a positive multiple of WIDTH."""
    octets = text_of().cast("binary")
    rows = docs.select("doc_id", octets.alias("octets"), F.octet_length(octets).cast("long").alias("n_bytes"))
    pad = F.when(F.col("n_bytes") == 0, WIDTH).otherwise(F.pmod(-F.col("n_bytes"), F.lit(WIDTH))).cast("int")
    rows = rows.select("doc_id", "n_bytes", F.concat("octets", F.substring(F.lit(bytearray(WIDTH)), F.lit(1), pad)).alias("payload"))
    return rows.select("doc_id", "n_bytes", F.sha2("payload", 256).alias("digest"), "payload")


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored medium's columns, with position and caption, for every document.

    Each text is a medium of its own page: the page's figure refers to it by digest. The pages are parsed into
    sequences, media are stored and read back, and a join on the digest brings both together. Payloads themselves are
    never exchanged, as the features are taken from each stored part before the join. Null texts count as empty (64
    bytes 0); a text of any length is one medium; equal texts have equal values; repeated rows keep a row each; extra
    columns are left out; an empty table gives no rows.
    """
    rows = payloads(docs)
    hot = hot_keys(rows.select("digest"), "digest")
    read = features(store(rows))
    read = written(read.dropDuplicates(["digest"]), "features") if hot else read
    page = F.concat(F.lit("<html><body><p>Document</p><figure><img src=\"sha256:"), F.col("digest"), F.lit("\"><figcaption>Text of "), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure></body></html>"))
    keyed = rows.select(F.struct("doc_id", "n_bytes").alias("document"), page.alias("html"))
    found = resolve(sequences(keyed, "document", "html"), "document", read, hot).filter("kind = 'media'")
    return found.select("document.doc_id", "document.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
