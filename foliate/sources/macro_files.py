"""Macro projects in workbook files: decompression, the project's directory, modules and their kinds."""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import FoliateError
from .compound import CompoundFile


def length_bits(done: int) -> int:
    """How many bits of a copy token hold its length, after so many bytes of the chunk."""
    return 16 - min(12, max(4, (max(done, 1) - 1).bit_length()))


def decompress(data: bytes) -> bytes:
    """The content of a compressed container: chunks of literals and copies, or of raw bytes."""
    if not data or data[0] != 1:
        raise ValueError("no container signature")
    out, at = bytearray(), 1
    while at + 2 <= len(data):
        (head,) = struct.unpack_from("<H", data, at)
        if head >> 12 & 7 != 3:
            raise ValueError("no chunk signature")
        end = min(len(data), at + (head & 0xFFF) + 3)
        at += 2
        if not head >> 15:
            out += data[at:end]
            at = end
            continue
        begin = len(out)
        while at < end:
            flags = data[at]
            at += 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                if at + 2 > end:
                    raise ValueError("a cut token")
                (token,) = struct.unpack_from("<H", data, at)
                at += 2
                bits = length_bits(len(out) - begin)
                back, n = (token >> bits) + 1, (token & (1 << bits) - 1) + 3
                if back > len(out) - begin:
                    raise ValueError("a copy from before its chunk")
                for _ in range(n):
                    out.append(out[-back])
    return bytes(out)


def compress_literal(data: bytes) -> bytes:
    """A container of literals only, for fixtures."""
    out = bytearray(b"\x01")
    for at in range(0, len(data), 3600):
        part = data[at : at + 3600]
        body = b"".join(b"\0" + part[i : i + 8] for i in range(0, len(part), 8))
        out += struct.pack("<H", 0xB000 | len(body) + 2 - 3) + body
    return bytes(out)


def text_of_bytes(data: bytes) -> str:
    """Windows-1252, where the five bytes without a character stand for the controls of their number."""
    return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in data) if any(b in data for b in b"\x81\x8d\x8f\x90\x9d") else data.decode("cp1252")


# fixed values: ids of records in the project's directory
_NAME, _NAME_UNICODE, _STREAM, _STREAM_UNICODE, _OFFSET, _PROCEDURAL, _CLASS, _END, _VERSION = 0x19, 0x47, 0x1A, 0x32, 0x31, 0x21, 0x22, 0x2B, 0x09


def directory(data: bytes) -> list[tuple[str, str, int, int]]:
    """(name, stream, offset, type) of each module of a decompressed directory; a cut end is passed over."""
    out: list[tuple[str, str, int, int]] = []
    now: dict[str, str | int] = {}
    at = 0
    while at + 6 <= len(data):
        kind, size = struct.unpack_from("<HI", data, at)
        at += 6
        size = 6 if kind == _VERSION else size
        if at + size > len(data):
            break
        body = data[at : at + size]
        at += size
        if kind == _NAME:
            now.setdefault("name", text_of_bytes(body))
        elif kind == _NAME_UNICODE:
            now["name"] = body.decode("utf-16-le", "replace")
        elif kind == _STREAM:
            now.setdefault("stream", text_of_bytes(body))
        elif kind == _STREAM_UNICODE:
            now["stream"] = body.decode("utf-16-le", "replace")
        elif kind == _OFFSET and size >= 4:
            now["offset"] = struct.unpack_from("<I", body)[0]
        elif kind in (_PROCEDURAL, _CLASS):
            now["type"] = kind
        elif kind == _END:
            if "name" in now:
                out.append((str(now["name"]), str(now.get("stream", now["name"])), int(now.get("offset", 0)), int(now.get("type", _CLASS))))
            now = {}
    return out


def document_codenames(book: zipfile.ZipFile) -> set[str]:
    """Code names, in lower case, of the workbook and its sheets; unreadable parts are passed over."""
    out = {"thisworkbook"}
    for name in book.namelist():
        low = name.lower()
        wanted = "workbookPr" if low == "xl/workbook.xml" else "sheetPr" if low.endswith(".xml") and low.startswith(("xl/worksheets/", "xl/chartsheets/", "xl/dialogsheets/")) else None
        if wanted:
            try:
                found = next((e for e in ET.fromstring(book.read(name)).iter() if e.tag.rpartition("}")[2] == wanted), None)
            except ET.ParseError:
                continue
            if found is not None and found.get("codeName"):
                out.add(found.get("codeName").lower())
    return out


def kind_of(name: str, type_: int, forms: set[str], codenames: set[str] | None) -> str:
    if type_ == _PROCEDURAL:
        return "standardModule"
    if name.lower() in forms:
        return "userForm"
    document = name.lower() in codenames if codenames is not None else name == "ThisWorkbook" or name.startswith("Sheet")
    return "documentModule" if document else "classModule"


def read_project(data: bytes, codenames: set[str] | None = None) -> list[tuple[str, str, str]]:
    """(name, kind, code) of each module of a project file. One unreadable module refuses the whole project."""
    try:
        file = CompoundFile(data)
        if not file.has("VBA") or not file.has("VBA/dir"):
            raise FoliateError("vba_project_locked", "the project has no readable directory")
        modules = directory(decompress(file.read("VBA/dir")))
        if not modules:
            raise FoliateError("vba_project_locked", "the project's directory names no module")
        forms = {s.lower() for s in file.storages() if s.lower() != "vba" and "/" not in s}
        out = []
        for name, stream, offset, type_ in modules:
            raw = file.read(f"VBA/{stream}")
            if offset > len(raw):
                raise ValueError(f"{name}: offset {offset} of {len(raw)}")
            out.append((name, kind_of(name, type_, forms, codenames), text_of_bytes(decompress(raw[offset:]))))
        return out
    except FoliateError:
        raise
    except (ValueError, KeyError, IndexError, struct.error) as e:
        raise FoliateError("vba_parse_error", str(e)) from e


def workbook_modules(data: bytes) -> list[tuple[str, str, str]]:
    """Modules of a workbook file; none if it holds no project."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise FoliateError("parse_error", str(e)) from e
    project = next((n for n in book.namelist() if n.lower() == "xl/vbaproject.bin"), None)
    return read_project(book.read(project), document_codenames(book)) if project else []


def macro_modules(spark: SparkSession, path: str) -> DataFrame:
    """book, module_ord, module, kind, line_count, code of all workbooks at path: a file a row, decoded by executors."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(book, i, n, k, 0 if c == "" else 1 + c.count("\n"), c) for i, (n, k, c) in enumerate(workbook_modules(content.as_py()))]
                if rows:
                    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["book", "module_ord", "module", "kind", "line_count", "code"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "book string, module_ord int, module string, kind string, line_count int, code string")
