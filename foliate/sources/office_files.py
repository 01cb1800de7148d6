"""Word and workbook files: paragraphs, runs, tables, comments, revisions and properties; sheets and cells."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import FoliateError

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _zip(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise FoliateError("parse_error", str(e)) from e


def _xml(file: zipfile.ZipFile, name: str) -> ET.Element | None:
    try:
        return ET.fromstring(file.read(name))
    except KeyError:
        return None
    except ET.ParseError as e:
        raise FoliateError("parse_error", f"{name}: {e}") from e


def _text(e: ET.Element) -> str:
    return "".join(x.text or "" if x.tag in (W + "t", W + "delText") else "\t" if x.tag == W + "tab" else "\n" if x.tag in (W + "br", W + "cr") else "" for x in e.iter())


def word_paragraphs(data: bytes) -> list[tuple[int, str | None, str, bool]]:
    """(pos, style name, text, whether in a table) in document order."""
    file = _zip(data)
    styles = {s.get(W + "styleId"): (s.find(W + "name").get(W + "val") if s.find(W + "name") is not None else s.get(W + "styleId")) for s in (_xml(file, "word/styles.xml") if "word/styles.xml" in file.namelist() else ET.Element("none")).iter(W + "style")}
    body = _xml(file, "word/document.xml")
    if body is None:
        raise FoliateError("parse_error", "no document part")
    inside = {id(p) for t in body.iter(W + "tbl") for p in t.iter(W + "p")}
    out = []
    for i, p in enumerate(body.iter(W + "p")):
        style = p.find(f"{W}pPr/{W}pStyle")
        name = style.get(W + "val") if style is not None else None
        name = styles.get(name, name)
        if name and (m := re.fullmatch(r"(?i)heading\s*(\d+)", name)):
            name = f"Heading {m[1]}"
        out.append((i, name, _text(p), id(p) in inside))
    return out


def word_runs(data: bytes) -> list[tuple[int, int, str, bool, bool]]:
    """(pos, run_no, text, bold, italic); neighbours of equal marks are joined."""
    on = lambda p, tag: p is not None and (e := p.find(W + tag)) is not None and e.get(W + "val", "1") not in ("0", "false", "off")
    out: list[tuple[int, int, str, bool, bool]] = []
    for i, p in enumerate(_xml(_zip(data), "word/document.xml").iter(W + "p")):
        own: list[list] = []
        for r in p.iter(W + "r"):
            marks, text = r.find(W + "rPr"), _text(r)
            key = [on(marks, "b"), on(marks, "i")]
            if not text:
                continue
            if own and own[-1][1:] == key:
                own[-1][0] += text
            else:
                own.append([text, *key])
        out += [(i, n, t, b, it) for n, (t, b, it) in enumerate(own)]
    return out


def word_tables(data: bytes) -> list[tuple[int, int, int, str]]:
    """(table_no, r, c, text)."""
    return [(n, r, c, "\n".join(_text(p) for p in cell.iter(W + "p"))) for n, t in enumerate(_xml(_zip(data), "word/document.xml").iter(W + "tbl")) for r, row in enumerate(t.findall(W + "tr")) for c, cell in enumerate(row.findall(W + "tc"))]


def word_comments(data: bytes) -> list[tuple[int, str, str | None, str, str]]:
    """(id, author, date, text, anchor text)."""
    file = _zip(data)
    notes, body = _xml(file, "word/comments.xml"), _xml(file, "word/document.xml")
    anchors: dict[str, str] = {}
    live: set[str] = set()
    for e in body.iter():
        if e.tag == W + "commentRangeStart":
            live.add(e.get(W + "id"))
            anchors[e.get(W + "id")] = ""
        elif e.tag == W + "commentRangeEnd":
            live.discard(e.get(W + "id"))
        elif e.tag == W + "t":
            for k in live:
                anchors[k] += e.text or ""
    return [] if notes is None else [(i, c.get(W + "author") or "", c.get(W + "date"), "\n".join(_text(p) for p in c.iter(W + "p")), anchors.get(c.get(W + "id"), "")) for i, c in enumerate(notes.iter(W + "comment"))]


def word_revisions(data: bytes) -> list[tuple[int, str, str, str | None, str]]:
    """(pos, kind, author, date, text)."""
    kinds = {W + "ins": "insert", W + "del": "delete", W + "rPrChange": "format", W + "pPrChange": "format", W + "sectPrChange": "format", W + "tblPrChange": "format"}
    found = (e for e in _xml(_zip(data), "word/document.xml").iter() if e.tag in kinds)
    return [(i, kinds[e.tag], e.get(W + "author") or "", e.get(W + "date"), _text(e)) for i, e in enumerate(found)]


def properties(data: bytes) -> list[tuple[str, str]]:
    """(name, value) of the core and application properties that hold text."""
    file = _zip(data)
    return [(e.tag.rpartition("}")[2], e.text) for part in ("docProps/core.xml", "docProps/app.xml") if (root := _xml(file, part)) is not None for e in root if e.text and e.text.strip()]


def _column(letters: str) -> int:
    out = 0
    for c in letters:
        out = out * 26 + ord(c) - 64
    return out - 1


DATES = re.compile(r"(?i)(?:^|[^\\])[ymdhs]")


def book_cells(data: bytes) -> list[tuple[int, str, bool, int, int, str, float | None, str | None, str | None]]:
    """(sheet_idx, sheet, visible, r, c, value_type, v_num, v_text, formula): values as the file holds them."""
    file = _zip(data)
    book = _xml(file, "xl/workbook.xml")
    if book is None:
        raise FoliateError("parse_error", "no workbook part")
    shared_part, style_part, links = _xml(file, "xl/sharedStrings.xml"), _xml(file, "xl/styles.xml"), _xml(file, "xl/_rels/workbook.xml.rels")
    shared = ["".join(t.text or "" for t in s.iter(X + "t")) for s in shared_part.iter(X + "si")] if shared_part is not None else []
    codes = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in style_part.iter(X + "numFmt")} if style_part is not None else {}
    formats = [int(x.get("numFmtId") or 0) for xs in (style_part.iter(X + "cellXfs") if style_part is not None else ()) for x in xs]
    target = {e.get("Id"): e.get("Target") for e in links} if links is not None else {}
    out = []
    for i, sheet in enumerate(book.iter(X + "sheet")):
        path = target.get(sheet.get(R + "id"), f"worksheets/sheet{i + 1}.xml").lstrip("/")
        root = _xml(file, path if path.startswith("xl/") else f"xl/{path}")
        for c in root.iter(X + "c") if root is not None else ():
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
            v, f, t = c.findtext(X + "v"), c.findtext(X + "f"), c.get("t", "n")
            number, text, kind = None, None, "empty"
            if t == "s" and v is not None:
                kind, text = "text", shared[int(v)]
            elif t == "inlineStr":
                kind, text = "text", "".join(x.text or "" for x in c.iter(X + "t"))
            elif t in ("str", "e") and v is not None:
                kind, text = "text", v
            elif t == "b" and v is not None:
                kind, number = "boolean", float(v)
            elif v is not None:
                style = formats[int(c.get("s") or 0)] if formats else 0
                kind, number = ("datetime" if 14 <= style <= 22 or 45 <= style <= 47 or DATES.search(codes.get(style, "")) else "number"), float(v)
            out.append((i, sheet.get("name"), sheet.get("state", "visible") == "visible", int(row) - 1, _column(letters), kind, number, text, None if f is None else f"={f}"))
    return out


def book_names(data: bytes) -> list[tuple[str | None, str, str, str | None, bool]]:
    """(scope, name, refers_to, comment, is_hidden)."""
    book = _xml(_zip(data), "xl/workbook.xml")
    sheets = [s.get("name") for s in book.iter(X + "sheet")]
    rows = [(sheets[int(n.get("localSheetId"))] if n.get("localSheetId") else None, n.get("name"), f"={n.text}", n.get("comment"), n.get("hidden") == "1") for n in book.iter(X + "definedName")]
    return sorted(rows, key=lambda r: r[0] is not None)


def reader(parse: Callable[[bytes], list[tuple]], schema: str) -> Callable[[SparkSession, str], DataFrame]:
    """A DataFrame reader: each file at the path is parsed by an executor; its rows come after the file's `path`."""
    names = [c.split()[0] for c in schema.split(", ")]
    arrow = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    kinds = [arrow[c.split()[1]] for c in schema.split(", ")]

    def load(spark: SparkSession, path: str) -> DataFrame:
        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    rows = parse(content.as_py())
                    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], ["path", *names])

        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, f"path string, {schema}")

    return load


read_word_paragraphs = reader(word_paragraphs, "pos int, style string, text string, in_table boolean")
read_word_runs = reader(word_runs, "pos int, run_no int, text string, bold boolean, italic boolean")
read_word_tables = reader(word_tables, "table_no int, r int, c int, text string")
read_word_comments = reader(word_comments, "id int, author string, date string, text string, anchor string")
read_word_revisions = reader(word_revisions, "pos int, kind string, author string, date string, text string")
read_properties = reader(properties, "name string, value string")
read_book_cells = reader(book_cells, "sheet_idx int, sheet string, visible boolean, r int, c int, value_type string, v_num double, v_text string, formula string")
read_book_names = reader(book_names, "scope string, name string, refers_to string, comment string, is_hidden boolean")


def write_word(paragraphs: list[tuple[str | None, str]]) -> bytes:
    """A document file of (style, text) paragraphs; none gives a blank document."""
    styles = sorted({s for s, _ in paragraphs if s})
    ids = {s: re.sub(r"\W", "", s) for s in styles}
    part = lambda s, t: f"<w:p>{f'<w:pPr><w:pStyle w:val="{ids[s]}"/></w:pPr>' if s else ''}<w:r><w:t xml:space=\"preserve\">{escape(t)}</w:t></w:r></w:p>"
    ns = f'xmlns:w="{W[1:-1]}"'
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f"<w:document {ns}><w:body>{''.join(part(s, t) for s, t in paragraphs)}</w:body></w:document>",
        "word/styles.xml": f"<w:styles {ns}>{''.join(f'<w:style w:type="paragraph" w:styleId="{ids[s]}"><w:name w:val="{escape(s)}"/></w:style>' for s in styles)}</w:styles>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        for name, text in files.items():
            file.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def convert(paragraphs: list[tuple[str | None, str]], format: str) -> bytes:
    """Paragraphs as txt, md, html or docx. Layout formats (pdf, rtf) are not written."""
    level = lambda s: int(s[8:]) if s and re.fullmatch(r"Heading \d+", s) else 0
    if format == "docx":
        return write_word(paragraphs)
    if format == "txt":
        return "\n".join(t for _, t in paragraphs).encode()
    if format == "md":
        return b"\xef\xbb\xbf" + "\n\n".join(("#" * n + " " if (n := level(s)) else "") + t.strip() for s, t in paragraphs if t.strip()).encode()
    if format == "html":
        tag = lambda s: f"h{min(6, level(s))}" if level(s) else "p"
        return ("<!DOCTYPE html><html><body>" + "".join(f"<{tag(s)}>{escape(t)}</{tag(s)}>" for s, t in paragraphs) + "</body></html>").encode()
    raise FoliateError("unsupported_format", f"no writer for {format}")
