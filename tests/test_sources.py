import io
import struct
import zipfile

import pytest

from foliate.errors import FoliateError
from foliate.operators.sheets import read_rows
from foliate.sources import macro_files as V
from foliate.sources import office_files as O
from foliate.sources.compound import CompoundFile, write_compound


def container(*parts):
    """One compressed chunk of literal bytes and copies (back, n)."""
    items, done = [], 0
    for part in parts:
        if isinstance(part, bytes):
            items += [part[i : i + 1] for i in range(len(part))]
            done += len(part)
        else:
            items.append(struct.pack("<H", part[0] - 1 << V.length_bits(done) | part[1] - 3))
            done += part[1]
    body = b"".join(bytes([sum((len(x) == 2) << k for k, x in enumerate(items[at : at + 8]))]) + b"".join(items[at : at + 8]) for at in range(0, len(items), 8))
    return b"\x01" + struct.pack("<H", 0xB000 | len(body) - 1) + body


LONG = "".join(f"line {i} of the module\n" for i in range(900))


@pytest.mark.parametrize("data,text", [
    (container(b"End Sub"), "End Sub"), (container(b"tick tock ", (10, 9), b"!"), "tick tock tick tock!"), (container(b"-", (1, 40)), "-" * 41),
    (container(bytes(range(40, 90)), (50, 30), (3, 7)), "".join(map(chr, [*range(40, 90), *range(40, 70)])) + "CDECDEC"), (V.compress_literal(LONG.encode()), LONG), (b"\x01", ""),
])
def test_decompress(data, text):
    assert V.decompress(data) == text.encode()


@pytest.mark.parametrize("data", ["", "000000", "010800"])
def test_decompress_refuses(data):
    with pytest.raises(ValueError):
        V.decompress(bytes.fromhex(data))


def record(kind, body, size=None):
    return struct.pack("<HI", kind, len(body) if size is None else size) + body


def directory(*modules):
    out = record(0x09, b"\0" * 6, 4)
    for name, kind in modules:
        out += record(0x19, name.encode()) + record(0x47, name.encode("utf-16-le")) + record(0x1A, name.encode()) + record(0x31, struct.pack("<I", 3)) + record(kind, b"") + record(0x2B, b"")
    return out


def project(**code):
    kinds = {n: 0x21 if n.startswith("Mod") else 0x22 for n in code}
    streams = {"VBA/dir": V.compress_literal(directory(*kinds.items()))} | {f"VBA/{n}": b"xyz" + V.compress_literal(c.encode("cp1252")) for n, c in code.items()}
    return write_compound({**streams, "Form1/o": b"f"})


def test_compound_round_trip():
    streams = {"VBA/a": b"1" * 10, "VBA/b": b"2" * 9000, "top": b"", "VBA/c": bytes(range(256)) * 20}
    file = CompoundFile(write_compound(streams))
    assert {p: file.read(p) for p in streams} == streams and file.has("vba/A") and not file.has("x")


def workbook(**code):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{O.X[1:-1]}" xmlns:r="{O.R[1:-1]}"><workbookPr codeName="Book"/><sheets><sheet name="Data" sheetId="1" r:id="r1"/><sheet name="Hidden" state="hidden" sheetId="2" r:id="r2"/></sheets><definedNames><definedName name="Rate">0.21</definedName><definedName name="Own" localSheetId="0" hidden="1">Data!$A$1</definedName></definedNames></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{O.X[1:-1]}"><si><t>Name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{O.X[1:-1]}"><sheetPr codeName="Blad1"/><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>40</v></c><c r="AA3"><f>B1+2</f><v>42</v></c><c r="C1" t="b"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{O.X[1:-1]}"><sheetData/></worksheet>')
        if code:
            z.writestr("xl/vbaProject.bin", project(**code))
    return out.getvalue()


def test_workbook_modules(tmp_path, spark):
    data = workbook(Module1="Sub A()\nEnd Sub", Blad1="' caf\xe9", Form1="", Klass="x")
    assert V.workbook_modules(data) == [("Module1", "standardModule", "Sub A()\nEnd Sub"), ("Blad1", "documentModule", "' caf\xe9"), ("Form1", "userForm", ""), ("Klass", "classModule", "x")]
    assert V.workbook_modules(workbook()) == []
    (tmp_path / "a.xlsm").write_bytes(data)
    rows = V.macro_modules(spark, str(tmp_path)).orderBy("module_ord").collect()
    assert [(r.module, r.line_count) for r in rows] == [("Module1", 2), ("Blad1", 1), ("Form1", 0), ("Klass", 1)]
    assert O.read_book_cells(spark, str(tmp_path)).count() == 4
    with pytest.raises(FoliateError, match="vba_project_locked"):
        V.read_project(write_compound({"x": b"1"}))
    with pytest.raises(FoliateError, match="vba_parse_error"):
        V.read_project(b"junk")


def test_rows_hold_every_value(tmp_path, spark):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    found = {r.r: r["values"] for r in read_rows(O.read_book_cells(spark, str(tmp_path)).withColumnRenamed("path", "book")).collect()}
    assert sorted(found) == [0, 1, 2] and all(len(v) == 27 for v in found.values())
    assert found[0][:3] == [("text", None, "Name"), ("number", 40.0, None), ("boolean", 1.0, None)] and found[0][3:] == [None] * 24
    assert found[1] == [None] * 27 and found[2] == [None] * 26 + [("number", 42.0, None)]


def test_cells_and_names():
    cells = O.book_cells(workbook())
    assert [(r, c, k, n, t, f) for _, _, _, r, c, k, n, t, f in cells] == [(0, 0, "text", None, "Name", None), (0, 1, "number", 40.0, None, None), (2, 26, "number", 42.0, None, "=B1+2"), (0, 2, "boolean", 1.0, None, None)]
    assert O.book_names(workbook()) == [(None, "Rate", "=0.21", None, False), ("Data", "Own", "=Data!$A$1", None, True)]
    with pytest.raises(FoliateError, match="parse_error"):
        O.book_cells(b"nothing")


def test_word_files(tmp_path, spark):
    data = O.write_word([("Heading 1", "Title"), (None, "a < b")])
    assert O.word_paragraphs(data) == [(0, "Heading 1", "Title", False), (1, None, "a < b", False)]
    (tmp_path / "d.docx").write_bytes(data)
    assert O.read_word_paragraphs(spark, str(tmp_path)).count() == 2
    assert O.convert([("Heading 2", "T"), (None, "x")], "md").decode("utf-8-sig") == "## T\n\nx"
    with pytest.raises(FoliateError, match="unsupported_format"):
        O.convert([], "pdf")
