"""Limits for each book, options of views, typed metadata, paths and save modes."""

import json
import zipfile

import pytest

from foliate.errors import FoliateError
from foliate.functions import strings as S
from foliate.operators import callgraph, documents, edits, macros, render, sheets
from foliate.sources import office_files as O
from foliate.sources import sinks

CELLS = "book string, sheet_idx int, sheet string, visible boolean, r int, c int, value_type string, v_num double, v_text string, formula string"


def code_of(error):
    return error.value.code


@pytest.fixture(scope="module")
def books(spark):
    """Two books of two sheets, four formulas each; the second sheet of book b is large."""
    rows = [(b, i, f"Sheet {i}", True, r, 0, "number", float(r), None, "=1") for b in "ab" for i in range(2) for r in range(2)]
    return spark.createDataFrame([*rows, ("b", 1, "Sheet 1", True, 99, 9, "text", None, "far", None)], CELLS)


def test_limits_are_of_one_book(books):
    assert sheets.list_formulas(books, most=4).count() == 8 and sheets.read_cells(books, most=1000).count() == 9
    for call, word in ((lambda: sheets.list_formulas(books, most=3), "a has 4"), (lambda: sheets.read_cells(books, most=999), "1000 cells"), (lambda: sheets.read_cells(books, "A1:Z99", most=9), "2574")):
        with pytest.raises(FoliateError, match=word) as e:
            call()
        assert code_of(e) == "range_too_large"
    only_a = books.filter("book = 'a' OR sheet_idx = 1")
    assert sheets.require_sheet(books, "sheet 0").count() == 4
    for name, code in (("sheet 0", "sheet_not_found"), (None, "index_out_of_range")):
        with pytest.raises(FoliateError, match="in b") as e:
            sheets.require_sheet(only_a, name)
        assert code_of(e) == code


@pytest.fixture(scope="module")
def analysis(spark):
    code = "Sub Main()\nHelp\nmain2\nEnd Sub\nSub Help()\nEnd Sub\nSub main2()\nElsewhere\nEnd Sub"
    rows = [(b, i, m, "standardModule", code) for b in "ab" for i, m in enumerate(("One", "Two"))]
    return macros.analyze(spark.createDataFrame(rows, "book string, module_ord int, module string, kind string, code string"))


def test_views_and_their_options(analysis):
    nodes, edges = callgraph.view(analysis, most=7)
    assert nodes.groupBy("book").count().collect()[0][1] == 7 and edges.count() == 12
    with pytest.raises(FoliateError) as e:
        callgraph.view(analysis, most=6)
    assert code_of(e) == "graph_too_large"
    assert sorted(r.id for r in callgraph.view(analysis, "one", "HELP", 1, "callers")[0].filter("book = 'a'").collect()) == ["One.Help", "One.Main"]
    assert sorted(r.id for r in callgraph.view(analysis, "TWO")[0].filter("book = 'b' AND NOT is_external").collect()) == ["Two.Help", "Two.Main", "Two.main2"]
    assert render.render_view(analysis, "dot", "flat", module="One").count() == 2
    for code, call in (
        ("invalid_render_option", lambda: render.render_view(analysis, "Mermaid", "round")), ("invalid_render_option", lambda: render.render_view(analysis, layout="round")),
        ("invalid_render_option", lambda: callgraph.view(analysis, None, "Help")), ("invalid_render_option", lambda: callgraph.view(analysis, "One", "Help", direction="up")),
        ("module_not_found", lambda: callgraph.view(analysis, "Three")), ("procedure_not_found", lambda: callgraph.view(analysis, "One", "Nothing")),
    ):
        with pytest.raises(FoliateError) as e:
            call()
        assert code_of(e) == code


def test_only_module_of_each_book(spark, analysis):
    status = spark.createDataFrame([("a", 0, "ONE"), ("b", 0, "One"), ("b", 1, "Two")], "book string, module_ord int, module string")
    assert sorted(tuple(r) for r in macros.only_module(status, status, "one").select("book", "module").collect()) == [("a", "ONE"), ("b", "One")]
    with pytest.raises(FoliateError, match="in a; there are: ONE"):
        macros.only_module(status, status, "Two")


def test_paths_and_save_modes(spark, tmp_path):
    new = str(tmp_path / "x" / "y" / "new.docx")
    assert sinks.create_blank(new) == new and O.word_paragraphs(open(new, "rb").read()) == []
    made = str(tmp_path / "made.docx")
    sinks.save(O.write_word([("Heading 2", "Title"), (None, "a < b")]), made)
    sinks.convert_file(made, str(tmp_path / "out.MARKDOWN"))
    assert (tmp_path / "out.MARKDOWN").read_text(encoding="utf-8-sig") == "## Title\n\na < b"
    sinks.convert_file(made, str(tmp_path / "out.x"), name=" .Text ")
    assert (tmp_path / "out.x").read_text() == "Title\na < b"
    for code, call in (
        ("file_exists", lambda: sinks.create_blank(new)), ("invalid_path", lambda: sinks.create_blank("a/b.docx")), ("invalid_path", lambda: sinks.readable(" ")),
        ("file_not_found", lambda: sinks.convert_file(str(tmp_path / "no.docx"), new)), ("unsupported_format", lambda: sinks.convert_file(made, str(tmp_path / "o.rtf"))),
        ("file_exists", lambda: sinks.save_rows(spark.range(1), str(tmp_path / "x"))),
    ):
        with pytest.raises(FoliateError) as e:
            call()
        assert code_of(e) == code
    assert sinks.create_blank(new, overwrite=True) == new
    sinks.save_rows(spark.range(3), str(tmp_path / "rows"))
    sinks.save_rows(spark.range(5), str(tmp_path / "rows"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 5


def test_json_and_styles(spark):
    df = spark.createDataFrame([(1, None, ["Normal", "quote"])], "a int, b string, s array<string>")
    assert json.loads(sinks.json_rows(df).first()[0]) == {"a": 1, "b": None, "s": ["Normal", "quote"]}
    assert df.select(sinks.with_style(df.s, "Quote"), sinks.with_style(df.s, "Title")).first()[:] == (["Normal", "quote"], ["Normal", "quote", "Title"])
    assert df.select(S.english_style(df.s[0])).first()[0] == "Normal"


def test_typed_metadata(spark, tmp_path):
    path = str(tmp_path / "m.docx")
    sinks.save(O.write_word([(None, "three small words"), (None, "and-more it's")]), path)
    with zipfile.ZipFile(path, "a") as file:
        file.writestr("docProps/core.xml", '<c xmlns:d="d" xmlns:t="t"><d:creator>Ada</d:creator><d:title> </d:title><t:created>2024-05-06T07:08:09Z</t:created><revision>4</revision></c>')
        file.writestr("docProps/app.xml", "<a><Pages>2</Pages><Company>C</Company></a>")
    found = documents.word_metadata(O.read_properties(spark, path), O.read_word_paragraphs(spark, path)).first()
    assert (found.author, found.title, str(found.created), found.modified, found.revision, found.page_count, found.word_count) == ("Ada", None, "2024-05-06 07:08:09", None, 4, 2, 5)
    cells = spark.createDataFrame([(found.path, 0), (found.path, 1)], "path string, sheet_idx int")
    book = documents.book_metadata(O.read_properties(spark, path), cells).first()
    assert (book.author, book.company, book.manager, book.sheet_count) == ("Ada", "C", None, 2)


def test_patterns_are_the_running_engines(spark):
    df = spark.createDataFrame([("aab",)], "t string")
    assert df.select(edits.find_replace(df.t, "a++(?=b)", "x", regex=True)[0]).first()[0] == "xb"
    with pytest.raises(FoliateError):
        edits.find_replace(df.t, "(?P<n>a)", "x", regex=True)


def test_markdown_normalised(spark):
    docs = spark.createDataFrame([(1, "# A *b*\n\nsome *fine words*, then Fine Words\nb*b"), (2, "plain\n"), (3, None)], "doc_id int, markdown string")
    paragraphs, runs = edits.normalised_markdown(docs)
    assert [tuple(r) for r in paragraphs.orderBy("doc_id", "pos").collect()] == [(1, 0, "Heading 1", "A b"), (1, 1, None, "some fine words, then Fine Words"), (1, 2, None, "b*b"), (2, 0, None, "plain")]
    assert [tuple(r)[1:] for r in runs.filter("doc_id = 1").orderBy("pos", "run_no").collect()] == [
        (0, 0, "A ", False), (0, 1, "b", True), (1, 0, "some ", False), (1, 1, "fine words", True), (1, 2, ", then ", False), (1, 3, "Fine Words", True),
        (2, 0, "b", True), (2, 1, "*", False), (2, 2, "b", True),
    ]
    assert [tuple(r) for r in runs.filter("doc_id = 2").collect()] == [(2, 0, 0, "plain", False)]


def test_headings_meet_paragraphs_in_order(spark):
    rows = spark.createDataFrame([(1, i, None, t) for i, t in enumerate(["x", " one ", "two", "one", "two", "three"])], "doc_id int, pos int, style string, text string")
    styles = lambda *h: [r.style for r in edits.styled_headings(rows, spark.createDataFrame([(1, i, n, t) for i, (n, t) in enumerate(h)], "doc_id int, pos int, level int, text string")).orderBy("pos").collect()]
    assert styles((1, "one"), (2, "one"), (3, "two")) == [None, "Heading 1", None, "Heading 2", "Heading 3", None]
    assert styles((1, "two"), (2, "never"), (3, "three")) == [None, None, "Heading 1", None, None, None]
