import pytest

from foliate.errors import FoliateError
from foliate.operators import callgraph, macros, render


def analyze(spark, *modules, **more):
    rows = [("b", i, name, kind, code) for i, (name, kind, code) in enumerate(modules)]
    return macros.analyze(spark.createDataFrame(rows, "book string, module_ord int, module string, kind string, code string"), **more)


def analyze_cases(spark, cases):
    """Each case's modules as a book of its own, so that one job does for all."""
    rows = [(str(n), i, name, kind, code) for n, modules in enumerate(cases) for i, (name, kind, code) in enumerate(modules)]
    return macros.analyze(spark.createDataFrame(rows, "book string, module_ord int, module string, kind string, code string"))


def by_case(df, n, *columns):
    out = [[] for _ in range(n)]
    for r in df.select("book", *columns).collect():
        out[int(r.book)].append(tuple(r)[1:])
    return [sorted(x, key=repr) for x in out]


def std(code, name="M"):
    return (name, "standardModule", code)


CALLS = [
    ([std("Sub Main()\nPrepare\nEnd Sub\nSub Prepare()\nEnd Sub")], [("M.Main", "M.Prepare", True, 2)]),
    ([std("Sub Main()\n  Call Prepare(3)\nEnd Sub\nSub Prepare(n)\nEnd Sub")], [("M.Main", "M.Prepare", True, 2)]),
    ([std("Sub Main()\nWriteTotals\nEnd Sub", "Report"), std("Sub WriteTotals()\nEnd Sub", "Totals")], [("Report.Main", "Totals.WriteTotals", True, 2)]),
    ([std('Sub Main()\nn = 2: Application.Run "Stock.xlsb!Refill"\nEnd Sub')], [("M.Main", "Stock.xlsb!Refill", False, 2)]),
    ([std("Sub Main()\nSelect Case k\nStatic n As Integer\nEnd Select\nEnd Sub")], []),
    ([std("Function Main()\ntotal = total + 1\n\nPrepare\nEnd Function\nSub Prepare()\nEnd Sub")], [("M.Main", "M.Prepare", True, 4)]),
    ([std("Sub Main()\ntotals.writetotals\nEnd Sub", "Report"), std("Sub WriteTotals()\nEnd Sub", "Totals")], [("Report.Main", "totals.writetotals", True, 2)]),
    ([std("Sub Main()\nArchive.Move\nEnd Sub")], [("M.Main", "Archive.Move", False, 2)]),
    ([std("Sub Main()\nRaiseEvent Finished\nPrepare 1, 2\nMain\nEnd Sub")], []),
    ([std("Sub Main()\nbox.Caption = 7\nEnd Sub")], [("M.Main", "box.Caption", False, 2)]),
    ([std("Sub Main()\nPrepare\nEnd Sub\nSub Prepare()\nEnd Sub", "One"), std("Sub Prepare()\nEnd Sub", "Two")], [("One.Main", "One.Prepare", True, 2)]),
]


def test_calls(spark):
    a = analyze_cases(spark, [m for m, _ in CALLS])
    assert by_case(a["edges"], len(CALLS), "from_id", "to_id", "resolved", "line") == [e for _, e in CALLS]


LINES = [
    ("n = 4 ' four", [(1, "n = 4 ")]), ('t = "no \'remark\' here" & u', [(1, 't = "<STR>" & u')]), ('t = """quoted"" words"', [(1, 't = "<STR>"')]),
    ("\tREM nothing runs here", [(1, "\t")]), ("rem\nn = 4", [(1, ""), (2, "n = 4")]), ("Function Area(w, _\r\n h)", [(1, "Function Area(w,   h)")]),
    ("n = 4 ' four _\nm = 5", [(1, "n = 4  m = 5")]), ("Stop _", [(1, "Stop  ")]), ("a, _\nb, _  \nc\nd", [(1, "a,  b,  c"), (4, "d")]), ("_\nx_\n _", [(1, "_"), (2, "x_"), (3, "  ")]),
    ('s = "open _\nt"', [(1, 's = "<STR>" t"<STR>"')]),
]


def test_lines(spark):
    a = analyze_cases(spark, [[std(c)] for c, _ in LINES])
    assert by_case(a["lines"], len(LINES), "line", "text") == [e for _, e in LINES]


def test_procedures(spark):
    code = 'Public Static Sub Cached()\nEnd Sub\nFunction F(Optional x As Variant = Array(1, 2), ParamArray args() As Variant) As Long\nSub Inner()\nEnd Function\nProperty  Get P() As Scripting.Dictionary\nEnd Property\nSub NoParen\nEnd Sub\nSub Open_End(ByVal s As String = "d")\nx = 1'
    a = analyze(spark, ("C", "classModule", code))
    rows = [(r.name, r.kind, r.scope, r.return_type, r.line_start, r.line_end, r.is_event_handler, r.event_target) for r in a["procedures"].orderBy("line_start").collect()]
    assert rows == [
        ("Cached", "Sub", "Public", None, 1, 2, False, None), ("F", "Function", None, "Long", 3, 5, False, None),
        ("P", "PropertyGet", None, "Scripting", 6, 7, False, None), ("Open_End", "Sub", None, None, 10, 11, True, "Open"),
    ]
    params = [(r.name, r.type, r.by_ref, r.optional, r.default_value) for r in a["parameters"].orderBy("line_start", "param_no").collect()]
    assert params == [("x", "Variant", True, True, "Array(1, 2)"), ("args()", "Variant", True, False, None), ("s", "String", False, False, '"<STR>"')]


DEPENDENCIES = [
    ('Open "stock.dat" For Binary As #3', ("file", None, "Open")), ('Set r = CreateObject("DAO.DBEngine.120")', ("database", "DAO.DBEngine.120", "CreateObject")),
    ('Set q = createobject("WinHttp.WinHttpRequest.5.1")', ("network", "WinHttp.WinHttpRequest.5.1", "CreateObject")), ('Shell "sort.exe /r"', ("shell", None, "Shell")),
    ('Set w = GetObject(, "Word.Application")', ("automation", "Word.Application", "GetObject")), ("MkDir p", ("file", None, "MkDir")), ("Shelling p", None),
    ("Dim c As ADODB.Command", ("database", None, None)), ("URLDownloadToFile 0, a, b, 0, 0", ("network", None, None)),
]


def test_dependencies(spark):
    a = analyze_cases(spark, [[std(f"Sub A()\n{line}\nEnd Sub")] for line, _ in DEPENDENCIES])
    assert by_case(a["dependencies"], len(DEPENDENCIES), "dependency", "target", "operation") == [[e] if e else [] for _, e in DEPENDENCIES]


def test_references(spark):
    a = analyze(spark, std('Sub A()\nSet r = Range("Names").Cells \' Selection\nEnd Sub'))
    assert sorted((r.api, r.literal or "") for r in a["references"].collect()) == [("Cells", ""), ("Names", ""), ("Range", "Names"), ("Selection", "")]


def test_status_and_summary(spark):
    a = analyze(spark, ("E", "classModule", ""), ("N", "classModule", None), std("Sub A()\n" + "x = 1\n" * 30 + "End Sub", "Big"), std("Sub A()\nEnd Sub"), most=10)
    assert [(r.module, r.parsed, r.reason) for r in a["status"].orderBy("module_ord").collect()] == [("E", False, "empty_source"), ("N", False, "empty_source"), ("Big", False, "module_too_large"), ("M", True, None)]
    assert tuple(a["summary"].first()) == ("b", 4, 1, 3, 1, 0, 0, 0, 0)


def graph(spark):
    a = analyze(spark, std("Sub A()\nB\nLost.Foo\nEnd Sub\nSub B()\nC\nEnd Sub\nSub Alone()\nEnd Sub"), ("W", "documentModule", 'Sub C()\nA\nEnd Sub\nSub Workbook_Open()\nEnd Sub'))
    return callgraph.graph_nodes(a["procedures"]), a["edges"]


def test_views(spark):
    nodes, links = graph(spark)
    ids = lambda df: sorted(r.id for r in df.select("id").collect())
    assert ids(callgraph.hops_from(nodes, links, "m", "a", 0)) == ["M.A"]
    assert ids(callgraph.hops_from(nodes, links, "M", "A", 1, "callees")) == ["M.A", "M.B"]
    assert ids(callgraph.hops_from(nodes, links, "M", "A", 1, "callers")) == ["M.A", "W.C"]
    assert ids(callgraph.hops_from(nodes, links, "M", "A", 5)) == ["M.A", "M.B", "W.C"]
    assert ids(callgraph.module_view(nodes, links, "W")) == ["M.A", "M.B", "W.C", "W.Workbook_Open"]
    seen, kept = callgraph.subgraph(nodes.select("book", "id"), nodes, links)
    flags = {r.id: (r.is_orphan, r.is_external, r.degree) for r in seen.collect()}
    assert flags == {"M.A": (False, False, 3), "M.B": (False, False, 2), "W.C": (False, False, 2), "M.Alone": (True, False, 0), "W.Workbook_Open": (False, False, 0), "__ext__Lost.Foo": (False, True, 1)}
    with pytest.raises(FoliateError, match="procedure_not_found"):
        callgraph.hops_from(nodes, links, "M", "nobody")
    with pytest.raises(FoliateError, match="invalid_render_option"):
        callgraph.hops_from(nodes, links, "M", "A", 1, "up")
    with pytest.raises(FoliateError, match="graph_too_large"):
        callgraph.at_most(nodes, 2)
    text = render.render(seen, kept, "mermaid").first().rendered
    assert text.startswith("flowchart TD\n  subgraph M\n") and "    M_Alone[Alone]:::orphan" in text and "  M_A -.-> __ext__Lost_Foo" in text and text.endswith("3 3\n")
    dot = render.render(seen, kept, "dot", "flat").first().rendered
    assert '"M.A" -> "M.B";' in dot and '[style="dashed"];' in dot and dot.count("{") == dot.count("}")
    for bad in (dict(format="svg"), dict(layout="round")):
        with pytest.raises(FoliateError, match="invalid_render_option"):
            render.render(seen, kept, **bad)


def test_module_filter(spark):
    a = analyze(spark, std("Sub A()\nEnd Sub"))
    assert macros.only_module(a["procedures"], a["status"], "m").count() == 1
    with pytest.raises(FoliateError, match="module_not_found"):
        macros.only_module(a["procedures"], a["status"], "x")


def test_graph_tables_are_those_of_the_analysis_from_one_table(spark):
    """Nested brackets, array parameters, quotes and run-by-name beside headers that are cut at once; a view of one
    module takes the books that have it in any case, and no others."""
    cases = [modules for modules, _ in CALLS] + [
        [std('Sub Q(a() As Long, Optional b = F(1, 2), c)\nApplication.Run "X": Prepare\nEnd Sub\nSub Broken(a, b\nSub Prepare()\nQ 1\nCall Q(2)\nEnd Sub\nPrepare')],
        [("Sheet1", "documentModule", "Sub Go_Click(a, b)\ny = 'Application.Run \"Z\"\nGo_Click\nQ\nEnd Sub\nSub Go_Click()\nQ(1)\nEnd Sub")],
    ]
    rows = [(str(n), i, *module) for n, modules in enumerate(cases) for i, module in enumerate(modules)]
    modules = spark.createDataFrame(rows, "book string, module_ord int, module string, kind string, code string")
    whole, kept = macros.analyze(modules), []

    def keep(df, label):
        kept.append(label)
        return df

    graph = macros.graph_tables(modules, keep)
    assert kept == ["calls"]
    same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)
    assert same(graph["edges"], whole["edges"])
    assert same(graph["procedures"], whole["procedures"])
    books = lambda most: {r.book for r in macros.of_books_with(modules, "rEpOrT", most).collect()}
    assert books(1000) == books(0) == {b for b, _, name, *_ in rows if name == "Report"}
    assert macros.of_books_with(modules, "absent").isEmpty()
