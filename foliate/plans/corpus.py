"""Stand-in corpora made of the star-schema tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_BODY = """CASE l_linenumber % 7
 WHEN 0 THEN concat('P', CAST(l_partkey + 1 AS STRING))
 WHEN 1 THEN concat('Call X', l_returnflag, '(1)')
 WHEN 2 THEN concat('Worksheets("', l_linestatus, '").Range("A1").Value = Cells')
 WHEN 3 THEN CASE l_partkey % 11
  WHEN 0 THEN 'Shell "tool.exe /q"' WHEN 1 THEN 'Open "list.csv" For Output As #2' WHEN 2 THEN 'Kill "old.tmp"' WHEN 3 THEN 'Set f = New Scripting.FileSystemObject'
  WHEN 4 THEN 'Set o = GetObject(, "Word.Application")' WHEN 5 THEN 'Set o = CreateObject("scripting.filesystemobject")' WHEN 6 THEN 'Dim r As ADODB.Recordset'
  WHEN 7 THEN 'n = URLDownloadToFile(0, u, p, 0, 0)' WHEN 8 THEN 'Set o = CreateObject("WinHttp.WinHttpRequest.5.1")' WHEN 9 THEN 'If Dir("x") <> "" Then MkDir "y"'
  ELSE 'Set o = CreateObject("ADODB.Connection")' END
 WHEN 4 THEN concat('y = 1 ', chr(39), ' Application.Run "Book!M', l_returnflag, '"')
 WHEN 5 THEN concat('Foo a, _', chr(10), '    b')
 ELSE concat('S', CAST(l_suppkey % 10 + 1 AS STRING), '.P', CAST(l_partkey AS STRING)) END"""
_NAME = "concat('P', CAST(p AS STRING), CASE WHEN p % 5 = 0 THEN '_Click' ELSE '' END)"
_HEAD = f"""CASE p % 4
 WHEN 0 THEN concat('Public Sub ', {_NAME}, '()')
 WHEN 1 THEN concat('Private Function ', {_NAME}, '(ByVal a As Long, Optional b As String = "d") As Long')
 WHEN 2 THEN concat('Sub ', {_NAME}, '(ParamArray args() As Variant)')
 ELSE concat('Property Get ', {_NAME}, '() As Variant') END"""
_FOOT = "CASE p % 4 WHEN 1 THEN 'End Function' WHEN 3 THEN 'End Property' ELSE 'End Sub' END"
_KIND = "CASE CAST(m % 3 AS INT) WHEN 0 THEN 'standardModule' WHEN 1 THEN 'classModule' ELSE 'documentModule' END"


def macro_modules(spark: SparkSession, sf_dir: str, by: str = "supplier") -> DataFrame:
    """book, module_ord, module, kind, code: a module a supplier, a procedure a supplier and part, a body line a row.

    by="nation": one module a nation instead, which makes some of them over-long.
    """
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_partkey AS p", "l_orderkey", "l_linenumber", f"{_BODY} AS body")
    if by == "nation":
        nations = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS l_suppkey", "CAST(s_nationkey AS BIGINT) AS m", "concat('N', CAST(s_nationkey AS STRING)) AS module", "'book' AS book")
        rows = rows.join(nations, "l_suppkey")
    else:
        rows = rows.selectExpr("*", "l_suppkey AS m", "concat('S', CAST(l_suppkey AS STRING)) AS module", "concat('book', CAST(l_suppkey % 10 AS STRING)) AS book")
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["t"]), "\n")
    procs = rows.groupBy("book", "m", "module", "l_suppkey", "p").agg(joined(F.struct("l_orderkey", "l_linenumber", F.col("body").alias("t"))).alias("b"))
    procs = procs.selectExpr("book", "m", "module", "l_suppkey", "p", f"concat_ws(chr(10), {_HEAD}, b, {_FOOT}) AS t")
    code = procs.groupBy("book", "m", "module").agg(joined(F.struct("p", "l_suppkey", "t")).alias("code"))
    return code.selectExpr("book", "CAST(m AS INT) AS module_ord", "module", f"{_KIND} AS kind", "code")


def _sql(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


def macro_sql(by: str = "supplier") -> str:
    """CTEs up to `modules`, as macro_modules()."""
    if by == "nation":
        source = "SELECT l.*, CAST(s_nationkey AS BIGINT) AS m, concat('N', s_nationkey) AS module, 'book' AS book FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey"
    else:
        source = "SELECT *, l_suppkey AS m, concat('S', l_suppkey) AS module, concat('book', l_suppkey % 10) AS book FROM lineitem"
    return f"""
src AS (SELECT book, m, module, l_suppkey, l_partkey AS p, l_orderkey, l_linenumber, {_sql(_BODY)} AS body FROM ({source})),
src_procs AS (SELECT book, m, module, l_suppkey, p, string_agg(body, chr(10) ORDER BY l_orderkey, l_linenumber, body) AS b FROM src GROUP BY ALL),
modules AS (
  SELECT book, CAST(m AS INT) AS module_ord, module, {_KIND} AS kind,
         string_agg(concat_ws(chr(10), {_sql(_HEAD)}, b, {_sql(_FOOT)}), chr(10) ORDER BY p, l_suppkey) AS code
  FROM src_procs GROUP BY book, m, module)"""


def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation and supplier as the sheets of one book: a row a key, a formula in every second supplier's row."""
    t = lambda name: table(spark, sf_dir, name)

    def form(i: int, sheet: str, visible: str, r: str, cells: str) -> list[str]:
        return ["'tpch' AS book", f"{i} AS sheet_idx", f"'{sheet}' AS sheet", f"{visible} AS visible", f"CAST({r} AS INT) AS r", f"inline(array({cells}))"]

    cell = lambda c, num, text, formula="CAST(NULL AS STRING)": f"named_struct('c', {c}, 'value_type', '{'number' if num else 'text'}', 'v_num', CAST({num or 'NULL'} AS DOUBLE), 'v_text', CAST({text or 'NULL'} AS STRING), 'formula', {formula})"
    region = t("region").selectExpr(*form(i=0, sheet="Region", visible="true", r="r_regionkey", cells=f"{cell(0, 'r_regionkey', None)}, {cell(1, None, 'r_name')}"))
    nation = t("nation").selectExpr(*form(i=1, sheet="Nation", visible="false", r="n_nationkey + 2", cells=f"{cell(1, 'n_nationkey', None)}, {cell(3, None, 'n_name')}, {cell(4, 'n_regionkey', None)}"))
    formula = "CASE WHEN s_suppkey % 2 = 0 THEN concat('=C', CAST(s_suppkey + 1 AS STRING), '*2') END"
    supplier = t("supplier").selectExpr(*form(i=2, sheet="Supplier", visible="true", r="s_suppkey", cells=f"{cell(1, None, 's_name')}, {cell(2, 's_acctbal', None)}, {cell(27, 's_acctbal * 2', None, formula)}"))
    return region.unionByName(nation).unionByName(supplier).selectExpr("book", "sheet_idx", "sheet", "visible", "r", "c", "value_type", "v_num", "v_text", "formula")


CELLS_SQL = """cells AS (
  SELECT 'tpch' AS book, 0 AS sheet_idx, 'Region' AS sheet, true AS visible, CAST(r_regionkey AS INT) AS r, 0 AS c, 'number' AS value_type, CAST(r_regionkey AS DOUBLE) AS v_num, CAST(NULL AS VARCHAR) AS v_text, CAST(NULL AS VARCHAR) AS formula FROM region
  UNION ALL SELECT 'tpch', 0, 'Region', true, CAST(r_regionkey AS INT), 1, 'text', NULL, r_name, NULL FROM region
  UNION ALL SELECT 'tpch', 1, 'Nation', false, CAST(n_nationkey + 2 AS INT), 1, 'number', n_nationkey, NULL, NULL FROM nation
  UNION ALL SELECT 'tpch', 1, 'Nation', false, CAST(n_nationkey + 2 AS INT), 3, 'text', NULL, n_name, NULL FROM nation
  UNION ALL SELECT 'tpch', 1, 'Nation', false, CAST(n_nationkey + 2 AS INT), 4, 'number', n_regionkey, NULL, NULL FROM nation
  UNION ALL SELECT 'tpch', 2, 'Supplier', true, CAST(s_suppkey AS INT), 1, 'text', NULL, s_name, NULL FROM supplier
  UNION ALL SELECT 'tpch', 2, 'Supplier', true, CAST(s_suppkey AS INT), 2, 'number', s_acctbal, NULL, NULL FROM supplier
  UNION ALL SELECT 'tpch', 2, 'Supplier', true, CAST(s_suppkey AS INT), 27, 'number', s_acctbal * 2, NULL, CASE WHEN s_suppkey % 2 = 0 THEN concat('=C', s_suppkey + 1, '*2') END FROM supplier)"""
