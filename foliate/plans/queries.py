"""The registered queries over documents, workbooks and macro projects, each with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import callgraph, documents, edits, macros, render, sheets
from ..shared import kept
from .corpus import CELLS_SQL, macro_modules, macro_sql, table, workbook_cells

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LINES = "lines AS (SELECT doc_id, CAST(unnest(range(len(a))) AS INT) AS pos, unnest(a) AS text FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM documents))"
TRIM = r"regexp_replace({}, '^[\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}]+|[\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}]+$', '', 'g')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT 'pong' AS answer")
def ping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit("pong").alias("answer"))


# ---- documents -------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)?')) AS INT) AS n_words FROM documents")
def doc_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc(spark, sf_dir).select("doc_id", S.count_words(F.col("text")).alias("n_words"))


@query("SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(text) - len(replace(text, chr(10), '')) + 1 END AS INT) AS n_lines FROM documents")
def doc_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc(spark, sf_dir).select("doc_id", S.count_lines(F.col("text")).alias("n_lines"))


@query(f"WITH {LINES} SELECT doc_id, pos, 'paragraph' AS kind, CAST(NULL AS INT) AS level, rtrim(text, chr(13) || chr(10) || chr(11) || chr(12)) AS text FROM lines WHERE rtrim(text, chr(13) || chr(10) || chr(11) || chr(12)) <> ''")
def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.blocks(documents.paragraphs_of(doc(spark, sf_dir)))


@query(f"WITH {LINES} SELECT doc_id, coalesce(string_agg({TRIM.format('text')}, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE {TRIM.format('text')} <> ''), '') AS markdown FROM lines GROUP BY doc_id")
def doc_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.markdown(documents.paragraphs_of(doc(spark, sf_dir)))


@query(f"""SELECT page_id, CAST(0 AS INT) AS pos, CAST(1 AS INT) AS level, {TRIM.format("regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g')")} AS text FROM pages
WHERE {TRIM.format("regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g')")} <> ''""")
def doc_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.outline(documents.page_paragraphs(table(spark, sf_dir, "pages")), "page_id")


@query("""WITH c AS (SELECT l_orderkey, l_returnflag AS text, l_linestatus = 'O' AS bold, l_quantity > 25 AS italic, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus = 'O', l_quantity > 25) AS k FROM lineitem),
f AS (SELECT *, CASE WHEN lag((bold, italic)) OVER (PARTITION BY l_orderkey ORDER BY k) IS NOT DISTINCT FROM (bold, italic) THEN 0 ELSE 1 END AS n FROM c),
g AS (SELECT *, CAST(sum(n) OVER (PARTITION BY l_orderkey ORDER BY k) - 1 AS INT) AS run_no FROM f)
SELECT l_orderkey, run_no, string_agg(text, '' ORDER BY k) AS text, bool_and(bold) AS bold, bool_and(italic) AS italic FROM g GROUP BY l_orderkey, run_no""")
def doc_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_returnflag").alias("t"), (F.col("l_linestatus") == "O").alias("b"), (F.col("l_quantity") > 25).alias("i")).alias("at"), F.col("l_returnflag").alias("text"), (F.col("l_linestatus") == "O").alias("bold"), (F.col("l_quantity") > 25).alias("italic"))
    return documents.runs(rows, ["l_orderkey"])


@query("""WITH o AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS r FROM orders)
SELECT o_custkey, r, CAST(0 AS INT) AS c, o_orderstatus AS text FROM o UNION ALL SELECT o_custkey, r, CAST(1 AS INT), o_orderpriority FROM o""")
def doc_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.array(F.concat("o_orderstatus", F.lit("\r\x07")), F.col("o_orderpriority"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", cell.alias("cells")))), lambda x: x["cells"])
    return documents.table_cells(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(rows.alias("rows")), ["o_custkey"])


@query(r"""SELECT page_id, url, CASE WHEN regexp_matches(t, '^\s*$') THEN NULL ELSE t END AS title, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS language
FROM (SELECT *, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS t FROM pages)""")
def doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = documents.page_metadata(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", "url", *(c.alias(n) for n, c in meta.items()))


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS id, coalesce(role, '') AS author, CAST(NULL AS TIMESTAMP) AS date, rtrim(text, chr(13) || chr(10) || chr(11) || chr(12)) AS text, CAST(turn AS VARCHAR) AS anchor
FROM conversations WHERE role = 'user'""")
def doc_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("role").alias("author"), F.lit(None).cast("timestamp_ntz").alias("date"), "text", F.col("turn").cast("string").alias("anchor"))
    return documents.comments(rows, "conv_id", "turn")


@query("""SELECT user_id, event_id AS pos, CASE event_id % 5 WHEN 0 THEN 'insert' WHEN 1 THEN 'delete' WHEN 2 THEN 'format' WHEN 3 THEN 'format' ELSE 'moved' END AS kind, event_type AS author, ts AS date, props AS text FROM events""")
def doc_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("Inserted", "Deleted", "ParagraphPropertyChanged", "CharacterStyleDefinitionChanged", "Moved"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), kind.alias("kind"), F.col("event_type").alias("author"), F.col("ts").cast("timestamp_ntz").alias("date"), F.col("props").alias("text"))
    return documents.revisions(rows, "user_id")


TABLES = "(VALUES (500, 900), (1500, 1600), (1550, 2400))"


@query(f"""WITH {LINES}, p AS (SELECT doc_id, pos, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lines)
SELECT doc_id, pos, start FROM p WHERE NOT EXISTS (SELECT 1 FROM {TABLES} t(a, b) WHERE start >= a AND start < b)""")
def para_not_in_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    starts = F.aggregate(lines, F.array(F.lit(0).cast("bigint")), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.length(x) + 1))
    rows = doc(spark, sf_dir).select("doc_id", F.posexplode(F.slice(starts, F.lit(1), F.size(lines))).alias("pos", "start"))
    spans = F.array(*[F.struct(F.lit(a).alias("table_start"), F.lit(b).alias("table_end")) for a, b in ((500, 900), (1500, 1600), (1550, 2400))])
    return documents.outside_tables(rows, doc(spark, sf_dir).select("doc_id", F.inline(spans)))


MARKDOWN = ("# Title", "  ## Second ##  ", "####### seven", "#none", "### *it* and **bold** [x](http://y)", "plain **a** *b* [c](d)", "*one* and *two* and *one*", "**not** this, `code`", "* item *emph* end")


def _values(spark: SparkSession, rows: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


def _list(rows: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join("({}, '{}')".format(i, r.replace("'", "''")) for i, r in enumerate(rows)) + ") v(id, text)"


@query(rf"SELECT CAST(id AS INT) AS id, CAST(length(regexp_extract(text, '^\s*(#{{1,6}})\s+(.+?)\s*#*\s*$', 1)) AS INT) AS level, regexp_extract(text, '^\s*(#{{1,6}})\s+(.+?)\s*#*\s*$', 2) AS heading FROM {_list(MARKDOWN)}")
def md_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    level, text = S.markdown_heading(F.col("text"))
    return _values(spark, MARKDOWN).select("id", level.alias("level"), text.alias("heading"))


@query(rf"SELECT CAST(id AS INT) AS id, regexp_replace(regexp_replace(regexp_replace(text, '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g') AS text FROM {_list(MARKDOWN)}")
def md_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, MARKDOWN).select("id", S.without_inline_marks(F.col("text")).alias("text"))


@query("SELECT CAST(id AS INT) AS id, CAST(n AS INT) AS n, span FROM (VALUES (4, 0, 'it'), (5, 0, 'b'), (6, 0, 'one'), (6, 1, 'two'), (8, 0, 'item')) v(id, n, span)")
def md_italics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, MARKDOWN).select("id", F.posexplode(S.italic_spans(F.col("text"))).alias("n", "span"))


@query(f"""WITH m(id, markdown) AS (SELECT * FROM {_list(("# A" + chr(10) + chr(10) + "x *y*", "z" + chr(10) + "## B"))}), l AS (SELECT id, unnest(string_split(markdown, chr(10))) AS line, unnest(range(len(string_split(markdown, chr(10))))) AS i FROM m)
SELECT CAST(id AS INT) AS id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INT) AS pos, CASE WHEN line LIKE '#%' THEN 'Heading ' || length(regexp_extract(line, '^#+')) END AS style, regexp_replace(regexp_replace(line, '^#+ ', ''), '\\*(.+?)\\*', '\\1', 'g') AS text FROM l WHERE line <> ''""")
def md_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.markdown_paragraphs(_values(spark, ("# A\n\nx *y*", "z\n## B")).withColumnRenamed("text", "markdown"), "id")


@query(f"""WITH {LINES}, c AS (SELECT doc_id, pos, text, unnest(regexp_extract_all(text, '(?i)ing|(?i)the')) AS t FROM lines) SELECT doc_id, CAST(pos AS INT) AS pos, lower(t) AS text, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY ALL""")
def md_italic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = doc(spark, sf_dir).select("doc_id", F.array(F.lit("the"), F.lit("ING"), F.lit("")).alias("spans"))
    runs = edits.italic_runs(documents.paragraphs_of(doc(spark, sf_dir)), spans)
    return runs.filter("italic").groupBy("doc_id", "pos", F.lower("text").alias("text")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {LINES}, h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, CAST(1 + pos % 3 AS INT) AS level, {TRIM.format('text')} AS want FROM lines WHERE pos % 2 = 1),
walk AS (SELECT doc_id, -1 AS pos, CAST(1 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS style FROM (SELECT DISTINCT doc_id FROM lines)
  UNION ALL SELECT w.doc_id, l.pos, CASE WHEN h.want = {TRIM.format('l.text')} THEN w.k + 1 ELSE w.k END, CASE WHEN h.want = {TRIM.format('l.text')} THEN 'Heading ' || h.level END
  FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.pos = w.pos + 1 LEFT JOIN h ON h.doc_id = w.doc_id AND h.k = w.k)
SELECT w.doc_id, CAST(w.pos AS INT) AS pos, w.style, l.text FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.pos = w.pos""")
def md_styled_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.paragraphs_of(doc(spark, sf_dir))
    wanted = rows.filter("pos % 2 = 1").select("doc_id", "pos", (F.col("pos") % 3 + 1).cast("int").alias("level"), S.trimmed(F.col("text")).alias("text"))
    return edits.styled_headings(rows, wanted)


# ---- edits -----------------------------------------------------------------------------------------------------


def _replaced(spark: SparkSession, sf_dir: str, *args: object, **more: bool) -> DataFrame:
    text, n = edits.find_replace(F.col("text"), *args, **more)
    return doc(spark, sf_dir).select("doc_id", text.alias("text"), n.alias("replacements"))


@query("SELECT doc_id, regexp_replace(text, '(?i)the', 'X$1\\\\', 'g') AS text, CAST(len(regexp_extract_all(text, '(?i)the')) AS INT) AS replacements FROM documents")
def find_replace_literal_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replaced(spark, sf_dir, "the", "X$1\\")


@query("SELECT doc_id, replace(text, 'The', 'A.') AS text, CAST((length(text) - length(replace(text, 'The', ''))) / 3 AS INT) AS replacements FROM documents")
def find_replace_literal_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replaced(spark, sf_dir, "The", "A.", match_case=True)


@query(r"SELECT doc_id, regexp_replace(text, '(?i)([a-z]+)ing', '\1ed', 'g') AS text, CAST(len(regexp_extract_all(text, '(?i)([a-z]+)ing')) AS INT) AS replacements FROM documents")
def find_replace_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replaced(spark, sf_dir, "([a-z]+)ing", "$1ed", regex=True)


@query("""SELECT event_id, 'Dear ' || event_type || ', key ' || json_extract_string(props, '$.k') || ' / ' || json_extract_string(props, '$.k') || '.' AS merged FROM events""")
def mail_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.concat(F.lit("Dear "), "event_type", F.lit(", key {{k}} / {{K}}."))
    data = F.map_concat(S.json_texts(F.col("props")), F.create_map(F.lit("K"), F.lit("unused")))
    return table(spark, sf_dir, "events").select("event_id", edits.mail_merge(template, data).alias("merged"))


@query("SELECT event_id, ['Name', 'K'] AS missing FROM events")
def mail_merge_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", edits.missing_fields(F.lit("{{k}} {{Name}} {{K}} {{Name}}"), S.json_texts(F.col("props"))).alias("missing"))


@query(f"WITH {LINES} SELECT doc_id, CAST(CASE WHEN pos >= 1 THEN pos + 1 ELSE pos END AS INT) AS pos, CAST(NULL AS VARCHAR) AS style, text FROM lines UNION ALL SELECT DISTINCT doc_id, CAST(1 AS INT), 'Quote', 'inserted' FROM documents")
def insert_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.insert_paragraph(documents.paragraphs_of(doc(spark, sf_dir)), 1, "inserted", "Quote")


@query("""SELECT n_regionkey, CAST(r AS INT) AS r, CAST(c AS INT) AS c, text FROM (
 SELECT n_regionkey, 0 AS r, c, ['Name', 'Key', 'More'][c + 1] AS text FROM (SELECT DISTINCT n_regionkey FROM nation), range(3) x(c)
 UNION ALL SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey, c ORDER BY n_nationkey), c, [n_name, CAST(n_nationkey AS VARCHAR), ''][c + 1] FROM nation, range(3) x(c))""")
def insert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.when(F.col("n_nationkey") % 2 == 0, F.array("n_name", F.col("n_nationkey").cast("string"))).otherwise(F.array(F.col("n_name"), F.col("n_nationkey").cast("string"), F.lit(""), F.lit("cut")))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", cells.alias("x")))), lambda s: s["x"]).alias("given"))
    return documents.table_cells(rows.select("n_regionkey", edits.table_rows(F.array(F.lit("Name"), F.lit("Key"), F.lit("More")), F.col("given")).alias("rows")), ["n_regionkey"])


@query("SELECT doc_id, key, value FROM (SELECT doc_id, 'author' AS key, 'Ada' AS value FROM documents UNION ALL SELECT doc_id, 'title', source FROM documents UNION ALL SELECT doc_id, 'subject', 'S' FROM documents)")
def set_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = F.create_map(F.lit("title"), F.col("source"), F.lit("author"), F.col("lang"))
    return doc(spark, sf_dir).select("doc_id", F.explode(edits.set_metadata(current, {"Author": "Ada", "SUBJECT": "S"})))


@query(f"""WITH {LINES} SELECT doc_id, pos, CAST(NULL AS VARCHAR) AS style, text FROM lines
UNION ALL SELECT doc_id, CAST(max(pos) + 1 AS INT), 'Heading 2', 'Added' FROM lines GROUP BY doc_id UNION ALL SELECT doc_id, CAST(max(pos) + 2 AS INT), NULL, 'a bold end' FROM lines GROUP BY doc_id""")
def append_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = doc(spark, sf_dir).select("doc_id", F.lit("## Added\n\na **bold** end\n").alias("markdown"))
    return edits.append_markdown(documents.paragraphs_of(doc(spark, sf_dir)), added)


FORMATS = (("", "a.HTM"), (" .Text ", "a.x"), ("markdown", "b"), (None, "c/d.docx"), ("pdf", "e.txt"), ("odt", "f.txt"), (None, "noext"))


@query("SELECT CAST(id AS INT) AS id, format FROM (VALUES (0, 'html'), (1, 'txt'), (2, 'md'), (3, 'docx'), (4, 'pdf'), (5, NULL), (6, NULL)) v(id, format)")
def convert_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(FORMATS)], "id int, name string, path string")
    return rows.select("id", S.output_format(F.col("name"), F.col("path")).alias("format"))


# ---- workbooks -------------------------------------------------------------------------------------------------

A1 = "CASE WHEN c >= 26 THEN chr(CAST(64 + c // 26 AS INT)) ELSE '' END || chr(CAST(65 + c % 26 AS INT))"
LIST_SQL = f"""used AS (SELECT book, sheet_idx, sheet, visible, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, count(formula) AS n FROM cells GROUP BY ALL),
listed AS (SELECT book, sheet_idx AS "index", sheet AS name, visible, 'worksheet' AS kind, ({A1.replace("c ", "c0 ")}) || (r0 + 1) || ':' || ({A1.replace("c ", "c1 ")}) || (r1 + 1) AS used_range, CAST(r1 - r0 + 1 AS INT) AS n_rows, CAST(c1 - c0 + 1 AS INT) AS n_columns, n FROM used)"""


@query(f"WITH {CELLS_SQL}, {LIST_SQL} SELECT * EXCLUDE (n) FROM listed")
def sheet_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.list_sheets(workbook_cells(spark, sf_dir))


@query(f"WITH {CELLS_SQL}, {LIST_SQL} SELECT * EXCLUDE (n), CAST(n AS INT) AS formula_count, CAST(0 AS INT) AS table_count FROM listed")
def sheet_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.sheet_structure(workbook_cells(spark, sf_dir))


@query(f"WITH {CELLS_SQL} SELECT book, sheet, r, c, ({A1}) || (r + 1) AS address, value_type, v_num, v_text, formula FROM cells WHERE r BETWEEN 2 AND 40 AND c BETWEEN 1 AND 27")
def sheet_read_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.read_cells(workbook_cells(spark, sf_dir), "B3:AB41")


@query(f"""WITH {CELLS_SQL}, grid AS (SELECT book, sheet, r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT DISTINCT book, sheet, r FROM cells) JOIN (SELECT book, sheet, min(c) AS c0, max(c) AS c1 FROM cells GROUP BY ALL) USING (book, sheet))
SELECT book, sheet, r, list(v_text ORDER BY c) AS texts FROM grid LEFT JOIN cells USING (book, sheet, r, c) GROUP BY ALL""")
def sheet_read_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sheets.read_rows(workbook_cells(spark, sf_dir))
    return rows.filter(F.exists("values", lambda v: v.isNotNull())).select("book", "sheet", "r", F.col("values.v_text").alias("texts"))


@query(f"""WITH {CELLS_SQL}, span AS (SELECT book, sheet, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM cells GROUP BY ALL), every_row AS (SELECT book, sheet, c0, c1, unnest(range(r0, r1 + 1)) AS r FROM span), grid AS (SELECT book, sheet, r, unnest(range(c0, c1 + 1)) AS c FROM every_row)
SELECT book, sheet, r, list(value_type ORDER BY c) AS value_types, list(v_num ORDER BY c) AS numbers, list(v_text ORDER BY c) AS texts FROM grid LEFT JOIN cells USING (book, sheet, r, c) GROUP BY ALL""")
def sheet_read_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sheets.read_rows(workbook_cells(spark, sf_dir))
    return rows.select("book", "sheet", "r", *(F.col(f"values.{c}").alias(name) for c, name in (("value_type", "value_types"), ("v_num", "numbers"), ("v_text", "texts"))))


@query(f"WITH {CELLS_SQL} SELECT * FROM cells WHERE upper(sheet) = 'NATION'")
def sheet_by_name_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.by_name(workbook_cells(spark, sf_dir), "nAtIoN", 0)


@query(f"WITH {CELLS_SQL} SELECT * FROM cells WHERE sheet_idx = 2")
def sheet_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.by_name(workbook_cells(spark, sf_dir), " ", 2)


@query(f"WITH {CELLS_SQL} SELECT book, sheet_idx, sheet, r, c, ({A1}) || (r + 1) AS address, formula, value_type, v_num, v_text FROM cells WHERE formula IS NOT NULL")
def formula_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.list_formulas(workbook_cells(spark, sf_dir), values=True, most=None)


NAMES_SQL = """names AS (SELECT 'tpch' AS book, CAST(NULL AS VARCHAR) AS scope, 'Rate_' || r_regionkey AS name, '=0.' || r_regionkey AS refers_to, CAST(NULL AS VARCHAR) AS comment, false AS is_hidden FROM region
UNION ALL SELECT 'tpch', 'Nation', 'Row_' || n_nationkey, '=Nation!$A$' || (n_nationkey + 1), n_name, n_nationkey % 2 = 1 FROM nation)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = table(spark, sf_dir, "region").selectExpr("'tpch' AS book", "concat('Rate_', r_regionkey) AS name", "concat('=0.', r_regionkey) AS refers_to", "CAST(NULL AS STRING) AS comment", "false AS is_hidden")
    sheet = table(spark, sf_dir, "nation").selectExpr("'tpch' AS book", "'Nation' AS sheet", "concat('Row_', n_nationkey) AS name", "concat('=Nation!$A$', n_nationkey + 1) AS refers_to", "n_name AS comment", "n_nationkey % 2 = 1 AS is_hidden")
    return sheets.defined_names(book, sheet)


@query(f"WITH {NAMES_SQL} SELECT * FROM names")
def defined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir)


@query(f"WITH {CELLS_SQL}, {NAMES_SQL} SELECT book, CAST(count(DISTINCT sheet_idx) AS INT) AS sheet_count, CAST((SELECT count(*) FROM names) AS INT) AS defined_name_count FROM cells GROUP BY book")
def workbook_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.workbook_structure(workbook_cells(spark, sf_dir), _names(spark, sf_dir))




# ---- macro projects --------------------------------------------------------------------------------------------

CLEAN = r"""CASE WHEN regexp_matches(raw, '(?i)^\s*rem(\s.*)?$') THEN regexp_extract(raw, '^(\s*)', 1)
 ELSE array_to_string(list_transform(regexp_extract_all(raw, '(?s)"(?:[^"]|"")*(?:"|$)|''.*$|[^"'']+'), lambda p: CASE WHEN p[1] = '"' THEN '"<STR>"' WHEN p[1] = '''' THEN '' ELSE p END), '') END"""
MORE = r"regexp_matches({}, '\s_\s*$')"
CUT = r"regexp_replace({}, '_\s*$', '') || ' '"


def lines_sql(by: str = "supplier") -> str:
    return f"""WITH {macro_sql(by)},
raws AS (SELECT book, module_ord, module, kind, unnest(a) AS raw, CAST(unnest(range(len(a))) AS INT) AS ln FROM (SELECT *, string_split(replace(code, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM modules WHERE code <> '')),
cleaned AS (SELECT *, {CLEAN} AS clean, {MORE.format("raw")} AS more FROM raws),
placed AS (SELECT *, CAST(coalesce(sum(CASE WHEN more THEN 0 ELSE 1 END) OVER (PARTITION BY book, module_ord ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS idx FROM cleaned),
all_lines AS (SELECT book, module_ord, module, kind, idx, CAST(min(ln) + 1 AS INT) AS line,
  string_agg(CASE WHEN more THEN CASE WHEN {MORE.format("clean")} THEN {CUT.format("clean")} ELSE clean || ' ' END ELSE clean END, '' ORDER BY ln) AS text,
  string_agg(CASE WHEN more THEN {CUT.format("raw")} ELSE raw END, '' ORDER BY ln) AS original_text FROM placed GROUP BY book, module_ord, module, kind, idx)"""


OPEN_RE = r"(?i)^\s*(public|private|friend)?\s*(?:static\s+)?(sub|function|property\s+get|property\s+let|property\s+set)\s+(\w+)\s*\("


def procs_sql(by: str = "supplier", whole: bool = False) -> str:
    """Up to `procedures`: of all modules if `whole`, else of those of 5,000 lines at most."""
    cut = """sizes AS (SELECT book, module_ord, count(*) AS n FROM all_lines GROUP BY ALL),
lines AS (SELECT l.* FROM all_lines l JOIN sizes USING (book, module_ord) WHERE n <= 5000),"""
    return f"""{lines_sql(by)},
{"lines AS (SELECT * FROM all_lines)," if whole else cut}
heads AS (SELECT *, regexp_matches(text, '{OPEN_RE}[^()]*(\\(\\)[^()]*)?\\)') AS is_open, regexp_matches(text, '(?i)^\\s*end\\s+(sub|function|property)\\s*$') AS is_close,
  max(idx) OVER (PARTITION BY book, module_ord) AS last_idx, max(line) OVER (PARTITION BY book, module_ord) AS last_line FROM lines),
runs AS (SELECT *, coalesce(sum(is_close::INT) OVER (PARTITION BY book, module_ord ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM heads),
ends AS (SELECT book, module_ord, run, min(CASE WHEN is_close THEN idx END) AS close_idx, min(CASE WHEN is_close THEN line END) AS close_line, min(CASE WHEN is_open THEN idx END) AS open_idx FROM runs GROUP BY ALL),
procs AS (SELECT r.book, r.module_ord, r.module, r.kind AS module_kind, regexp_extract(text, '{OPEN_RE}', 3) AS name, r.module || '.' || regexp_extract(text, '{OPEN_RE}', 3) AS fqn,
  regexp_replace(regexp_extract(text, '{OPEN_RE}', 2), '\\s+', '', 'g') AS kind, nullif(regexp_extract(text, '{OPEN_RE}', 1), '') AS scope, nullif(regexp_extract(text, '\\)\\s+As\\s+(\\w+)$', 1), '') AS return_type,
  line AS line_start, coalesce(close_line, last_line) AS line_end, CAST(idx + 1 AS INT) AS body_start, CAST(coalesce(close_idx - 1, last_idx) AS INT) AS body_end, text
  FROM runs r JOIN ends e ON r.book = e.book AND r.module_ord = e.module_ord AND r.run = e.run AND r.idx = e.open_idx),
procedures AS (SELECT * EXCLUDE (text), text, module_kind <> 'standardModule' AND instr(name, '_') > 1 AND instr(name, '_') < length(name) AS is_event_handler FROM procs)"""


def body_sql(by: str = "supplier", whole: bool = False) -> str:
    return f"""{procs_sql(by, whole)},
body AS (SELECT l.book, l.module_ord, l.module, p.name AS proc, p.fqn, p.line_start AS proc_line, l.idx, l.line, l.text, l.original_text FROM lines l JOIN procedures p ON l.book = p.book AND l.module_ord = p.module_ord AND l.idx BETWEEN p.body_start AND p.body_end)"""


KEYWORD_LIST = ", ".join(f"'{k.upper()}'" for k in macros.KEYWORDS)
CALL_RE = r"(?i)^\s*(?:call\s+)?([a-z_]\w*)\s*(?:\(|\.|$)"
MEMBER_RE = r"(?i)^\s*(?:call\s+)?([a-z_]\w*\.\w+)"


def edges_sql(by: str = "supplier", whole: bool = False) -> str:
    return f"""{body_sql(by, whole)},
run_calls AS (SELECT book, module_ord, module, proc, fqn, proc_line, line, unnest(regexp_extract_all(original_text, '(?i)application\\s*\\.\\s*run\\s+"([^"]+)"', 1)) AS target, CAST(0 AS INT) AS ord, CAST(NULL AS BOOLEAN) AS qualified FROM body),
direct AS (SELECT book, module_ord, module, proc, fqn, proc_line, line, regexp_extract(text, '{CALL_RE}', 1) AS name, nullif(regexp_extract(text, '{MEMBER_RE}', 1), '') AS member FROM body WHERE NOT regexp_matches(text, '(?i)^\\s*[a-z_]\\w*\\s*=')),
direct_calls AS (SELECT book, module_ord, module, proc, fqn, proc_line, line, coalesce(member, name) AS target, CAST(1000000 AS INT) AS ord, member IS NOT NULL AS qualified FROM direct WHERE name <> '' AND upper(name) NOT IN ({KEYWORD_LIST}) AND upper(name) <> upper(proc)),
sites AS (SELECT *, upper(target) AS key FROM run_calls UNION ALL SELECT *, upper(target) FROM direct_calls),
own AS (SELECT book, module_ord, upper(name) AS key, arg_min(fqn, line_start) AS own_fqn FROM procedures GROUP BY ALL),
anywhere AS (SELECT book, upper(name) AS key, arg_min(fqn, CAST(module_ord AS BIGINT) * 1000000000 + line_start) AS any_fqn FROM procedures GROUP BY ALL),
known AS (SELECT DISTINCT book, upper(fqn) AS key, true AS is_known FROM procedures),
edges AS (SELECT s.book, s.fqn AS from_id, CASE WHEN qualified = false THEN coalesce(own_fqn, any_fqn, target) ELSE target END AS to_id,
  CASE WHEN qualified = false THEN coalesce(own_fqn, any_fqn) IS NOT NULL WHEN qualified THEN coalesce(is_known, false) ELSE false END AS resolved, s.module_ord, s.module, s.proc, s.proc_line, s.line, s.ord
  FROM sites s LEFT JOIN own USING (book, module_ord, key) LEFT JOIN anywhere a ON s.book = a.book AND s.key = a.key LEFT JOIN known k ON s.book = k.book AND s.key = k.key)"""


API_RE = "(?i)\\b(worksheets|sheets|range|cells|activesheet|activeworkbook|thisworkbook|application|selection|names)\\b"
REFS_SQL = f"""given AS (SELECT book, module_ord, module, proc, line, unnest(regexp_extract_all(original_text, '{API_RE}\\s*\\(\\s*"([^"]*)"')) AS whole FROM body),
with_literal AS (SELECT book, module_ord, module, proc, line, regexp_extract(whole, '{API_RE}', 1) AS api, regexp_extract(whole, '"([^"]*)"', 1) AS literal FROM given),
words AS (SELECT book, module_ord, module, proc, line, unnest(regexp_extract_all(original_text, '{API_RE}', 1)) AS api FROM body),
counts AS (SELECT w.book, w.module_ord, w.module, w.proc, w.line, w.api, count(*) - coalesce((SELECT count(*) FROM with_literal g WHERE g.book = w.book AND g.module_ord = w.module_ord AND g.line = w.line AND g.api = w.api), 0) AS n FROM words w GROUP BY w.book, w.module_ord, w.module, w.proc, w.line, w.api),
refs AS (SELECT * FROM with_literal UNION ALL SELECT book, module_ord, module, proc, line, api, CAST(NULL AS VARCHAR) FROM counts, range(n))"""
DEPS_SQL = r"""hits AS (SELECT book, module_ord, module, proc, line, text, lower(regexp_extract(original_text, '(?i)(CreateObject|GetObject)\s*\(\s*[^"]*"([^"]+)"', 1)) AS made, nullif(regexp_extract(original_text, '(?i)(CreateObject|GetObject)\s*\(\s*[^"]*"([^"]+)"', 2), '') AS program,
  nullif(regexp_extract(text, '(?i)\b(Kill|MkDir|RmDir|ChDir|Dir|FileSystemObject|Workbooks\.Open|Workbooks\.OpenText|Scripting\.FileSystemObject)\b', 1), '') AS file_word,
  CASE WHEN regexp_matches(text, '(?i)^\s*Shell\b') THEN 1 WHEN regexp_matches(text, '(?i)^\s*Open\s+') THEN 2 WHEN file_word IS NOT NULL THEN 3 WHEN program IS NOT NULL THEN 4
       WHEN regexp_matches(text, '(?i)\b(ADODB\.|DAO\.|OpenDatabase)\b') THEN 5 WHEN regexp_matches(text, '(?i)\b(MSXML2\.XMLHTTP|WinHttp\.WinHttpRequest|URLDownloadToFile|InternetExplorer\.Application)\b') THEN 6 END AS rule FROM body),
deps AS (SELECT book, module_ord, module, proc, line,
  CASE rule WHEN 1 THEN 'shell' WHEN 2 THEN 'file' WHEN 3 THEN 'file' WHEN 5 THEN 'database' WHEN 6 THEN 'network'
    ELSE CASE WHEN program ILIKE 'adodb.%' OR program ILIKE 'dao.%' THEN 'database' WHEN program ILIKE 'msxml2.%' OR program ILIKE 'winhttp.%' OR program ILIKE 'internetexplorer.application' THEN 'network' WHEN program ILIKE '%filesystemobject%' THEN 'file' ELSE 'automation' END END AS dependency,
  CASE WHEN rule = 4 THEN program END AS target,
  CASE rule WHEN 1 THEN 'Shell' WHEN 2 THEN 'Open' WHEN 3 THEN file_word WHEN 4 THEN CASE made WHEN 'getobject' THEN 'GetObject' ELSE 'CreateObject' END END AS operation FROM hits WHERE rule IS NOT NULL)"""


def _analysis(spark: SparkSession, sf_dir: str, by: str = "supplier") -> dict[str, DataFrame]:
    return macros.analyze(macro_modules(spark, sf_dir, by))


@query(f"{lines_sql()} SELECT * FROM all_lines")
def vba_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir)["lines"]


@query(f"{procs_sql()} SELECT book, module_ord, module, module_kind, name, fqn, kind, scope, return_type, line_start, line_end, is_event_handler, CASE WHEN is_event_handler THEN string_split(name, '_')[1] END AS event_target, body_start, body_end FROM procedures")
def vba_procs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir)["procedures"].drop("arguments")


@query(f"{procs_sql()} SELECT book, module, fqn, CASE WHEN is_event_handler THEN string_split(name, '_')[1] END AS event_target FROM procedures WHERE is_event_handler")
def vba_event_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir)["procedures"].filter("is_event_handler").select("book", "module", "fqn", "event_target")


PARAM_ROWS = "(VALUES ('Function', 0, 'a', 'Long', false, false, NULL), ('Function', 1, 'b', 'String', true, true, '\"<STR>\"'), ('Sub', 0, 'args()', 'Variant', true, false, NULL)) v(of_kind, param_no, name, type, by_ref, optional, default_value)"


@query(f"{procs_sql()} SELECT p.book, p.module_ord, p.fqn, p.kind, p.line_start, CAST(v.param_no AS INT) AS param_no, v.name, v.type, v.by_ref, v.optional, v.default_value FROM procedures p JOIN {PARAM_ROWS} ON v.of_kind = p.kind WHERE p.text NOT LIKE '%()' OR p.text LIKE '%args()%'")
def vba_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir)["parameters"]


@query(f"{lines_sql('nation')}, n AS (SELECT book, module_ord, count(*) AS n FROM all_lines GROUP BY ALL) SELECT book, module_ord, module, kind, n <= 5000 AS parsed, CASE WHEN n > 5000 THEN 'module_too_large' END AS reason, CAST(n AS INT) AS n_lines FROM modules JOIN n USING (book, module_ord)")
def vba_module_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir, "nation")["status"]


@query(f"{edges_sql()} SELECT * FROM edges")
def vba_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir)["edges"]


@query(f"{edges_sql()} SELECT * FROM edges WHERE module = 'S3' OR resolved AND starts_with(to_id, 'S3.')")
def vba_edges_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macros.touching_module(_analysis(spark, sf_dir)["edges"], "S3")


@query(f"{body_sql()}, {REFS_SQL} SELECT * FROM refs")
def vba_om_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir)["references"]


@query(f"{body_sql()}, {DEPS_SQL} SELECT * FROM deps")
def vba_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir)["dependencies"]


@query("""SELECT book, module, CAST(type AS INT) AS type, kind FROM (VALUES ('b', 'Mod1', 33, 'standardModule'), ('b', 'FORM1', 34, 'userForm'), ('b', 'thisworkbook', 34, 'documentModule'), ('b', 'Ark1', 34, 'documentModule'), ('b', 'Sheet9', 34, 'classModule')) v(book, module, type, kind)""")
def vba_module_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame([("b", n, t) for n, t in (("Mod1", 0x21), ("FORM1", 0x22), ("thisworkbook", 0x22), ("Ark1", 0x22), ("Sheet9", 0x22))], "book string, module string, type int")
    names = lambda *x: spark.createDataFrame([("b", n) for n in x], "book string, name string")
    return macros.module_kind(entries, names("Form1"), names("ThisWorkbook", "ARK1"))


@query(f"""{edges_sql()}, {REFS_SQL}, {DEPS_SQL}
SELECT m.book, count(*) AS modules, count(*) FILTER (WHERE coalesce(n, 0) BETWEEN 1 AND 5000) AS parsed_modules, count(*) FILTER (WHERE coalesce(n, 0) NOT BETWEEN 1 AND 5000) AS unparsed_modules,
  (SELECT count(*) FROM procedures p WHERE p.book = m.book) AS procedures, (SELECT count(*) FROM procedures p WHERE p.book = m.book AND is_event_handler) AS event_handlers,
  (SELECT count(*) FROM edges e WHERE e.book = m.book) AS call_edges, (SELECT count(*) FROM refs r WHERE r.book = m.book) AS object_references, (SELECT count(*) FROM deps d WHERE d.book = m.book) AS dependencies
FROM modules m LEFT JOIN sizes USING (book, module_ord) GROUP BY m.book""")
def vba_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir)["summary"]


# ---- call graphs -----------------------------------------------------------------------------------------------


def nodes_sql(whole: bool = False) -> str:
    return f"""{edges_sql(whole=whole)},
nodes AS (SELECT book, fqn AS id, arg_max(name, line_start) AS label, arg_max(module, line_start) AS module, arg_max(is_event_handler, line_start) AS is_event_handler FROM procedures GROUP BY book, fqn),
links AS (SELECT DISTINCT e.book, e.from_id, e.to_id FROM edges e JOIN nodes a ON a.book = e.book AND a.id = e.from_id JOIN nodes b ON b.book = e.book AND b.id = e.to_id)"""


SUB_SQL = """alive AS (SELECT n.* FROM nodes n WHERE (book, id) IN (SELECT book, id FROM ids)),
kept AS (SELECT e.book, e.from_id, CASE WHEN b.id IS NULL THEN '__ext__' || e.to_id ELSE e.to_id END AS to_id, e.to_id AS name, e.resolved AND b.id IS NOT NULL AS resolved, e.module_ord, e.proc_line, e.line, e.ord, b.id IS NULL AS outside
  FROM edges e JOIN alive a ON a.book = e.book AND a.id = e.from_id LEFT JOIN alive b ON b.book = e.book AND b.id = e.to_id WHERE b.id IS NOT NULL OR NOT e.resolved),
degrees AS (SELECT book, id, count(*) AS degree FROM (SELECT book, from_id AS id FROM kept UNION ALL SELECT book, to_id FROM kept) GROUP BY ALL),
everything AS (SELECT *, false AS is_external FROM alive UNION ALL SELECT DISTINCT book, to_id, name, NULL, false, true FROM kept WHERE outside),
cg_nodes AS (SELECT e.book, e.id, label, module, is_event_handler, NOT is_external AND NOT is_event_handler AND degree IS NULL AS is_orphan, is_external, coalesce(degree, 0) AS degree FROM everything e LEFT JOIN degrees d ON d.book = e.book AND d.id = e.id)"""
ALL_IDS = "ids AS (SELECT book, id FROM nodes)"
MODULE_IDS = "own AS (SELECT book, id FROM nodes WHERE module = 'S3'), ids AS (SELECT * FROM own UNION SELECT l.book, to_id FROM links l JOIN own o ON o.book = l.book AND o.id = from_id UNION SELECT l.book, from_id FROM links l JOIN own o ON o.book = l.book AND o.id = to_id)".replace("own AS", "own_ids AS").replace("FROM own", "FROM own_ids").replace("JOIN own o", "JOIN own_ids o")


def bfs_sql(direction: str, whole: bool = False) -> str:
    arcs = {"callees": "SELECT book, from_id AS id, to_id AS next FROM links", "callers": "SELECT book, to_id AS id, from_id AS next FROM links"}
    arcs["both"] = f"{arcs['callees']} UNION ALL {arcs['callers']}"
    return f"""{nodes_sql(whole).replace("WITH", "WITH RECURSIVE", 1)}, arcs AS ({arcs[direction]}), start AS (SELECT book, min(id) AS id FROM nodes WHERE module = 'S3' AND upper(label) = upper((SELECT min(label) FROM nodes WHERE module = 'S3')) GROUP BY book),
hops AS (SELECT book, id, 0 AS d FROM start UNION SELECT a.book, a.next, d + 1 FROM hops h JOIN arcs a ON a.book = h.book AND a.id = h.id WHERE d < 2), ids AS (SELECT DISTINCT book, id FROM hops)"""


EDGE_COLUMNS = "book, from_id, to_id, resolved, module_ord, proc_line, line, ord"


def _graph(spark: SparkSession, sf_dir: str, module: str | None = None, most: int | None = macros.MOST_LINES) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, as tables, since a view reads them several times: of all books, or of those with the module.
    `most` is None where the query's SQL takes modules of any length."""
    modules = macro_modules(spark, sf_dir)
    a = macros.graph_tables(modules if module is None else macros.of_books_with(modules, module), kept, most)
    return kept(callgraph.graph_nodes(a["procedures"]), "nodes"), kept(a["edges"], "edges")


@query(f"{nodes_sql(whole=True)}, {ALL_IDS}, {SUB_SQL} SELECT * FROM cg_nodes")
def cg_nodes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir, most=None)
    return callgraph.subgraph(nodes.select("book", "id"), nodes, edges)[0]


@query(f"{nodes_sql()}, {ALL_IDS}, {SUB_SQL} SELECT {EDGE_COLUMNS} FROM kept")
def cg_edges_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return callgraph.subgraph(nodes.select("book", "id"), nodes, edges)[1]


@query(f"{nodes_sql(whole=True)}, {MODULE_IDS}, {SUB_SQL} SELECT * FROM cg_nodes")
def cg_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir, "S3", most=None)
    return callgraph.subgraph(callgraph.module_view(nodes, edges, "s3"), nodes, edges)[0]


@query(f"{nodes_sql(whole=True)}, {MODULE_IDS}, {SUB_SQL} SELECT {EDGE_COLUMNS} FROM kept")
def cg_module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir, "S3", most=None)
    return callgraph.subgraph(callgraph.module_view(nodes, edges, "s3"), nodes, edges)[1]


def _hops(spark: SparkSession, sf_dir: str, direction: str, most: int | None = macros.MOST_LINES) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir, "S3", most)
    first = nodes.filter("module = 'S3'").agg(F.min("label")).first()[0]
    return callgraph.subgraph(callgraph.hops_from(nodes, edges, "S3", first or "", 2, direction), nodes, edges)[0]


@query(f"{bfs_sql('callees')}, {SUB_SQL} SELECT * FROM cg_nodes")
def cg_bfs_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hops(spark, sf_dir, "callees")


@query(f"{bfs_sql('callers')}, {SUB_SQL} SELECT * FROM cg_nodes")
def cg_bfs_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hops(spark, sf_dir, "callers")


@query(f"{bfs_sql('both', whole=True)}, {SUB_SQL} SELECT * FROM cg_nodes")
def cg_bfs_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hops(spark, sf_dir, "both", most=None)


SAFE = "regexp_replace({}, '[^\\p{{L}}\\p{{Nd}}_]', '_', 'g')"
PLACE = "lpad(CAST(module_ord AS VARCHAR), 9, '0') || lpad(CAST(proc_line AS VARCHAR), 9, '0') || lpad(CAST(line AS VARCHAR), 9, '0') || lpad(CAST(ord AS VARCHAR), 9, '0')"


def render_sql(format: str, whole: bool = False) -> str:
    nl = "chr(10)"
    if format == "mermaid":
        node = f"""{SAFE.format('id')} || CASE WHEN is_event_handler THEN '([' || label || '])' ELSE '[' || label || ']' END || CASE WHEN is_external THEN ':::external' WHEN is_event_handler THEN ':::handler' WHEN is_orphan THEN ':::orphan' ELSE '' END"""
        begin, end = f"'  subgraph ' || {SAFE.format('module')}", "'  end'"
        edge = f"'  ' || {SAFE.format('from_id')} || CASE WHEN resolved THEN ' --> ' ELSE ' -.-> ' END || {SAFE.format('to_id')}"
    else:
        style = """CASE WHEN is_external THEN ', shape=box, style="dashed,filled", fillcolor="#f5f5f5"' WHEN is_event_handler THEN ', shape=oval, style="filled", fillcolor="#e1f5ff"' WHEN is_orphan THEN ', style="dashed"' ELSE '' END"""
        node = f"""'"' || replace(id, '"', '\\"') || '" [label="' || replace(label, '"', '\\"') || '"' || {style} || '];'"""
        begin, end = f"""'  subgraph cluster_' || {SAFE.format('module')} || ' {{' || {nl} || '    label="' || module || '";'""", "'  }'"
        edge = """'  "' || from_id || '" -> "' || replace(to_id, '"', '\\"') || '"' || CASE WHEN resolved THEN ';' ELSE ' [style="dashed"];' END"""
    head = " || chr(10) || ".join("'{}'".format(x) for x in render.HEAD[format])
    tail = " || chr(10) || ".join("'{}'".format(x) for x in render.TAIL[format])
    return f"""{nodes_sql(whole)}, {MODULE_IDS}, {SUB_SQL},
out_lines AS (SELECT book, CASE WHEN is_external THEN 2 ELSE 1 END AS s, coalesce(module, '') AS g, '1' || id AS p, CASE WHEN is_external THEN '  ' ELSE '    ' END || {node} AS t FROM cg_nodes
  UNION ALL SELECT DISTINCT book, 1, module, '0', {begin} FROM cg_nodes WHERE NOT is_external UNION ALL SELECT DISTINCT book, 1, module, '2', {end} FROM cg_nodes WHERE NOT is_external
  UNION ALL SELECT book, 3, '', {PLACE}, {edge} FROM kept)
SELECT book, {head} || {nl} || string_agg(t, {nl} ORDER BY s, g, p, t) || {nl} || {tail} || {nl} AS rendered FROM out_lines GROUP BY book"""


def _rendered(spark: SparkSession, sf_dir: str, format: str, most: int | None = macros.MOST_LINES) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir, "S3", most)
    return render.render(*callgraph.subgraph(callgraph.module_view(nodes, edges, "S3"), nodes, edges), format)


@query(render_sql("mermaid", whole=True))
def cg_render_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "mermaid", most=None)


@query(render_sql("dot"))
def cg_render_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "dot")
