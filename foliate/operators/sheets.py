"""Workbooks as long cells: (book, sheet_idx, sheet, visible, r, c, value_type, v_num, v_text, formula)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FoliateError
from ..functions.strings import a1_cell, a1_range, parse_a1


def list_sheets(cells: DataFrame) -> DataFrame:
    """book, index, name, visible, kind, used_range, n_rows, n_columns."""
    used = cells.groupBy("book", F.col("sheet_idx").alias("index"), F.col("sheet").alias("name"), "visible").agg(F.min("r").alias("r0"), F.min("c").alias("c0"), F.max("r").alias("r1"), F.max("c").alias("c1"))
    return used.select(
        "book", "index", "name", "visible", F.lit("worksheet").alias("kind"), a1_range(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1")).alias("used_range"),
        (F.col("r1") - F.col("r0") + 1).cast("int").alias("n_rows"), (F.col("c1") - F.col("c0") + 1).cast("int").alias("n_columns"),
    )


def sheet_structure(cells: DataFrame, tables: DataFrame | None = None, formula_counts: bool = True) -> DataFrame:
    """list_sheets() with formula_count (0 if not asked for) and table_count."""
    counts = cells.groupBy("book", F.col("sheet_idx").alias("index")).agg(F.count_if(F.col("formula").isNotNull()).cast("int").alias("formula_count"))
    out = list_sheets(cells).join(counts, ["book", "index"]) if formula_counts else list_sheets(cells).withColumn("formula_count", F.lit(0))
    if tables is None:
        return out.withColumn("table_count", F.lit(0))
    n = tables.groupBy("book", F.col("sheet_idx").alias("index")).agg(F.count(F.lit(1)).cast("int").alias("table_count"))
    return out.join(n, ["book", "index"], "left").na.fill(0, ["table_count"])


def by_name(cells: DataFrame, name: str | None, index: int = 0) -> DataFrame:
    """Cells of the sheet of that name in any case, or, with a blank name, of that index."""
    if name is None or not name.strip():
        return cells.filter(F.col("sheet_idx") == index)
    return cells.filter(F.upper("sheet") == name.upper())


def require_sheet(cells: DataFrame, name: str | None, index: int = 0) -> DataFrame:
    """by_name(), where every book must have that sheet."""
    out = by_name(cells, name, index)
    lacking = cells.select("book").distinct().join(out.select("book").distinct(), "book", "left_anti").orderBy("book").first()
    if lacking is not None:
        raise FoliateError("sheet_not_found", f"no sheet {name} in {lacking.book}") if name and name.strip() else FoliateError("index_out_of_range", f"no sheet {index} in {lacking.book}")
    return out


def read_cells(cells: DataFrame, reference: str | None = None, formulas: bool = True, most: int | None = 50_000) -> DataFrame:
    """Cells of an A1 range with their address, or of each sheet's used range. Before any cell is given back, the size
    of the range, or of the largest used range of one sheet, is held against `most`."""
    out = cells
    if reference:
        r0, c0, r1, c1 = parse_a1(reference)
        if most is not None and (n := (r1 - r0 + 1) * (c1 - c0 + 1)) > most:
            raise FoliateError("range_too_large", f"{reference} has {n} cells; at most {most} are read")
        out = cells.filter(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))
    elif most is not None:
        size = (F.max("r") - F.min("r") + 1).cast("long") * (F.max("c") - F.min("c") + 1)
        over = cells.groupBy("book", "sheet").agg(size.alias("n")).filter(F.col("n") > most).orderBy("book", "sheet").first()
        if over is not None:
            raise FoliateError("range_too_large", f"sheet {over.sheet} of {over.book} has {over.n} cells; at most {most} are read")
    formula = F.col("formula") if formulas else F.lit(None).cast("string")
    return out.select("book", "sheet", "r", "c", a1_cell(F.col("r"), F.col("c")).alias("address"), "value_type", "v_num", "v_text", formula.alias("formula"))


def read_rows(cells: DataFrame) -> DataFrame:
    """book, sheet, r, values: for every row of the sheet's used range a dense row of (value_type, v_num, v_text) over
    its used columns, null where a cell is empty or missing."""
    span = cells.groupBy("book", "sheet").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    every = span.withColumn("r", F.explode(F.sequence("r0", "r1")))
    rows = cells.filter("value_type <> 'empty'").groupBy("book", "sheet", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("value_type", "v_num", "v_text")))).alias("m"))
    return every.join(rows, ["book", "sheet", "r"], "left").select("book", "sheet", "r", F.transform(F.sequence("c0", "c1"), lambda c: F.element_at("m", c)).alias("values"))


def list_formulas(cells: DataFrame, values: bool = False, most: int | None = 10_000) -> DataFrame:
    """book, sheet_idx, sheet, r, c, address, formula (and value_type, v_num, v_text). A book of more than `most` is an
    error."""
    out = cells.filter("formula IS NOT NULL")
    if most is not None:
        over = out.groupBy("book").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).orderBy("book").first()
        if over is not None:
            raise FoliateError("range_too_large", f"{over.book} has {over.n} formulas; at most {most} are listed")
    return out.select("book", "sheet_idx", "sheet", "r", "c", a1_cell(F.col("r"), F.col("c")).alias("address"), "formula", *(["value_type", "v_num", "v_text"] if values else []))


def defined_names(book_names: DataFrame, sheet_names: DataFrame) -> DataFrame:
    """book, name, scope, refers_to, comment, is_hidden: workbook names (scope null), then sheets' names."""
    rest = ["name", "refers_to", "comment", "is_hidden"]
    return book_names.select("book", F.lit(None).cast("string").alias("scope"), *rest).unionByName(sheet_names.select("book", F.col("sheet").alias("scope"), *rest))


def workbook_structure(cells: DataFrame, names: DataFrame) -> DataFrame:
    """book, sheet_count, defined_name_count."""
    sheets = cells.groupBy("book").agg(F.count_distinct("sheet_idx").cast("int").alias("sheet_count"))
    n = names.groupBy("book").agg(F.count(F.lit(1)).cast("int").alias("defined_name_count"))
    return sheets.join(n, "book", "left").na.fill(0)
