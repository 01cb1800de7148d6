"""Document extraction over paragraphs, runs, tables, comments and revisions, each with explicit ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import count_words, heading_level, null_if_blank, null_if_unset, revision_kind, trimmed, without_breaks


def paragraphs_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, style, text: each line of plain texts as a paragraph without a style."""
    return docs.select(key, F.posexplode(F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n")).alias("pos", "text")).select(key, "pos", F.lit(None).cast("string").alias("style"), "text")


def outline(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, level, text of heading paragraphs with text."""
    rows = paragraphs.withColumn("level", heading_level(F.col("style"))).withColumn("text", trimmed(F.col("text")))
    return rows.filter("level IS NOT NULL AND length(text) > 0").select(key, "pos", "level", "text")


def blocks(paragraphs: DataFrame, tables: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, pos, kind, level, text of non-empty paragraphs outside tables."""
    rows = paragraphs if tables is None else outside_tables(paragraphs, tables, key)
    level = heading_level(F.col("style"))
    text = without_breaks(F.col("text"))
    rows = rows.select(key, "pos", F.when(level.isNotNull(), "heading").otherwise("paragraph").alias("kind"), level.alias("level"), text.alias("text"))
    return rows.filter(F.length("text") > 0)


def outside_tables(paragraphs: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraphs (key, start, ...) whose start lies in no table's [table_start, table_end) of the same document.

    A document's table ranges are gathered into one array first, so the paragraphs meet one row a document and no
    pair of a paragraph and a table is ever made.
    """
    ranges = tables.groupBy(key).agg(F.collect_list(F.struct("table_start", "table_end")).alias("_ranges"))
    inside = lambda r: (F.col("start") >= r["table_start"]) & (F.col("start") < r["table_end"])
    rows = paragraphs.join(ranges, key, "left")
    return rows.filter(F.col("_ranges").isNull() | ~F.exists("_ranges", inside)).drop("_ranges")


def markdown(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, markdown: trimmed non-empty paragraphs with a blank line between, headings with their marks."""
    level, text = heading_level(F.col("style")), trimmed(F.col("text"))
    line = F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(text)
    rows = paragraphs.select(key, F.when(F.length(text) > 0, F.struct("pos", line.alias("line"))).alias("l"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "\n\n").alias("markdown"))


def runs(characters: DataFrame, key: list[str], order: str = "at") -> DataFrame:
    """key, run_no, text, bold, italic: neighbours of equal marks joined; characters are (key, order, text, bold, italic)."""
    w = Window.partitionBy(*key).orderBy(order)
    marks = F.struct("bold", "italic")
    rows = characters.withColumn("_new", (F.coalesce(F.lag(marks).over(w) != marks, F.lit(True))).cast("int"))
    rows = rows.withColumn("run_no", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    return rows.groupBy(*key, "run_no").agg(F.array_join(pieces, "").alias("text"), F.first("bold").alias("bold"), F.first("italic").alias("italic"))


def table_cells(tables: DataFrame, key: list[str]) -> DataFrame:
    """key, r, c, text of tables held as arrays of rows of cells (`rows`)."""
    by_row = tables.select(*key, F.posexplode("rows").alias("r", "cells"))
    return by_row.select(*key, "r", F.posexplode("cells").alias("c", "text")).withColumn("text", without_breaks(F.col("text"), cell=True))


def comments(entries: DataFrame, key: str, order: str) -> DataFrame:
    """key, id, author, date, text, anchor: numbered in document order; a missing author is the empty text."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return entries.select(key, number.alias("id"), F.coalesce("author", F.lit("")).alias("author"), "date", without_breaks(F.col("text")).alias("text"), "anchor")


def revisions(entries: DataFrame, key: str) -> DataFrame:
    return entries.select(key, "pos", revision_kind(F.col("kind")).alias("kind"), "author", F.coalesce("date", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("date"), "text")


def page_metadata(html: Column) -> dict[str, Column]:
    """Title and language of a page; blank values are null."""
    return {"title": null_if_blank(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)), "language": null_if_blank(F.regexp_extract(html, r'<html lang="([^"]*)"', 1))}


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """page_id, pos, style, text of a page's headings, styled `Heading n` by their tag."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<h([1-6])\b[^>]*>.*?</h\1>"), 0)
    rows = pages.select("page_id", F.posexplode(tags).alias("pos", "tag"))
    style = F.concat(F.lit("Heading "), F.regexp_extract("tag", r"(?i)^<h([1-6])", 1))
    return rows.select("page_id", "pos", style.alias("style"), F.regexp_replace("tag", r"<[^>]*>", "").alias("text"))


# fixed values: names of the properties in the files, and of the columns that they become
WORD_PROPERTIES = {"creator": "author", "title": "title", "subject": "subject", "keywords": "keywords", "created": "created", "modified": "modified"}
BOOK_PROPERTIES = WORD_PROPERTIES | {"lastModifiedBy": "last_modified_by", "description": "description", "category": "category", "Application": "application", "Company": "company", "Manager": "manager"}


def metadata(properties: DataFrame, names: dict[str, str], numbers: dict[str, str] | None = None) -> DataFrame:
    """path and a typed column a property of (path, name, value): blank texts are null, moments are timestamps (null
    where the file has none), numbers integers."""
    text = lambda n: null_if_blank(F.max(F.when(F.col("name") == n, F.col("value"))))
    moment = lambda n: null_if_unset(text(n).try_cast("timestamp_ntz"))
    columns = [(moment(n) if c in ("created", "modified") else text(n)).alias(c) for n, c in names.items()]
    return properties.groupBy("path").agg(*columns, *(text(n).try_cast("int").alias(c) for n, c in (numbers or {}).items()))


def word_metadata(properties: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """path, six properties, revision, page_count (the file's own) and word_count (of its paragraphs)."""
    words = paragraphs.groupBy("path").agg(F.sum(count_words(F.col("text"))).cast("int").alias("word_count"))
    found = metadata(properties, WORD_PROPERTIES, {"revision": "revision", "Pages": "page_count"})
    return words.join(found, "path", "left").select("path", *WORD_PROPERTIES.values(), "revision", "page_count", "word_count")


def book_metadata(properties: DataFrame, cells: DataFrame) -> DataFrame:
    """path, twelve properties and sheet_count."""
    sheets = cells.groupBy("path").agg(F.count_distinct("sheet_idx").cast("int").alias("sheet_count"))
    return sheets.join(metadata(properties, BOOK_PROPERTIES), "path", "left").select("path", *BOOK_PROPERTIES.values(), "sheet_count")
