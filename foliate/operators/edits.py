"""Edits of documents as transformations: each gives the new rows, and leaves the old ones as they are."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FoliateError, fail_when
from ..functions.strings import english_style, italic_spans, json_texts, markdown_heading, trimmed, without_inline_marks


def java_quote(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def find_replace(text: Column, find: str, replace: str, regex: bool = False, match_case: bool = False) -> tuple[Column, Column]:
    """(new text, number of replacements). Literal search ignores case unless match_case."""
    if regex:
        try:  # by the engine that will run it
            SparkSession.active()._jvm.java.util.regex.Pattern.compile(find)
        except IllegalArgumentException as e:
            raise FoliateError("io_error", f"bad pattern: {find}") from e
        pattern, new = find if match_case else f"(?iu){find}", replace
    else:
        pattern = java_quote(find) if match_case else f"(?iu){java_quote(find)}"
        new = replace.replace("\\", r"\\").replace("$", r"\$")
    return F.regexp_replace(text, pattern, new), F.regexp_count(text, F.lit(pattern)).cast("int")


def insert_paragraph(paragraphs: DataFrame, at: int, text: str, style: str | None = None, key: str = "doc_id") -> DataFrame:
    """Every document with a paragraph more at position `at`; beyond a document's end it is an error."""
    if at < 0:
        raise FoliateError("index_out_of_range", f"position {at}")
    moved = paragraphs.withColumn("pos", F.when(F.col("pos") >= at, F.col("pos") + 1).otherwise(F.col("pos")))
    sizes = paragraphs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    checked = fail_when(F.col("_n") < at, "index_out_of_range", F.format_string("position %d of %d", F.lit(at), F.col("_n")), F.lit(at))
    new = sizes.select(key, checked.cast("int").alias("pos"), F.lit(style).cast("string").alias("style"), F.lit(text).alias("text"))
    return moved.select(key, "pos", "style", "text").unionByName(new)


def table_rows(headers: Column, rows: Column) -> Column:
    """Rows of a new table: the headers, then each row cut or padded with blanks to their number."""
    n = F.size(headers)
    fit = lambda r: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(r, i), F.lit("")))
    return fail_when(n < 1, "parse_error", "a table needs a header", F.concat(F.array(headers), F.transform(rows, fit)))


METADATA_KEYS = ("author", "title", "subject", "keywords")


def set_metadata(current: Column, changes: dict[str, str]) -> Column:
    """The property map with changes; only four properties can be set, in any case."""
    low = {k.lower(): v for k, v in changes.items()}
    if unknown := sorted(set(low) - set(METADATA_KEYS)):
        raise FoliateError("unsupported_format", f"unknown property: {', '.join(unknown)}")
    if not low:
        return current
    new = F.create_map(*[F.lit(x) for pair in low.items() for x in pair])
    return F.map_concat(F.map_filter(current, lambda k, _: ~k.isin(*low)), new)


TOKEN = r"(?U)\{\{(\w+)\}\}"


def merge_tokens(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(TOKEN), 1))


def missing_fields(template: Column, data: Column) -> Column:
    """Tokens of the template without a value in the map, in order of appearance; names are case-sensitive."""
    return F.array_except(merge_tokens(template), F.map_keys(data))


def mail_merge(template: Column, data: Column, checked: bool = True) -> Column:
    """The template with its tokens replaced one after the other, each in any case and also in what earlier values
    brought in. Missing fields are an error that names them all."""

    def replace(text: Column, token: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iu)\{\{\Q"), token, F.lit(r"\E\}\}"))
        value = F.replace(F.replace(F.coalesce(F.element_at(data, token), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.regexp_replace(text, pattern, value)

    merged = F.aggregate(merge_tokens(template), template, replace)
    if not checked:
        return merged
    lacking = missing_fields(template, data)
    return fail_when(F.size(lacking) > 0, "merge_field_missing", F.array_join(lacking, ", "), merged)


def merge_json(template: Column, data: Column) -> Column:
    """mail_merge() with a JSON object; malformed text is an error."""
    values = json_texts(data)
    return fail_when(values.isNull(), "parse_error", "the data are not a JSON object", mail_merge(template, F.coalesce(values, F.create_map().cast("map<string,string>"))))


def markdown_paragraphs(docs: DataFrame, key: str = "doc_id", column: str = "markdown") -> DataFrame:
    """key, pos, style, text of Markdown: headings with their style, other non-empty lines without inline marks."""
    lines = F.split(F.replace(F.replace(F.col(column), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")
    rows = docs.select(key, F.posexplode(F.filter(lines, lambda x: F.length(trimmed(x)) > 0)).alias("pos", "line"))
    level, heading = markdown_heading(F.col("line"))
    style = F.when(level > 0, F.concat(F.lit("Heading "), level.cast("string")))
    return rows.select(key, "pos", style.alias("style"), without_inline_marks(F.when(level > 0, heading).otherwise(trimmed(F.col("line")))).alias("text"))


def append_markdown(paragraphs: DataFrame, added: DataFrame, key: str = "doc_id") -> DataFrame:
    """paragraphs followed by those of `added` (key, markdown), numbered on from each document's last."""
    last = paragraphs.groupBy(key).agg((F.max("pos") + 1).alias("_n"))
    new = markdown_paragraphs(added, key).join(last, key, "left").withColumn("pos", (F.col("pos") + F.coalesce("_n", F.lit(0))).cast("int")).drop("_n")
    return paragraphs.select(key, "pos", "style", "text").unionByName(new.select(key, "pos", "style", "text"))


def styled_headings(paragraphs: DataFrame, headings: DataFrame, key: str = "doc_id") -> DataFrame:
    """paragraphs (key, pos, style, text) with heading styles by an ordered match to headings (key, pos, level, text).

    One pass over a document's paragraphs in order: each is held against the next heading that is still to be found,
    takes its style if its trimmed text is the same, and then the heading after it is next. So a heading that never
    comes leaves all later ones without effect. A document is one row here, as it is in a file.
    """
    own = paragraphs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "style", "text"))).alias("p"))
    wanted = headings.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "level", "text"))).alias("h"))
    rows = own.join(wanted, key, "left").withColumn("h", F.coalesce("h", F.array().cast("array<struct<pos:int,level:int,text:string>>")))
    # the places of the paragraphs that met a heading, in order: the n-th met the n-th heading
    met = F.aggregate(F.transform("p", lambda p: trimmed(p["text"])), F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("at")),
                      lambda a, t: F.struct((a["i"] + 1).alias("i"), F.when(t == F.get("h", F.size(a["at"]))["text"], F.array_append(a["at"], a["i"])).otherwise(a["at"]).alias("at")), lambda a: a["at"])
    rows = rows.withColumn("met", met)
    n = lambda i: F.array_position("met", i).cast("int") - 1
    style = lambda p, i: F.when(F.array_contains("met", i), F.concat(F.lit("Heading "), F.get("h", n(i))["level"].cast("string"))).otherwise(p["style"])
    out = rows.select(key, F.explode(F.transform("p", lambda p, i: F.struct(p["pos"].alias("pos"), style(p, i).alias("style"), p["text"].alias("text")))).alias("x"))
    return out.select(key, "x.pos", "x.style", "x.text")


def italic_runs(paragraphs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, run_no, text, italic: paragraphs cut into runs, where every occurrence, in any case, of a document's
    spans (key, spans: an array of texts) is italic. Of spans that begin at one place the longest counts."""
    order = lambda a: F.array_sort(a, lambda x, y: F.length(y) - F.length(x))
    quoted = F.array_join(F.transform(order(F.filter("spans", lambda s: s != "")), lambda s: F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), "|")
    rows = paragraphs.join(spans.select(key, quoted.alias("_any")), key, "left")
    found = F.concat(F.lit("(?isu)"), F.col("_any"), F.lit("|.+?(?="), F.col("_any"), F.lit("|\\z)"))
    pieces = F.when(F.coalesce("_any", F.lit("")) == "", F.array("text")).otherwise(F.regexp_extract_all("text", found, F.lit(0)))
    is_span = F.concat(F.lit("(?isu)^(?:"), F.col("_any"), F.lit(")$"))
    cut = rows.select(key, "pos", "_any", is_span.alias("_is"), F.posexplode(pieces).alias("run_no", "text"))
    return cut.select(key, "pos", "run_no", "text", F.when(F.coalesce("_any", F.lit("")) == "", False).otherwise(F.regexp_like("text", F.col("_is"))).alias("italic"))


def normalised_markdown(docs: DataFrame, key: str = "doc_id", column: str = "markdown") -> tuple[DataFrame, DataFrame]:
    """(paragraphs, runs) of Markdown documents: paragraphs with English heading styles, runs with italics."""
    paragraphs = markdown_paragraphs(docs, key, column)
    paragraphs = paragraphs.withColumn("style", english_style(F.col("style")))
    return paragraphs, italic_runs(paragraphs, docs.select(key, italic_spans(F.col(column)).alias("spans")), key)
