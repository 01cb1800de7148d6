"""Column functions on text. Patterns use Java's Unicode classes, as the texts are in any language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chain(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def null_if_blank(text: Column) -> Column:
    return F.when(~text.rlike(r"(?U)^\s*$"), text)


def null_if_unset(moment: Column) -> Column:
    """The first day of year 1 stands for no date."""
    return F.nullif(moment, F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def without_breaks(text: Column, cell: bool = False) -> Column:
    """Without line, page and (for table cells) bell characters at the end."""
    return F.rtrim(text, F.lit("\r\n\x0b\x0c" + "\x07" * cell))


def lines_of(text: Column, lone_returns: bool = False) -> Column:
    text = chain(text, ("\r\n", "\n"))
    return F.split(chain(text, ("\r", "\n")) if lone_returns else text, "\n")


def count_lines(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1).cast("int")


def count_words(text: Column) -> Column:
    """Runs of letters and digits, an apostrophe or hyphen inside allowed once."""
    return F.regexp_count(text, F.lit(r"(?U)\b[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)?\b")).cast("int")


def heading_level(style: Column) -> Column:
    """The number of a style named `Heading n`, in any case; else null."""
    return F.when(F.lower(style).startswith("heading "), F.substring(style, 9, 32).try_cast("int"))


def a1_column(number: Column) -> Column:
    """Letters of a column number from 1, up to three of them."""
    n = number.cast("int")
    letter = lambda x: F.char(F.lit(65) + x.cast("int"))
    low, mid, high = F.pmod(n - 1, F.lit(26)), F.floor((n - 27) / 26), F.floor((n - 703) / 676)
    return F.concat(
        F.when(n > 702, letter(F.pmod(high, F.lit(26)))).otherwise(""),
        F.when(n > 26, letter(F.pmod(mid, F.lit(26)))).otherwise(""),
        letter(low),
    )


def a1_cell(row: Column, column: Column) -> Column:
    """The address of a cell numbered from 0."""
    return F.concat(a1_column(column + 1), (row + 1).cast("int").cast("string"))


def a1_range(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    """`A1:B2`, or the cell's own address where both ends are one."""
    first, last = a1_cell(r0, c0), a1_cell(r1, c1)
    return F.when(first == last, first).otherwise(F.concat(first, F.lit(":"), last))


def a1_number(letters: Column) -> Column:
    """The column number from 1 of letters in any case."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)


def parse_a1(reference: str) -> tuple[int, int, int, int]:
    """(first row, first column, last row, last column) from 0 of an A1 reference, on the driver."""
    import re

    from ..errors import FoliateError

    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?", reference.strip())
    if not m:
        raise FoliateError("parse_error", f"not a cell range: {reference}")

    def number(letters: str) -> int:
        out = 0
        for c in letters.upper():
            out = out * 26 + ord(c) - 64
        return out - 1

    a, b = (number(m[1]), int(m[2]) - 1), (number(m[3] or m[1]), int(m[4] or m[2]) - 1)
    return min(a[1], b[1]), min(a[0], b[0]), max(a[1], b[1]), max(a[0], b[0])


def markdown_heading(line: Column) -> tuple[Column, Column]:
    """(level, text) of an ATX heading line; level 0 where it is none."""
    # fixed value: what counts as a heading
    pattern = r"(?Ud)^\s*(#{1,6})\s+(.+?)\s*#*\s*$"
    return F.length(F.regexp_extract(line, pattern, 1)), F.regexp_extract(line, pattern, 2)


def without_inline_marks(text: Column) -> Column:
    """Bold, italic and link marks of Markdown removed, in this order."""
    # fixed values: the marks, in the order in which they go
    text = F.regexp_replace(text, r"(?d)\*\*(.+?)\*\*", "$1")
    text = F.regexp_replace(text, r"(?d)\*(.+?)\*", "$1")
    return F.regexp_replace(text, r"(?d)\[([^\]]+)\]\([^)]+\)", "$1")


def italic_spans(text: Column) -> Column:
    """Distinct texts in single asterisks outside fenced code."""
    plain = F.regexp_replace(text, r"(?s)```.*?```", "")
    # fixed value: what counts as emphasis
    found = F.regexp_extract_all(plain, F.lit(r"(?d)(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda x: without_inline_marks(trimmed(x))), lambda x: x != ""))


def english_style(style: Column) -> Column:
    """`Titre1` to `Titre6` in any case as `Heading 1` to `Heading 6`."""
    return F.regexp_replace(style, r"(?i)^Titre\s*([1-6])$", "Heading $1")


# fixed values: kinds of tracked changes that only change formatting
FORMAT_CHANGES = (
    "characterpropertychanged", "paragraphpropertychanged", "sectionpropertychanged", "tablepropertychanged",
    "tablerowpropertychanged", "tablecellpropertychanged", "characterstyledefinitionchanged", "paragraphstyledefinitionchanged",
)


def revision_kind(kind: Column) -> Column:
    """insert, delete or format; other names in lower case."""
    low = F.lower(kind)
    return F.when(low == "inserted", "insert").when(low == "deleted", "delete").when(low.isin(*FORMAT_CHANGES), "format").otherwise(low)


def mangled(name: Column) -> Column:
    """An identifier for graph files: all but letters, digits and `_` become `_`. Different names can meet."""
    return F.regexp_replace(name, r"[^\p{L}\p{Nd}_]", "_")


def mermaid_label(text: Column) -> Column:
    return chain(text, ('"', "&quot;"), ("[", "&#91;"), ("]", "&#93;"), ("(", "&#40;"), (")", "&#41;"))


def dot_string(text: Column) -> Column:
    return F.concat(F.lit('"'), chain(text, ("\\", "\\\\"), ('"', '\\"')), F.lit('"'))


def output_format(name: Column, path: Column) -> Column:
    """The format's canonical name from an explicit name, or else the path's extension; null if unknown."""
    asked = F.coalesce(null_if_blank(name), F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    low = F.lower(F.regexp_replace(trimmed(asked), r"^\.+", ""))
    return F.when(low == "htm", "html").when(low == "text", "txt").when(low == "markdown", "md").when(low.isin("pdf", "html", "rtf", "txt", "md", "docx"), low)


def json_texts(data: Column) -> Column:
    """A JSON object as a map of texts: strings as they are, true and false capitalised, null as the empty text.

    A JSON null gives an empty map; malformed text gives null.
    """
    parsed = F.from_json(data, "map<string,string>")
    text = F.transform_values(parsed, lambda _, v: F.when(v.isin("true", "false"), F.initcap(v)).otherwise(F.coalesce(v, F.lit(""))))
    return F.when(F.trim(data) == "null", F.create_map().cast("map<string,string>")).otherwise(text)
