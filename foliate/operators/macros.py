"""Static analysis of macro source: lines, procedures, parameters, calls, references and their summary.

Modules are rows (book, module_ord, module, kind, code). They are dealt by (book, module_ord) while they are still one
row each; all steps that need line order are windows over that partitioning and one sort, so lines are never exchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FoliateError
from ..functions.strings import null_if_empty, trimmed

KEY = ["book", "module_ord"]
MOST_LINES = 5000

# fixed values: words of the language that look like a procedure's name
KEYWORDS = (
    "If Then Else ElseIf End Sub Function Property Dim Set Const Public Private Friend Static For Next While Wend Do "
    "Loop Until Each In Select Case With Exit GoTo GoSub On Error Resume True False Nothing Null Empty And Or Not Xor "
    "Mod Is Like Optional ByVal ByRef ParamArray As Return Stop Rem Type Enum Declare Lib Alias RaiseEvent Me Application"
).split()

# fixed values: patterns of the language, written for Java
_OPEN = r"(?Ui)^\s*(Public|Private|Friend)?\s*(?:Static\s+)?(Sub|Function|Property\s+Get|Property\s+Let|Property\s+Set)\s+(\w+)\s*\("
_CLOSE = r"(?Ui)^\s*End\s+(?:Sub|Function|Property)\s*$"
_RETURN = r"(?Ui)^\s+As\s+(\w+)"
_PARAMETER = r"(?Ui)^(Optional\s+)?(ByVal\s+|ByRef\s+)?(ParamArray\s+)?"
_CALL = r"(?Ui)^\s*(?:Call\s+)?([A-Za-z_]\w*)\s*(?:\(|\.|$)"
_MEMBER = r"(?Ui)^\s*(?:Call\s+)?([A-Za-z_]\w*\.[\p{L}\p{Nd}_]+)"
_RUN = r'(?Ui)Application\s*\.\s*Run\s+"([^"]+)"'
_ASSIGN = r"(?Ui)^\s*[A-Za-z_]\w*\s*="
_API = "Worksheets|Sheets|Range|Cells|ActiveSheet|ActiveWorkbook|ThisWorkbook|Application|Selection|Names"
_API_ANY = rf"(?Ui)\b({_API})\b"
_API_LITERAL = rf'(?Ui)\b({_API})\b\s*\(\s*"([^"]*)"'
_SHELL = r"(?Ui)^\s*Shell\b"
_FILE_OPEN = r"(?Ui)^\s*Open\s+"
_FILE = r"(?Ui)\b(Kill|MkDir|RmDir|ChDir|Dir|FileSystemObject|Workbooks\.Open|Workbooks\.OpenText|Scripting\.FileSystemObject)\b"
_OBJECT = r'(?Ui)(CreateObject|GetObject)\s*\(\s*[^"]*"([^"]+)"'
_DATABASE = r"(?Ui)\b(ADODB\.|DAO\.|OpenDatabase)\b"
_NETWORK = r"(?Ui)\b(MSXML2\.XMLHTTP|WinHttp\.WinHttpRequest|URLDownloadToFile|InternetExplorer\.Application)\b"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """A pattern's group, or null where it does not match or the group is empty."""
    return null_if_empty(F.regexp_extract(text, pattern, group))


def clean_line(raw: Column) -> Column:
    """Strings as "<STR>", comments dropped; of a Rem line only the indentation is left."""
    rem = r"(?Ui)^(\s*)Rem(?:\s.*)?$"
    parts = F.regexp_extract_all(raw, F.lit(r"""(?s)"(?:[^"]|"")*(?:"|$)|'.*$|[^"']+"""), 0)
    kept = F.transform(parts, lambda p: F.when(p.startswith('"'), '"<STR>"').when(p.startswith("'"), "").otherwise(p))
    plain = ~F.contains(raw, F.lit('"')) & ~F.contains(raw, F.lit("'"))
    return F.when(raw.rlike(rem), F.regexp_extract(raw, rem, 1)).when(plain, raw).otherwise(F.array_join(kept, ""))


def continues(raw: Column) -> Column:
    return raw.rlike(r"(?U)\s_\s*$")


def without_continuation(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?U)_\s*$", "")


#: Stands for the line break after a continued line. A noncharacter, which no decoded text holds.
JOINT = "\uffff"


def folded(code: Column) -> Column:
    """The code's logical lines, as an array: lines that a continuation joins, with JOINT between."""
    text = F.replace(code, F.lit("\r\n"), F.lit("\n"))
    return F.split(F.regexp_replace(text, r"(?U)(?<=[\s&&[^\n]])(_[\s&&[^\n]]*)(?:\n|\z)", "$1" + JOINT), "\n")


def joints(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(JOINT), F.lit("")))


def logical_lines(modules: DataFrame) -> DataFrame:
    """book, module_ord, module, kind, idx, line, text, original_text, n_lines, last_line: logical lines, continuations
    joined by a space, with the number of the module's logical lines and where its last one begins."""
    rows = modules.filter("code IS NOT NULL AND code <> ''").select(*KEY, "module", "kind", "code").repartition(*KEY)
    rows = rows.withColumn("_all", folded(F.col("code")))
    last = F.element_at("_all", -1)
    breaks = F.length("code") - F.length(F.replace("code", F.lit("\n"), F.lit("")))
    last_line = (breaks + 1 - joints(last) + last.endswith(JOINT).cast("int")).cast("int")
    # measured before the lines are made rows: after it, each row would carry the whole array
    rows = rows.select(*KEY, "module", "kind", F.size("_all").alias("n_lines"), last_line.alias("last_line"), "_all")
    rows = rows.select(*KEY, "module", "kind", "n_lines", "last_line", F.posexplode("_all").alias("idx", "_line"))

    def text(whole: Column) -> Column:
        cleaned = clean_line(whole)
        return F.concat(F.when(continues(cleaned), without_continuation(cleaned)).otherwise(cleaned), F.lit(" "))

    pieces = F.split("_line", JOINT)
    joined = lambda body, end: F.array_join(F.transform(pieces, lambda p, i: F.when(i < F.size(pieces) - 1, body(p)).otherwise(end(p))), "")
    is_joined = F.contains("_line", F.lit(JOINT))
    before = Window.partitionBy(*KEY).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        *KEY, "module", "kind", "idx", (F.col("idx") + 1 + F.coalesce(F.sum(joints(F.col("_line"))).over(before), F.lit(0))).cast("int").alias("line"),
        F.when(is_joined, joined(text, clean_line)).otherwise(clean_line(F.col("_line"))).alias("text"),
        F.when(is_joined, joined(lambda p: F.concat(without_continuation(p), F.lit(" ")), lambda p: p)).otherwise(F.col("_line")).alias("original_text"),
        "n_lines", "last_line",
    )


def module_lines(modules: DataFrame) -> DataFrame:
    """book, module_ord, module, kind, idx, line, text, original_text of all modules, parsed or not."""
    return logical_lines(modules).drop("n_lines", "last_line")


def module_status(modules: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """book, module_ord, module, kind, parsed, reason, n_lines: empty and over-long modules are not parsed."""
    code = F.coalesce(F.col("code"), F.lit(""))
    rows = modules.select(*KEY, "module", "kind", F.when(code == "", 0).otherwise(F.size(folded(code))).alias("n_lines"))
    reason = F.when(F.col("n_lines") == 0, "empty_source").when(F.col("n_lines") > most, "module_too_large")
    return rows.select(*KEY, "module", "kind", reason.isNull().alias("parsed"), reason.alias("reason"), "n_lines")


def arguments(rest: Column) -> Column:
    """struct(done, at, parts): the text after an opening parenthesis up to its match, cut at commas of its own level.

    Where the first bracket closes, the text before it is cut at once; only the rest is gone through by characters.
    """
    flat = r"^([^()\[\]]*)[)\]]"
    inner = F.regexp_extract(rest, flat, 1)
    at_once = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("done"), (F.length(inner) + 1).alias("at"), F.lit("").alias("cur"), F.split(inner, ",").alias("parts"))
    start = F.struct(F.lit(1).alias("depth"), F.lit(False).alias("done"), F.lit(0).alias("at"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, c: Column) -> Column:
        def state(depth: Column, done: Column, cur: Column, parts: Column) -> Column:
            return F.struct(depth.alias("depth"), done.alias("done"), (acc["at"] + 1).alias("at"), cur.alias("cur"), parts.alias("parts"))

        no, ended = F.lit(False), F.array_append(acc["parts"], acc["cur"])
        return (
            F.when(acc["done"], acc)
            .when(c.isin("(", "["), state(acc["depth"] + 1, no, F.concat(acc["cur"], c), acc["parts"]))
            .when(c.isin(")", "]") & (acc["depth"] == 1), state(F.lit(0), F.lit(True), F.lit(""), ended))
            .when(c.isin(")", "]"), state(acc["depth"] - 1, no, F.concat(acc["cur"], c), acc["parts"]))
            .when((c == ",") & (acc["depth"] == 1), state(acc["depth"], no, F.lit(""), ended))
            .otherwise(state(acc["depth"], no, F.concat(acc["cur"], c), acc["parts"]))
        )

    return F.when(rest.rlike(flat), at_once).otherwise(F.aggregate(F.split(rest, ""), start, step))


def marked(lines: DataFrame) -> DataFrame:
    """Logical lines of parsed modules with `starts` (this line opens a procedure), `is_close`, `head`, `args`, `name`
    and `within`: the procedure whose body the line is in, or null.

    A header opens a procedure only where none is open, and the first end line closes it; so a header counts if the
    last header or end line before it is an end line, or there is none. Headers whose parenthesis does not close on
    the line are passed over. An unclosed procedure runs to the module's end.
    """
    before = Window.partitionBy(*KEY).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("name", found(F.col("text"), _OPEN, 3)).withColumn("is_close", F.col("text").rlike(_CLOSE))
    rows = rows.withColumn("head", F.when(F.col("name").isNotNull(), F.regexp_extract("text", _OPEN, 0)))
    rows = rows.withColumn("args", F.when(F.col("head").isNotNull(), arguments(F.expr("substring(text, length(head) + 1)"))))
    rows = rows.withColumn("_opens", F.coalesce("args.done", F.lit(False)))
    last = F.last(F.when(F.col("_opens"), False).when(F.col("is_close"), True), ignorenulls=True).over(before)
    rows = rows.withColumn("starts", F.col("_opens") & F.coalesce(last, F.lit(True)))
    here = F.struct(F.col("name").alias("proc"), F.concat_ws(".", "module", "name").alias("fqn"), F.col("line").alias("proc_line"))
    none = F.lit(None).cast(rows.select(here.alias("p")).schema["p"].dataType)
    inside = F.last(F.when(F.col("starts"), F.struct(here.alias("p"))).when(F.col("is_close"), F.struct(none.alias("p"))), ignorenulls=True).over(before)
    return rows.withColumn("_inside", inside).withColumn("within", F.when(~F.col("is_close"), F.col("_inside.p"))).drop("_inside", "_opens")


def event_handler() -> Column:
    under = F.instr("name", "_")
    return (F.col("kind") != "standardModule") & (under > 1) & (under < F.length("name"))


def procedures(rows: DataFrame) -> DataFrame:
    """One row a procedure of marked() lines, with its window of body lines (body_start to body_end, by idx). Among
    the lines that start or close procedures, the one after a start is its close."""
    order = Window.partitionBy(*KEY).orderBy("idx")
    ends = rows.filter("starts OR is_close").withColumn("close_idx", F.lead("idx").over(order)).withColumn("close_line", F.lead("line").over(order))
    after, event = F.expr("substring(text, length(head) + args.at + 1)"), event_handler()
    return ends.filter("starts").select(
        *KEY, "module", F.col("kind").alias("module_kind"), "name", F.concat_ws(".", "module", "name").alias("fqn"),
        F.regexp_replace(F.regexp_extract("text", _OPEN, 2), r"(?U)\s+", "").alias("kind"),
        found(F.col("text"), _OPEN, 1).alias("scope"), found(after, _RETURN, 1).alias("return_type"),
        F.col("line").alias("line_start"), F.coalesce("close_line", "last_line").alias("line_end"), event.alias("is_event_handler"),
        F.when(event, F.substring_index("name", "_", 1)).alias("event_target"),
        (F.col("idx") + 1).alias("body_start"), (F.coalesce("close_idx", "n_lines") - 1).alias("body_end"), F.col("args.parts").alias("arguments"),
    )


def top_level_equals(text: Column) -> Column:
    """The place from 1 of the first `=` outside brackets, or 0."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c.isin("(", "["), 1).when(c.isin(")", "]"), -1).otherwise(0)
        here = (c == "=") & (acc["depth"] == 0) & (acc["at"] == 0)
        return F.struct(depth.alias("depth"), (acc["i"] + 1).alias("i"), F.when(here, acc["i"] + 1).otherwise(acc["at"]).alias("at"))

    return F.aggregate(F.split(text, ""), start, step, lambda acc: acc["at"])


def parameters(procs: DataFrame) -> DataFrame:
    """One row a parameter: param_no, name, type, by_ref, optional, default_value."""
    given = F.filter(F.transform("arguments", trimmed), lambda p: p != "")
    rows = procs.select(*KEY, "fqn", "kind", "line_start", F.posexplode(given).alias("param_no", "p"))
    rows = rows.withColumn("mods", F.regexp_extract("p", _PARAMETER, 0)).withColumn("p", F.expr("substring(p, length(mods) + 1)"))
    rows = rows.withColumn("eq", top_level_equals(F.col("p")))
    rows = rows.withColumn("default_value", F.when(F.col("eq") > 0, trimmed(F.expr("substring(p, eq + 1)"))))
    rows = rows.withColumn("p", F.when(F.col("eq") > 0, trimmed(F.expr("substring(p, 1, eq - 1)"))).otherwise(F.col("p")))
    typed = r"(?Uis)^(.*?)\s+As\s+(.*)$"
    has_type = F.col("p").rlike(typed)
    return rows.select(
        *KEY, "fqn", "kind", "line_start", "param_no", trimmed(F.when(has_type, F.regexp_extract("p", typed, 1)).otherwise(F.col("p"))).alias("name"),
        F.when(has_type, trimmed(F.regexp_extract("p", typed, 2))).alias("type"), (~F.contains(F.lower("mods"), F.lit("byval"))).alias("by_ref"),
        F.contains(F.lower("mods"), F.lit("optional")).alias("optional"), "default_value",
    )


def body_lines(rows: DataFrame) -> DataFrame:
    """Lines of marked() that are inside a procedure."""
    return rows.filter("within IS NOT NULL").select(*KEY, "module", "within.proc", "within.fqn", "within.proc_line", "idx", "line", "text", "original_text")


def direct_call(text: Column, proc: Column) -> Column:
    """The bare name that a line calls, or null: no assignment, no word of the language, not the procedure itself."""
    name = found(text, _CALL, 1)
    usable = ~text.rlike(_ASSIGN) & ~F.upper(name).isin([k.upper() for k in KEYWORDS]) & (F.upper(name) != F.upper(proc))
    return F.when(usable, name)


def call_sites(rows: DataFrame) -> DataFrame:
    """rows of marked() with `sites`, the call sites of a line: ord within the line, target, qualified (null for
    run-by-name). Only a line with a quote can run by name, so no other is searched for it."""
    none = F.array().cast("array<struct<ord:int,target:string,qualified:boolean>>")
    site = lambda target, qualified, ord: F.struct(ord.alias("ord"), target.alias("target"), qualified.alias("qualified"))
    # each name is a column first: the array would look for it again at every mention
    rows = rows.withColumn("_name", F.when(F.col("within").isNotNull(), direct_call(F.col("text"), F.col("within.proc"))))
    rows = rows.withColumn("_member", F.when(F.col("_name").isNotNull(), found(F.col("text"), _MEMBER, 1)))
    run = F.transform(F.regexp_extract_all("original_text", F.lit(_RUN), 1), lambda t, i: site(t, F.lit(None).cast("boolean"), i))
    run = F.when(F.col("within").isNotNull() & F.contains("original_text", F.lit('"')), run).otherwise(none)
    direct = F.when(F.col("_name").isNotNull(), F.array(site(F.coalesce("_member", "_name"), F.col("_member").isNotNull(), F.lit(1_000_000)))).otherwise(none)
    return rows.withColumn("sites", F.concat(run, direct)).drop("_name", "_member")


def calls(rows: DataFrame) -> DataFrame:
    """Call sites before resolution, of rows with `sites`: target, qualified, ord."""
    return rows.filter(F.size("sites") > 0).select(*KEY, "module", "within.proc", "within.fqn", "within.proc_line", "line", F.inline("sites"))


def call_edges(rows: DataFrame, procs: DataFrame) -> DataFrame:
    """book, from_id, to_id, resolved, module, proc, line, ord: calls of rows with `sites`, joined to procedures of the
    same book.

    A bare name prefers its own module's first procedure, else the book's first in module and line order; it finds
    one candidate row at most, as both sides are reduced before the join. A qualified name is resolved if it is a
    known full name in any case, and keeps its spelling.
    """
    sites = calls(rows).withColumn("key", F.upper("target"))
    own = procs.groupBy("book", "module_ord", F.upper("name").alias("key")).agg(F.min_by("fqn", "line_start").alias("own_fqn"), F.min("line_start").alias("at"))
    other = own.groupBy("book", "key").agg(F.min_by("own_fqn", F.struct("module_ord", "at")).alias("any_fqn"))
    known = own.select("book", F.upper("own_fqn").alias("key")).distinct().withColumn("is_known", F.lit(True))
    own = own.drop("at")
    rows = sites.join(own, ["book", "module_ord", "key"], "left").join(other, ["book", "key"], "left").join(known, ["book", "key"], "left")
    bare = F.coalesce("own_fqn", "any_fqn")
    return rows.select(
        "book", F.col("fqn").alias("from_id"), F.when(F.col("qualified") == False, F.coalesce(bare, "target")).otherwise(F.col("target")).alias("to_id"),  # noqa: E712
        F.when(F.col("qualified") == False, bare.isNotNull()).when(F.col("qualified"), F.coalesce("is_known", F.lit(False))).otherwise(F.lit(False)).alias("resolved"),  # noqa: E712
        "module_ord", "module", "proc", "proc_line", "line", "ord",
    )


def object_references(body: DataFrame) -> DataFrame:
    """book, module, proc, line, api, literal: object-model words with their literal argument, or none.

    Every word with a literal is also a word, so the bare ones are what the first pass leaves of the second.
    """
    original = F.col("original_text")
    whole = F.regexp_extract_all(original, F.lit(_API_LITERAL), 0)
    literal = F.transform(whole, lambda x: F.struct(F.regexp_extract(x, _API_LITERAL, 1).alias("api"), F.regexp_extract(x, _API_LITERAL, 2).alias("literal")))
    rows = body.select(*KEY, "module", "proc", "line", literal.alias("with_literal"), F.regexp_extract_all(original, F.lit(_API_ANY), 1).alias("words"))
    given = rows.select(*KEY, "module", "proc", "line", F.inline("with_literal"))
    names = F.array_distinct("words")
    left = lambda a: F.size(F.filter("words", lambda w: w == a)) - F.size(F.filter("with_literal", lambda x: x["api"] == a))
    bare = rows.select(*KEY, "module", "proc", "line", F.explode(F.transform(names, lambda a: F.struct(a.alias("api"), left(a).alias("n")))).alias("x"))
    bare = bare.select(*KEY, "module", "proc", "line", "x.api", F.explode(F.array_repeat(F.lit(None).cast("string"), F.col("x.n"))).alias("literal"))
    return given.unionByName(bare)


def program_kind(prog_id: Column) -> Column:
    low = F.lower(prog_id)
    return (
        F.when(low.startswith("adodb.") | low.startswith("dao."), "database")
        .when(low.startswith("msxml2.") | low.startswith("winhttp.") | (low == "internetexplorer.application"), "network")
        .when(F.contains(low, F.lit("filesystemobject")), "file")
        .otherwise("automation")
    )


def dependency(text: Column, original: Column) -> Column:
    """struct(dependency, target, operation) of the first rule that a line matches, or null."""
    none = F.lit(None).cast("string")
    made, target = found(original, _OBJECT, 1), found(original, _OBJECT, 2)

    def row(kind: Column | str, target: Column = none, operation: Column = none) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("dependency"), target.alias("target"), operation.alias("operation"))

    label = F.when(F.lower(made) == "getobject", "GetObject").otherwise("CreateObject")
    return (
        F.when(text.rlike(_SHELL), row("shell", operation=F.lit("Shell")))
        .when(text.rlike(_FILE_OPEN), row("file", operation=F.lit("Open")))
        .when(text.rlike(_FILE), row("file", operation=F.regexp_extract(text, _FILE, 1)))
        .when(target.isNotNull(), row(program_kind(target), target, label))
        .when(text.rlike(_DATABASE), row("database"))
        .when(text.rlike(_NETWORK), row("network"))
    )


def dependencies(body: DataFrame) -> DataFrame:
    """book, module, proc, line, dependency, target, operation: at most one a line, the first rule that matches."""
    rule = dependency(F.col("text"), F.col("original_text"))
    return body.select(*KEY, "module", "proc", "line", rule.alias("d")).filter("d IS NOT NULL").select(*KEY, "module", "proc", "line", "d.*")


def summary(status: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a book: eight counts, 0 where a book has none.

    All but the modules are counted in one pass over marked() lines: a call site is an edge, and each object-model
    word is a reference, whether it has a literal or not.
    """
    count = lambda what, name: F.coalesce(F.sum(what), F.lit(0)).cast("long").alias(name)
    inside = F.col("within").isNotNull()
    sites = F.size(F.regexp_extract_all("original_text", F.lit(_RUN), 1)) + direct_call(F.col("text"), F.col("within.proc")).isNotNull().cast("int")
    counts = rows.groupBy("book").agg(
        count(F.col("starts").cast("int"), "procedures"), count((F.col("starts") & event_handler()).cast("int"), "event_handlers"), count(F.when(inside, sites), "call_edges"),
        count(F.when(inside, F.size(F.regexp_extract_all("original_text", F.lit(_API_ANY), 1))), "object_references"),
        count((inside & dependency(F.col("text"), F.col("original_text")).isNotNull()).cast("int"), "dependencies"),
    )
    out = status.groupBy("book").agg(F.count(F.lit(1)).alias("modules"), F.count_if("parsed").alias("parsed_modules"), F.count_if(~F.col("parsed")).alias("unparsed_modules"))
    return out.join(counts, "book", "left").na.fill(0)


def module_kind(entries: DataFrame, forms: DataFrame, codenames: DataFrame | None = None) -> DataFrame:
    """entries (book, module, type) with kind: by type, then a form of that name, then the workbook's code names."""
    same = lambda df, name: df.select("book", F.upper("name").alias("_key")).distinct().withColumn(name, F.lit(True))
    rows = entries.withColumn("_key", F.upper("module")).join(same(forms, "_form"), ["book", "_key"], "left")
    if codenames is not None:
        rows = rows.join(same(codenames, "_document"), ["book", "_key"], "left")
        document = F.coalesce("_document", F.lit(False))
    else:
        document = (F.col("module") == "ThisWorkbook") | F.col("module").startswith("Sheet")
    kind = F.when(F.col("type") == 0x21, "standardModule").when(F.coalesce("_form", F.lit(False)), "userForm").when(document, "documentModule").otherwise("classModule")
    return rows.select("book", "module", "type", kind.alias("kind"))


def only_module(rows: DataFrame, modules: DataFrame, name: str | None, column: str = "module") -> DataFrame:
    """Rows of the module of that name in any case, in each book; a blank name leaves all, one that a book lacks is an
    error."""
    if name is None or not name.strip():
        return rows
    own = modules.filter(F.upper("module") == name.upper()).groupBy("book").agg(F.min_by("module", "module_ord").alias("_own"))
    lacking = modules.select("book").distinct().join(own, "book", "left_anti").orderBy("book").first()
    if lacking is not None:
        some = ", ".join(r[0] for r in modules.filter(F.col("book") == lacking.book).select("module").distinct().orderBy("module").limit(50).collect())
        raise FoliateError("module_not_found", f"no module {name} in {lacking.book}; there are: {some}")
    return rows.join(own, "book").filter(F.col(column) == F.col("_own")).drop("_own")


def of_books_with(modules: DataFrame, name: str, most: int = 1000) -> DataFrame:
    """All modules of those books that have a module of that name in any case. No call leads out of a book, so a view
    of one module asks for no others. Up to `most` books are named to the scan; more are joined."""
    own = modules.filter(F.upper("module") == name.upper()).select("book").distinct()
    books = [r[0] for r in own.limit(most + 1).collect()]
    return modules.filter(F.col("book").isin(books)) if len(books) <= most else modules.join(own, "book", "left_semi")


def touching_module(edges: DataFrame, module: str) -> DataFrame:
    """Edges from the module, and resolved ones into it."""
    return edges.filter((F.col("module") == module) | (F.col("resolved") & F.col("to_id").startswith(module + ".")))


def analyze(modules: DataFrame, most: int = MOST_LINES) -> dict[str, DataFrame]:
    """All results as lazy DataFrames; Spark computes only those that are read."""
    lines = logical_lines(modules)
    rows = marked(lines.filter(F.col("n_lines") <= most))
    procs, body, status = procedures(rows), body_lines(rows), module_status(modules, most)
    return {
        "lines": lines.drop("n_lines", "last_line"), "status": status, "procedures": procs, "parameters": parameters(procs), "edges": call_edges(call_sites(rows), procs),
        "references": object_references(body), "dependencies": dependencies(body), "summary": summary(status, rows),
    }


def graph_tables(modules: DataFrame, keep: Callable[[DataFrame, str], DataFrame], most: int | None = None) -> dict[str, DataFrame]:
    """`procedures` (what a graph needs of them) and `edges`, as analyze() gives them, from one pass over the lines:
    `keep` writes those that start a procedure or call, without their texts, and both read that table. Modules of any
    length are in the graph, unless `most` lines are named."""
    lines = logical_lines(modules)
    rows = call_sites(marked(lines if most is None else lines.filter(F.col("n_lines") <= most)))
    rows = keep(rows.filter(F.col("starts") | (F.size("sites") > 0)).select(*KEY, "module", "kind", "name", "line", "starts", "within", "sites"), "calls")
    procs = rows.filter("starts").select(*KEY, "module", "name", F.concat_ws(".", "module", "name").alias("fqn"), F.col("line").alias("line_start"), event_handler().alias("is_event_handler"))
    return {"procedures": procs, "edges": call_edges(rows, procs)}
