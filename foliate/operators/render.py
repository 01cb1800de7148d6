"""Call graphs as Mermaid and DOT text, one row a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FoliateError
from ..functions.strings import dot_string, mangled, mermaid_label
from . import callgraph

# fixed values: what the two formats begin and end with
HEAD = {"mermaid": ["flowchart TD"], "dot": ["digraph G {", "  rankdir=TB;", "  node [shape=box];"]}
TAIL = {
    "mermaid": ["  classDef handler fill:#e1f5ff,stroke:#0277bd", "  classDef orphan stroke-dasharray:5 5", "  classDef external fill:#f5f5f5,stroke-dasharray:3 3"],
    "dot": ["}"],
}


def _node(format: str, full_label: bool) -> Column:
    text = F.when(F.col("is_external") | F.lit(not full_label), F.col("label")).otherwise(F.col("id"))
    if format == "mermaid":
        label, id_ = mermaid_label(text), mangled(F.col("id"))
        shape = F.when(F.col("is_event_handler"), F.concat(id_, F.lit("(["), label, F.lit("])"))).otherwise(F.concat(id_, F.lit("["), label, F.lit("]")))
        mark = F.when(F.col("is_external"), ":::external").when(F.col("is_event_handler"), ":::handler").when(F.col("is_orphan"), ":::orphan").otherwise("")
        return F.concat(shape, mark)
    style = (
        F.when(F.col("is_external"), ', shape=box, style="dashed,filled", fillcolor="#f5f5f5"')
        .when(F.col("is_event_handler"), ', shape=oval, style="filled", fillcolor="#e1f5ff"')
        .when(F.col("is_orphan"), ', style="dashed"')
        .otherwise("")
    )
    return F.concat(dot_string(F.col("id")), F.lit(" [label="), dot_string(text), style, F.lit("];"))


def checked(format: str, layout: str) -> None:
    if format not in HEAD:
        raise FoliateError("invalid_render_option", f"format is mermaid or dot, not {format}")
    if layout not in ("clustered", "flat"):
        raise FoliateError("invalid_render_option", f"layout is clustered or flat, not {layout}")


def render_view(analysis: dict[str, DataFrame], format: str = "mermaid", layout: str = "clustered", **view: object) -> DataFrame:
    """book, rendered of a view of an analysis (see callgraph.view(), which also keeps the limit on nodes). Format, then
    layout, then the view's options are checked before anything is read."""
    checked(format, layout)
    return render(*callgraph.view(analysis, **view), format, layout)


def render(nodes: DataFrame, edges: DataFrame, format: str = "mermaid", layout: str = "clustered") -> DataFrame:
    """book, rendered: lines by (section, place), joined in order. Modules come by name, externals after them."""
    checked(format, layout)
    clustered = layout == "clustered"
    row = lambda section, group, place, text: F.struct(F.lit(section).alias("s"), group.alias("g"), F.lit(place).alias("p") if isinstance(place, int) else place.alias("p"), text.alias("t"))
    none = F.lit("")
    name = mangled if format == "mermaid" else dot_string
    group = F.when(F.col("is_external") | F.lit(not clustered), "").otherwise(F.coalesce("module", F.lit("")))
    section = F.when(F.col("is_external"), 2).otherwise(1)
    indent = F.when(F.col("is_external") | F.lit(not clustered), "  ").otherwise("    ")
    lines = nodes.select("book", F.struct(section.alias("s"), group.alias("g"), F.concat(F.lit("1"), "id").alias("p"), F.concat(indent, _node(format, not clustered)).alias("t")).alias("l"))
    if clustered:
        begin = F.concat(F.lit("  subgraph "), mangled(F.col("module"))) if format == "mermaid" else F.concat(F.lit("  subgraph cluster_"), mangled(F.col("module")), F.lit(" {\n    label="), dot_string(F.col("module")), F.lit(";"))
        modules = nodes.filter(~F.col("is_external")).select("book", "module").distinct()
        both = F.array(row(1, F.col("module"), F.lit("0"), begin), row(1, F.col("module"), F.lit("2"), F.lit("  end" if format == "mermaid" else "  }")))
        lines = lines.unionByName(modules.select("book", F.explode(both).alias("l")))
    arrow = F.when(F.col("resolved"), " --> ").otherwise(" -.-> ") if format == "mermaid" else F.lit(" -> ")
    end = none if format == "mermaid" else F.when(F.col("resolved"), ";").otherwise(' [style="dashed"];')
    place = F.concat_ws(".", F.lpad("module_ord", 9, "0"), F.lpad("proc_line", 9, "0"), F.lpad("line", 9, "0"), F.lpad("ord", 9, "0"))
    lines = lines.unionByName(edges.select("book", row(3, none, place, F.concat(F.lit("  "), name(F.col("from_id")), arrow, name(F.col("to_id")), end)).alias("l")))
    body = lines.groupBy("book").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["t"]), "\n").alias("body"))
    return body.select("book", F.concat(F.lit("\n".join(HEAD[format]) + "\n"), "body", F.lit("\n" + "\n".join(TAIL[format]) + "\n")).alias("rendered"))
