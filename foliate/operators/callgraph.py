"""Views of a call graph: whole, one module with its neighbours, or hops from one procedure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FoliateError

EXTERNAL = "__ext__"


def graph_nodes(procs: DataFrame) -> DataFrame:
    """book, id, label, module, is_event_handler, place: one node a full name, the last procedure's where several share
    it; place is that of the first."""
    last = F.max_by(F.struct(F.col("name").alias("label"), "module", "is_event_handler"), F.struct("module_ord", "line_start"))
    return procs.groupBy("book", F.col("fqn").alias("id")).agg(last.alias("n"), F.min(F.struct("module_ord", "line_start")).alias("place")).select("book", "id", "n.*", "place")


def known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (book, from_id, to_id) between nodes; names are compared as they are spelled."""
    ids = nodes.select("book", "id")
    out = edges.select("book", "from_id", "to_id").distinct().join(ids.withColumnRenamed("id", "from_id"), ["book", "from_id"], "left_semi")
    return out.join(ids.withColumnRenamed("id", "to_id"), ["book", "to_id"], "left_semi")


def module_view(nodes: DataFrame, edges: DataFrame, module: str) -> DataFrame:
    """Ids of the module's procedures and of their direct callers and callees."""
    own = nodes.filter(F.upper("module") == module.upper()).select("book", "id")
    links = known_edges(nodes, edges)
    out = links.join(own.withColumnRenamed("id", "from_id"), ["book", "from_id"], "left_semi").select("book", F.col("to_id").alias("id"))
    into = links.join(own.withColumnRenamed("id", "to_id"), ["book", "to_id"], "left_semi").select("book", F.col("from_id").alias("id"))
    return own.union(out).union(into).distinct()


def hops_from(nodes: DataFrame, edges: DataFrame, module: str, procedure: str, depth: int = 2, direction: str = "both") -> DataFrame:
    """Ids within `depth` calls of the first procedure of that name (any case), along callees, callers or both.

    Each hop joins the frontier, not all visited nodes, to the edges, and drops what was visited. A checkpoint cuts
    the plan of every hop where the session has a checkpoint folder.
    """
    if direction not in ("callees", "callers", "both"):
        raise FoliateError("invalid_render_option", f"direction is callees, callers or both, not {direction}")
    named = nodes.filter((F.upper("module") == module.upper()) & (F.upper("label") == procedure.upper()))
    frontier = named.groupBy("book").agg(F.min_by("id", "place").alias("id"))
    if frontier.isEmpty():
        raise FoliateError("procedure_not_found", f"no procedure {procedure} in {module}")
    links = known_edges(nodes, edges)
    arcs = links.select("book", F.col("from_id").alias("id"), F.col("to_id").alias("next"))
    back = links.select("book", F.col("to_id").alias("id"), F.col("from_id").alias("next"))
    steps = arcs if direction == "callees" else back if direction == "callers" else arcs.union(back)
    keep = nodes.sparkSession.sparkContext.getCheckpointDir() is not None
    visited = frontier
    for _ in range(max(0, depth)):
        frontier = frontier.join(steps, ["book", "id"]).select("book", F.col("next").alias("id")).distinct().join(visited, ["book", "id"], "left_anti")
        if keep:
            frontier = frontier.checkpoint()
            if frontier.isEmpty():
                break
        visited = visited.union(frontier)
    return visited


def subgraph(ids: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the surviving ids.

    An edge stays if both ends survive; an unresolved one from a survivor leads to an external node, one for each
    name; a resolved one to a node that does not survive goes. A node that handles no event and has no edge in this
    view is an orphan.
    """
    alive = nodes.join(ids, ["book", "id"], "left_semi").select("book", "id", "label", "module", "is_event_handler")
    ends = alive.select("book", F.col("id").alias("to_id"), F.lit(True).alias("_in"))
    out = edges.join(alive.select("book", F.col("id").alias("from_id")), ["book", "from_id"], "left_semi").join(ends, ["book", "to_id"], "left")
    out = out.filter("_in OR NOT resolved")
    outside = F.col("_in").isNull()
    kept = out.select("book", "from_id", F.when(outside, F.concat(F.lit(EXTERNAL), "to_id")).otherwise(F.col("to_id")).alias("to_id"), F.when(outside, False).otherwise(F.col("resolved")).alias("resolved"), "module_ord", "proc_line", "line", "ord")
    externals = out.filter(outside).select("book", F.concat(F.lit(EXTERNAL), "to_id").alias("id"), F.col("to_id").alias("label"), F.lit(None).cast("string").alias("module"), F.lit(False).alias("is_event_handler"), F.lit(True).alias("is_external")).distinct()
    degree = kept.select("book", F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("book", "id").agg(F.count(F.lit(1)).alias("degree"))
    everything = alive.withColumn("is_external", F.lit(False)).unionByName(externals).join(degree, ["book", "id"], "left")
    orphan = ~F.col("is_external") & ~F.col("is_event_handler") & F.col("degree").isNull()
    return everything.select("book", "id", "label", "module", "is_event_handler", orphan.alias("is_orphan"), "is_external", F.coalesce("degree", F.lit(0)).alias("degree")), kept


def at_most(nodes: DataFrame, most: int = 300) -> DataFrame:
    """nodes, or an error if any book's view has more than `most`."""
    over = nodes.groupBy("book").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).orderBy("book").first()
    if over is not None:
        raise FoliateError("graph_too_large", f"the view of {over.book} has {over.n} nodes; at most {most} are drawn")
    return nodes


def view(analysis: dict[str, DataFrame], module: str | None = None, procedure: str | None = None, depth: int = 2, direction: str = "both", most: int = 300) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) to draw: all, a module with its neighbours, or hops from a procedure. Options are looked at before
    anything is read, and the view's size before it is given back."""
    given = lambda x: bool(x and x.strip())
    if given(procedure) and not given(module):
        raise FoliateError("invalid_render_option", "a procedure needs its module")
    if given(procedure) and direction not in ("callees", "callers", "both"):
        raise FoliateError("invalid_render_option", f"direction is callees, callers or both, not {direction}")
    nodes, edges = graph_nodes(analysis["procedures"]), analysis["edges"]
    if given(module) and analysis["status"].filter(F.upper("module") == module.upper()).isEmpty():
        raise FoliateError("module_not_found", f"no module {module}")
    if given(procedure):
        ids = hops_from(nodes, edges, module, procedure, depth, direction)
    else:
        ids = module_view(nodes, edges, module) if given(module) else nodes.select("book", "id")
    alive, kept = subgraph(ids, nodes, edges)
    return at_most(alive, most), kept
