"""Reading a property graph of `nodes` (id, kind, name, file_path, ...) and `edges` (src, dst, kind, method, ...).

All operators are plans over the two tables: kinds and ids reach the scans as filters, and duplicates of edges are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions.text import is_test_file

REFERENCE_KINDS = ["call", "import", "inherit", "implement", "type_use", "instantiate", "renders"]
STRUCTURE_KINDS = ["owns", "declares", "has_member"]


def build(symbols: DataFrame, containments: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a model: containments first, then references; a later symbol of an id wins."""
    nodes = last_wins(symbols, "id", F.col("seq")) if "seq" in symbols.columns else symbols
    a = containments.select(F.col("parent_id").alias("src"), F.col("child_id").alias("dst"), "kind", F.lit(None).cast("string").alias("method"))
    b = resolved.select(F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst"), "kind", F.col("resolution_method").alias("method"))
    return nodes, a.unionByName(b)


def last_wins(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row of each key, the greatest by `order`: a pre-aggregated maximum, joined to nothing."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("row")).select("row.*")


def edges_from(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    found = edges.where(F.col("src") == node)
    return found.where(F.col("kind") == kind) if kind else found


def edges_to(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    found = edges.where(F.col("dst") == node)
    return found.where(F.col("kind") == kind) if kind else found


def neighbours(nodes: DataFrame, edges: DataFrame, node: str, kind: str, incoming: bool) -> DataFrame:
    """One row per edge of the kind, duplicates kept; ends that are no node drop out."""
    ends = edges_to(edges, node, kind).select(F.col("src").alias("id")) if incoming else edges_from(edges, node, kind).select(F.col("dst").alias("id"))
    return ends.join(nodes, "id")


def callers_of(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    return neighbours(nodes, edges, node, "call", incoming=True)


def callees_of(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    return neighbours(nodes, edges, node, "call", incoming=False)


def members_of(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    return neighbours(nodes, edges, node, "has_member", incoming=False)


def imports_of(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    return neighbours(nodes, edges, node, "import", incoming=False)


def find_by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name)


def find_by_qualified_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("qualified_name") == name)


def get_node(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.where(F.col("id") == node)


def parent_chain(edges: DataFrame, start: str, kind: str = "inherit", most: int = 100) -> DataFrame:
    """(depth, id): the first parent, its first parent, and so on, until there is none or one comes again.

    The first is that of least `seq`, or of least id where edges have no order.
    """
    spark = edges.sparkSession
    order = F.col("seq") if "seq" in edges.columns else F.col("dst")
    first = edges.where(F.col("kind") == kind).groupBy("src").agg(F.min_by("dst", F.struct(order, "dst")).alias("dst"))
    seen, at, out = {start}, start, []
    while len(out) < most:  # a chain is a few steps; each is a point lookup
        row = first.where(F.col("src") == at).select("dst").first()
        if row is None or row.dst in seen:
            break
        seen.add(at := row.dst)
        out.append((len(out) + 1, at))
    return spark.createDataFrame(out, "depth long, id string")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): numbers of nodes, of edges and of edges of each kind."""
    n = nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n")
    by = edges.groupBy("kind").agg(F.count("*").alias("n"))
    total = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("edges").alias("what"), "n")
    return n.unionByName(total).unionByName(by.select(F.concat(F.lit("edges:"), "kind").alias("what"), "n"))


def test_covered(nodes: DataFrame, edges: DataFrame, is_test: Column | None = None) -> DataFrame:
    """(id): targets of a reference from a symbol in a test file (`is_test`, over nodes)."""
    tests = nodes.where(is_test_file(F.col("file_path")) if is_test is None else is_test).select(F.col("id").alias("src"))
    return edges.where(F.col("kind").isin(REFERENCE_KINDS)).join(tests, "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def unresolved_by_symbol(references: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """References (src, name) whose `key` is no target's: how many by source."""
    return references.join(targets.select(key).distinct(), key, "left_anti").groupBy("src").agg(F.count("*").alias("n"))


def unresolved_references(unresolved: DataFrame, most: int = 5, width: int = 40) -> DataFrame:
    """(id, n, names): for each symbol how many of its references are unbound, and the first few of their names.

    Names are distinct, in order, and cut to `width` characters.
    """
    name = F.when(F.length("raw_name") > width, F.concat(F.substring("raw_name", 1, width - 1), F.lit("…"))).otherwise(F.col("raw_name"))
    shown = unresolved.select(F.col("from_symbol_id").alias("id"), name.alias("name"))
    names = F.array_sort(F.collect_set("name"))
    return shown.groupBy("id").agg(F.count("*").alias("n"), F.slice(names, 1, most).alias("names"))


def reverse_map(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """(dst, n, sources): for each target its distinct sources in order."""
    return edges.where(F.col("kind").isin(kinds)).groupBy("dst").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("src")).alias("sources"))


def replace_file(old: DataFrame, new: DataFrame | None, path: str, column: str = "file_path") -> DataFrame:
    """Rows of one file replaced by `new` ones, or removed."""
    kept = old.where(F.col(column) != path)
    return kept if new is None else kept.unionByName(new)


def innermost(ranges: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Each point (key, at, point) with the smallest range (key, lo, hi, range) that holds it, both ends included.

    Ties go to the lesser range. A range join inside an equi-join on `key`, then a pre-aggregated minimum.
    """
    inside = points.join(ranges, key).where((F.col("at") >= F.col("lo")) & (F.col("at") <= F.col("hi")))
    size = F.col("hi") - F.col("lo")
    return inside.groupBy("point").agg(F.min(F.struct(size.alias("size"), F.col("range"))).alias("m")).select("point", F.col("m.range").alias("range"), F.col("m.size").alias("size"))


def running_total(df: DataFrame, parts: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
