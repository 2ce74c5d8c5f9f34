"""Derived views of the graph: flat, module, service, API, data, flow trace, and the dashboard's filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.functions.shared import materialized

from .graph import REFERENCE_KINDS, STRUCTURE_KINDS
from .traverse import distances


def flat(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between non-project nodes, without loops."""
    inner = nodes.where(F.col("kind") != "project").select("id")
    e = edges.where(F.col("src") != F.col("dst")).select("src", "dst", "kind").distinct()
    return e.join(inner.select(F.col("id").alias("src")), "src", "left_semi").join(inner.select(F.col("id").alias("dst")), "dst", "left_semi")


def module(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_file, to_file): distinct pairs of files with a reference from one to the other."""
    at = nodes.select("id", "file_path")
    e = edges.where(F.col("kind").isin(REFERENCE_KINDS)).select("src", "dst").distinct()
    both = e.join(at.select(F.col("id").alias("src"), F.col("file_path").alias("from_file")), "src").join(at.select(F.col("id").alias("dst"), F.col("file_path").alias("to_file")), "dst")
    return both.where("from_file <> to_file").select("from_file", "to_file").distinct()


def owners(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, root): for each contained node its nearest container among `roots` (id); ties to the lesser one."""
    found = distances(edges, roots.select(F.col("id").alias("root"), "id"), depth, "outgoing", STRUCTURE_KINDS)
    return found.groupBy("id").agg(F.min_by("root", F.struct("depth", "root")).alias("root"))


def service(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(from_service, to_service): references between contents of services, rolled up and distinct."""
    up = materialized(owners(edges, roots, depth), "owners")
    refs = edges.where(F.col("kind").isin(REFERENCE_KINDS)).select("src", "dst").distinct()
    both = refs.join(up.select(F.col("id").alias("src"), F.col("root").alias("from_service")), "src").join(up.select(F.col("id").alias("dst"), F.col("root").alias("to_service")), "dst")
    return both.where("from_service <> to_service").select("from_service", "to_service").distinct()


def api(handlers: DataFrame) -> DataFrame:
    """(endpoint, handler): virtual nodes for handlers (id, api_method, api_path)."""
    return handlers.where("api_method is not null").select(F.concat_ws(":", F.lit("api"), F.upper("api_method"), "api_path").alias("endpoint"), F.col("id").alias("handler")).distinct()


def data(edges: DataFrame, models: DataFrame, services: DataFrame) -> DataFrame:
    """(user, model): who refers to a data model: the direct parent of the source if that is a service, else the source."""
    refs = edges.where(F.col("kind").isin(REFERENCE_KINDS)).join(models.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    parent = edges.where(F.col("kind").isin(STRUCTURE_KINDS)).join(services.select(F.col("id").alias("src")), "src", "left_semi")
    parent = parent.groupBy(F.col("dst").alias("src")).agg(F.min("src").alias("service"))
    return refs.join(parent, "src", "left").select(F.coalesce("service", "src").alias("user"), F.col("dst").alias("model")).distinct()


def flow_trace(edges: DataFrame, start: str, depth: int = 4, roll_up: DataFrame | None = None) -> DataFrame:
    """(level, from_id, to_id): references level by level from a node and all it contains; `roll_up` (id, root) merges members.

    Levels may come to a node again; a level that adds no edge ends the trace.
    """
    spark = edges.sparkSession
    up = roll_up if roll_up is not None else spark.createDataFrame([], "id string, root string")
    refs = edges.where(F.col("kind").isin(REFERENCE_KINDS)).select("src", "dst").distinct()
    refs = refs.join(up.select(F.col("id").alias("dst"), F.col("root").alias("to_root")), "dst", "left").select("src", "dst", F.coalesce("to_root", "dst").alias("to_id"))
    refs = materialized(refs, "refs")
    holds = edges.where(F.col("kind").isin(STRUCTURE_KINDS))
    root = spark.createDataFrame([(start, start)], "root string, id string")
    at = distances(holds, root, None, "outgoing").select("id", F.lit(start).alias("from_id"))
    out = None
    for level in range(1, depth + 1):
        step = materialized(at.join(refs, F.col("id") == F.col("src")).select(F.lit(level).cast("long").alias("level"), "from_id", "to_id").where("from_id <> to_id").distinct(), f"trace{level}")
        out = step if out is None else out.unionByName(step)
        if level == depth or step.isEmpty():
            break
        reached = step.select("to_id").distinct()
        inside = up.join(reached.select(F.col("to_id").alias("root")), "root", "left_semi").select("id", F.col("root").alias("from_id"))
        at = reached.select(F.col("to_id").alias("id"), F.col("to_id").alias("from_id")).unionByName(inside).distinct()
    return out


def filtered(nodes: DataFrame, edges: DataFrame, search: str | None = None, kinds: list[str] | None = None, near: str | None = None) -> DataFrame:
    """Visible nodes: by substring, kinds, or closeness to one node; a container shows if something in it does."""
    out = nodes
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if search:
        out = out.where(F.lower("name").contains(search.lower()) | F.lower("file_path").contains(search.lower()))
    if near:
        ends = edges.where((F.col("src") == near) | (F.col("dst") == near)).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        out = out.join(ends, "id", "left_semi")
    shown = materialized(out.select("id"), "shown")
    holds = distances(edges, shown.select(F.col("id").alias("root"), "id"), None, "incoming", STRUCTURE_KINDS).select("id").distinct()
    return nodes.join(shown.unionByName(holds).distinct(), "id", "left_semi")


def inspector(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(direction, kind, id, name): references that a node makes and gets."""
    refs = edges.where(F.col("kind").isin(REFERENCE_KINDS))
    made = refs.where(F.col("src") == node).select(F.lit("made").alias("direction"), "kind", F.col("dst").alias("id"))
    got = refs.where(F.col("dst") == node).select(F.lit("received").alias("direction"), "kind", F.col("src").alias("id"))
    return made.unionByName(got).distinct().join(nodes.select("id", "name"), "id").select("direction", "kind", "id", "name")


def kind_counts(nodes: DataFrame, by: list[Column] | None = None) -> DataFrame:
    return nodes.groupBy(*(by or [F.col("kind")])).agg(F.count("*").alias("n"))
