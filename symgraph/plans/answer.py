"""Answering: bind a plan's anchors, run its operation, gather evidence, and write what fits the budget.

Traversal and evidence are Spark jobs; what comes to the driver is one result, of 200 nodes and 120 edges at most.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.text import strategy
from symgraph.operators import evidence as E
from symgraph.operators import graph as G
from symgraph.operators import search as S
from symgraph.operators import traverse as V
from symgraph.operators.model import Model

from .plan import QueryPlan, problems

HARD_CAP, RELATIONS = 40_000, 60
# How edges read.
VERBS = {"call": "calls", "import": "imports", "inherit": "inherits", "implement": "implements", "type_use": "uses type", "instantiate": "creates", "renders": "renders", "owns": "owns", "has_member": "has member", "declares": "declares"}


@dataclass
class Answer:
    status: str
    text: str = ""
    anchors: list[str] = field(default_factory=list)
    candidates: list[dict[str, Any]] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    usage: dict[str, int] = field(default_factory=dict)


@dataclass
class Project:
    """A stored or freshly built graph with what answers need of it: `nodes`, `edges`, and `files` (file_path, source)."""

    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    unresolved: DataFrame | None = None

    @classmethod
    def of(cls, model: Model, sources: DataFrame) -> Project:
        nodes, edges = G.build(model.symbols, model.containments, model.resolved)
        return cls(sources.sparkSession, nodes, edges, sources.select("file_path", "source"), model.unresolved)

    def lines(self) -> DataFrame:
        return E.source_lines(self.files)


def bind(project: Project, plan: QueryPlan) -> tuple[str, list[str], list[str]]:
    """(status, anchors, unmatched terms)"""
    if plan.free_form:
        ids, missing = S.free_form(project.nodes, plan.free_form)
        return ("resolved" if ids else "not_found"), ids, missing
    if plan.tolerate_missing:
        ids, missing = S.resolve_all(project.nodes, list(plan.anchors))
        return ("resolved" if ids else "not_found"), ids, missing
    got: list[str] = []
    for spec in plan.anchors:
        status, ids = S.resolve_anchor(project.nodes, spec)
        if status == "not_found" or (status == "ambiguous" and not plan.auto_pick):
            return status, ids, [spec]
        got += [i for i in ids[:1] if i not in got]
    return "resolved", got, []


def structure(project: Project, plan: QueryPlan, anchors: list[str]) -> tuple[pd.DataFrame, pd.DataFrame, dict[str, Any]]:
    """Nodes (id, distance, via) and edges (src, dst, kind) of the plan's operation, capped, and notes."""
    spark, kinds = project.spark, list(plan.edge_kinds) or None
    roots = spark.createDataFrame([("q", a, i) for i, a in enumerate(anchors)], "root string, id string, place int")
    limits = V.Limits(plan.depth or V.DEPTH, plan.nodes)
    notes: dict[str, Any] = {}
    if plan.operation == "path":
        pairs = spark.createDataFrame([(anchors[0], anchors[-1])], "source string, target string")
        depth = min(plan.depth or V.DEPTH, V.MOST_DEPTH)
        found = V.shortest_paths(project.edges, pairs, depth, kinds, most=plan.paths or V.PATHS).collect()
        notes["paths"] = [(r.nodes, r.kinds) for r in found]
        ids = {n: min(i for r in found for i, x in enumerate(r.nodes) if x == n) for r in found for n in r.nodes} or {a: 0 for a in anchors}
        edges = sorted({(a, b, k) for r in found for a, b, k in zip(r.nodes, r.nodes[1:], r.kinds, strict=False)})
        return pd.DataFrame([(n, d, None) for n, d in ids.items()], columns=["id", "distance", "via"]), pd.DataFrame(edges, columns=["src", "dst", "kind"]), notes
    if plan.operation == "impact":
        cap = min(plan.nodes or V.NODES, V.MOST_NODES)
        cone = V.impact(project.edges, roots.select("root", "id"), limits.bounded().depth, kinds)
        rows = cone.orderBy("depth", "id").limit(cap).select("id", F.col("depth").alias("distance"), "via").toPandas()
        nodes = pd.concat([pd.DataFrame([(a, 0, None) for a in anchors], columns=["id", "distance", "via"]), rows], ignore_index=True)
        known = spark.createDataFrame(nodes[["id"]])
        edges = V.of_kinds(project.edges, kinds or G.REFERENCE_KINDS).join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return nodes, edges.select("src", "dst", "kind").distinct().orderBy("src", "dst", "kind").limit(V.EDGES).toPandas(), notes
    found, kept, omitted = V.region(project.nodes, project.edges, roots, limits, plan.direction, kinds)
    notes["omitted_edges"] = sum(r.omitted for r in omitted.collect())
    nodes = found.orderBy("distance", "place", "id").select("id", "distance").toPandas().assign(via=None)
    return nodes, kept.orderBy("prio", "src", "dst", "kind").select("src", "dst", "kind").toPandas(), notes


def evidence(project: Project, plan: QueryPlan, found: pd.DataFrame, links: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Nodes with role, place, signature, source and comment; edges with method and call site."""
    spark = project.spark
    ids = spark.createDataFrame(found[["id", "distance"]], "id string, distance long")
    at = project.nodes.select("id", "kind", "name", "qualified_name", "file_path", F.col("start_line").alias("lo"), F.col("end_line").alias("hi")).join(F.broadcast(ids), "id")
    at = at.withColumn("role", E.role(plan.operation, F.col("distance")))
    ranges = at.where("kind <> 'file'").select("id", "file_path", "lo", "hi")
    slices = E.sliced(project.lines(), ranges).select("id", F.col("text").alias("source"), "signature")
    docs = E.doc_comments(ranges, project.files)
    tested = G.test_covered(project.nodes, project.edges).withColumn("tested", F.lit(True))
    nodes = at.join(slices, "id", "left").join(docs, "id", "left").join(tested, "id", "left").withColumn("tested", E.covered(F.col("kind"), F.coalesce("tested", F.lit(False))))
    if links.empty:
        return nodes.toPandas(), links.assign(method=None, line=None, snippet=None)
    edge = spark.createDataFrame(links)
    methods = project.edges.join(F.broadcast(edge), ["src", "dst", "kind"], "left_semi").groupBy("src", "dst", "kind").agg(F.min("method").alias("method"))
    place = project.nodes.select(F.col("id").alias("src"), "file_path", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    calls = edge.where("kind in ('call', 'instantiate')").join(place, "src").join(project.nodes.select(F.col("id").alias("dst"), "name"), "dst")
    calls = calls.select(F.concat_ws("|", "src", "dst", "kind").alias("edge"), "name", "file_path", "lo", "hi")
    sites = E.first_match(project.lines(), calls)
    out = edge.join(methods, ["src", "dst", "kind"], "left").withColumn("edge", F.concat_ws("|", "src", "dst", "kind")).join(sites, "edge", "left").drop("edge")
    return nodes.toPandas(), out.toPandas()


def allocate(nodes: pd.DataFrame, budget: int) -> dict[str, str]:
    base = (nodes["id"].str.len() * 2 + nodes["name"].str.len() + nodes["kind"].str.len() + nodes["file_path"].str.len() + nodes["signature"].fillna("").str.len() + nodes["docs"].fillna("").str.len() + 30).astype(int)
    rows = pd.DataFrame({"id": nodes["id"], "priority": nodes["role"].map(E.ROLE_PRIORITY), "kind": nodes["kind"], "base": base, "body": nodes["source"].fillna("").str.len()})
    if -(-int(base.sum()) // 4) <= budget:
        out = E.upgraded(rows, budget)
        return dict(zip(out["id"], out["level"], strict=True))
    left, levels = int(base.sum()), {}
    for r in rows.sort_values(["priority", "id"]).itertuples():
        levels[r.id] = "SIGNATURE" if -(-left // 4) <= budget else "OMIT"
        left -= r.base if levels[r.id] == "OMIT" else 0
    return levels


def place(n: Any) -> str:
    return n.file_path if pd.isna(n.lo) else f"{n.file_path}:{int(n.lo) + 1}"


def reference(n: Any) -> str:
    return f"`{n.name}` ({n.kind}, {place(n)})"


def confidence(method: str | None) -> str:
    return " (name match only)" if method == "global_fallback" else ""


def serialized(plan: QueryPlan, anchors: list[str], nodes: pd.DataFrame, edges: pd.DataFrame, notes: dict[str, Any], levels: dict[str, str]) -> str:
    by, out = {n.id: n for n in nodes.itertuples()}, []
    show = lambda i: reference(by[i]) if i in by else f"`{i}`"
    for a in anchors:
        if a in by:
            n = by[a]
            out += [f"## {n.qualified_name}", f"{n.kind} in {place(n)}"]
            if n.signature:
                out.append(f"    {n.signature}")
            if n.docs:
                out.append(n.docs)
            if n.tested is not None and not pd.isna(n.tested) and not n.tested:
                out.append("No test refers to it.")
            out.append("")
    if plan.operation == "path":
        out.append("### Paths" if notes["paths"] else "No path was found.")
        for i, (ids, kinds) in enumerate(notes["paths"], 1):
            out.append(f"{i}. " + "".join(show(x) + (f" {VERBS.get(k, k)} " if k else "") for x, k in zip(ids, [*kinds, None], strict=True)))
    elif plan.operation == "impact":
        for depth, group in nodes[nodes["distance"] > 0].groupby("distance"):
            out.append(f"### Affected at depth {int(depth)}: {len(group)}")
            out += [f"- {reference(n)}" for n in group.sort_values("id").itertuples()]
    if len(edges):
        out.append("### Relations")
        touch = edges["src"].isin(anchors) | edges["dst"].isin(anchors)
        rows = edges.assign(order=~touch).sort_values(["order", "src", "dst", "kind"], kind="stable").drop_duplicates(["src", "dst", "kind"])
        for e in rows.head(RELATIONS).itertuples():
            site = f" at line {int(e.line)}: `{e.snippet}`" if e.line is not None and not pd.isna(e.line) else ""
            out.append(f"- {show(e.src)} {VERBS.get(e.kind, e.kind)} {show(e.dst)}{site}{confidence(e.method)}")
        dropped = max(0, len(rows) - RELATIONS) + notes.get("omitted_edges", 0)
        if dropped:
            out.append(f"- and {dropped} more")
        weak = int((edges["method"] == "global_fallback").sum())
        if weak:
            out.append(f"{weak} of {len(edges)} relations rest on a name match only.")
    if plan.sources:
        out += sources(nodes, levels)
    return "\n".join(out)


def sources(nodes: pd.DataFrame, levels: dict[str, str]) -> list[str]:
    """Bodies by file, spans merged where they touch or nearly do, lines numbered."""
    out = []
    full = nodes[nodes["id"].map(levels).isin(["FULL", "SNIPPET"]) & nodes["source"].notna()]
    for path, group in full.sort_values(["file_path", "lo"]).groupby("file_path"):
        lines: dict[int, str] = {}
        for n in group.itertuples():
            text = n.source if levels[n.id] == "FULL" else n.source[: E.SNIPPET]
            lines |= {int(n.lo) + i: t for i, t in enumerate(text.split("\n"))}
        out += ["", f"### {path}", "```"]
        last = None
        for i in sorted(lines):
            if last is not None and i > last + 1:
                out.append("...")
            out.append(f"{i + 1}\t{lines[i]}")
            last = i
        out.append("```")
    return out


def answer(project: Project, plan: QueryPlan) -> Answer:
    """The answer to a plan: invalid, not_found, ambiguous, candidates (for searches) or ok."""
    if wrong := problems(plan):
        return Answer("invalid", errors=wrong)
    if plan.search:
        rows = S.discover(project.nodes, plan.anchors[0], plan.nodes or 10).toPandas()
        return Answer("candidates" if len(rows) else "not_found", candidates=rows.to_dict("records"))
    status, anchors, missing = bind(project, plan)
    if status != "resolved":
        return Answer(status, candidates=[{"id": i} for i in anchors], errors=[f"nothing found for {m!r}" for m in missing])
    found, links, notes = structure(project, plan, anchors)
    nodes, edges = evidence(project, plan, found, links)
    levels = allocate(nodes, plan.budget)
    parts = []
    if plan.flow and len(anchors) > 1:
        flows = V.flows(project.edges, anchors).select(F.array_join("nodes", " -> ").alias("p")).orderBy("p").collect()
        if flows:
            parts += ["### Call paths", *[f"- {r.p}" for r in flows], ""]
    if plan.flow:
        known = project.spark.createDataFrame([(a,) for a in anchors], "id string")
        for r in V.blast_radius(project.nodes, project.edges, known, G.test_covered(project.nodes, project.edges)).orderBy("id").collect():
            parts.append(f"- `{r.id}` is referred to {r.n_refs} times from {r.n_files} files" + (f": {r.files}" if r.files else "") + ("; no test refers to it" if r.untested else ""))
    parts.append(serialized(plan, anchors, nodes, edges, notes, levels))
    if project.unresolved is not None:
        mine = project.unresolved.where(F.col("from_symbol_id").isin(anchors))
        for r in G.unresolved_references(mine).orderBy("id").collect():
            parts.append(f"- `{r.id}` has {r.n} unbound references: {', '.join(r.names)}")
    if missing:
        parts.append(f"Not matched: {', '.join(missing)}.")
    text = "\n".join(parts)
    if len(text) > HARD_CAP:
        text = text[:HARD_CAP] + "\n(cut)"
    usage = {"tokens": -(-len(text) // 4), "nodes": len(nodes), "edges": len(edges)} | {f"level_{k.lower()}": v for k, v in Counter(levels.values()).items()}
    return Answer("ok", text, anchors, usage=usage)


def retrieve_context(project: Project, question: str, limit: int = 10) -> dict[str, Any]:
    """What a question needs: strategy, candidates, their neighbourhood by that strategy, files, snippets, and flow steps."""
    kind = strategy(question)
    found = S.discover(project.nodes, question, limit).select("id", "score").collect()
    out: dict[str, Any] = {"strategy": kind, "symbols": [], "files": [], "snippets": [], "flows": [], "dependencies": []}
    if not found:
        return out
    roots = project.spark.createDataFrame([("q", r.id) for r in found], "root string, id string")
    near = V.expand(project.edges, roots, kind).orderBy("depth", "id").limit(V.PRESET_NODES[kind])
    nodes = project.nodes.join(near.select("id", "depth"), "id").where("kind not in ('project', 'file')")
    scores = {r.id: r.score for r in found}
    rows = nodes.select("id", "kind", "name", "file_path", "start_line", "end_line", "depth").collect()
    rows.sort(key=lambda r: (-scores.get(r.id, 0), r.depth, r.id))
    out["symbols"] = [r.id for r in rows]
    out["files"] = list(dict.fromkeys(r.file_path for r in rows))
    ranges = project.spark.createDataFrame([(r.id, r.file_path, r.start_line, r.end_line) for r in rows], "id string, file_path string, lo int, hi int")
    out["snippets"] = [{"id": r.id, "file": r.file_path, "start": r.lo + 1, "end": r.hi + 1, "text": r.text} for r in E.sliced(project.lines(), ranges).orderBy("id").collect()]
    ids = project.spark.createDataFrame([(r.id,) for r in rows], "id string")
    inner = project.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind").distinct().orderBy("src", "dst", "kind").collect()
    out["dependencies"] = [(r.src, r.dst, r.kind) for r in inner if r.kind == "import"]
    if kind == "flow":
        out["flows"] = [{"step": i, "from": r.src, "to": r.dst} for i, r in enumerate((r for r in inner if r.kind in ("call", "instantiate")), 1)]
    return out
