"""Query plans: what the six requests compile to, and their checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from symgraph.functions.text import FLOW_STOPWORDS

MOST_ANCHORS = 8
OPERATIONS, DIRECTIONS = ("region", "path", "impact"), ("incoming", "outgoing", "both")


@dataclass(frozen=True)
class QueryPlan:
    operation: str
    anchors: tuple[str, ...] = ()
    depth: int | None = None
    nodes: int | None = None
    paths: int | None = None
    direction: str = "outgoing"
    edge_kinds: tuple[str, ...] = ()
    search: bool = False
    free_form: str | None = None
    flow: bool = False
    auto_pick: bool = True
    tolerate_missing: bool = False
    sources: bool = True
    budget: int = 8000
    options: dict[str, Any] = field(default_factory=dict)


def looks_like_anchor(token: str) -> bool:
    """An identifier by its shape, or a plain lower-case word that is not filler."""
    if len(token) <= 1:
        return False
    if re.search(r"[A-Z._/]", token):
        return True
    return bool(re.fullmatch(r"[a-z]+", token)) and token not in FLOW_STOPWORDS


def search_symbols(query: str, **more: Any) -> QueryPlan:
    return QueryPlan("region", (query,), depth=1, nodes=40, search=True, sources=False, auto_pick=False, **more)


def explore_region(symbol: str, depth: int = 3, direction: str = "outgoing", edge_kinds: tuple[str, ...] = (), **more: Any) -> QueryPlan:
    return QueryPlan("region", (symbol,), depth=depth, direction=direction, edge_kinds=edge_kinds, **more)


def trace_path(source: str, target: str, depth: int = 6, **more: Any) -> QueryPlan:
    return QueryPlan("path", (source, target), depth=depth, **more)


def analyze_impact(symbol: str, depth: int = 3, **more: Any) -> QueryPlan:
    return QueryPlan("impact", (symbol,), depth=depth, direction="incoming", **more)


def explore_flow(query: str, **more: Any) -> QueryPlan:
    """The terms of the text that look like symbols, eight at most, and their surroundings."""
    tokens = (t.rstrip("?!,;:()\"'").lstrip("\"'(") for t in query.split())
    return QueryPlan("region", tuple(t for t in tokens if looks_like_anchor(t))[:MOST_ANCHORS], depth=1, direction="both", flow=True, tolerate_missing=True, **more)


def explore(query: str, **more: Any) -> QueryPlan:
    """The whole question binds anchors; questions of impact look at what comes in."""
    from symgraph.functions.text import strategy

    return QueryPlan("region", (), depth=1, direction="incoming" if strategy(query) == "impact" else "both", free_form=query, flow=True, tolerate_missing=True, **more)


def problems(plan: QueryPlan) -> list[str]:
    """All that is wrong with a plan."""
    out = []
    if plan.operation not in OPERATIONS:
        out.append(f"operation is one of {', '.join(OPERATIONS)}, not {plan.operation!r}")
    if plan.operation == "path" and len(plan.anchors) < 2:
        out.append("a path needs two anchors")
    if plan.operation != "path" and not plan.anchors and not plan.free_form:
        out.append("an anchor is needed")
    if plan.direction not in DIRECTIONS:
        out.append(f"direction is one of {', '.join(DIRECTIONS)}, not {plan.direction!r}")
    out += ["an anchor is empty" for a in plan.anchors if not a.strip()]
    for name in ("depth", "nodes", "paths"):
        if (v := getattr(plan, name)) is not None and (not isinstance(v, int) or v < 1):
            out.append(f"{name} is a number from 1, not {v!r}")
    if plan.budget < 1:
        out.append("budget is a number from 1")
    return out
