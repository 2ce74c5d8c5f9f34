"""A PySpark-native engine for symbol graphs. What programs use of it by name; all else is in the modules."""

from symgraph.operators.graph import build as build_graph
from symgraph.operators.model import Model
from symgraph.operators.search import discover, resolve_all, resolve_anchor
from symgraph.plans.answer import Answer, Project, answer, retrieve_context
from symgraph.plans.plan import QueryPlan, analyze_impact, explore, explore_flow, explore_region, search_symbols, trace_path
from symgraph.sources.extract import build, index
from symgraph.sources.store import PIPELINE_VERSION, SCHEMA_VERSION, MissingIndex, Store, from_json, model_json, to_json
from symgraph.sources.walk import from_texts, scan

__all__ = [
    "PIPELINE_VERSION", "SCHEMA_VERSION", "Answer", "MissingIndex", "Model", "Project", "QueryPlan", "Store", "analyze_impact", "answer", "build", "build_graph", "discover", "explore", "explore_flow",
    "explore_region", "from_json", "from_texts", "index", "model_json", "resolve_all", "resolve_anchor", "retrieve_context", "scan", "search_symbols", "to_json", "trace_path",
]
