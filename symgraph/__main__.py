"""`python -m symgraph index ROOT STORE`, `query ROOT REQUEST...`, `json ROOT`."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from symgraph.plans.answer import Project, answer
from symgraph.plans.plan import explore
from symgraph.sources.extract import index
from symgraph.sources.store import Store, model_json
from symgraph.sources.walk import scan


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("index", "query", "json"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("symgraph").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    model, facts, counts = index(spark, args[1])
    tables = {"symbols": model.symbols, "containments": model.containments, "resolved_references": model.resolved, "unresolved_references": model.unresolved, "diagnostics": model.diagnostics}
    if args[0] == "index":
        version = Store(spark, args[2]).save(tables | {"files": facts}, counts)
        print(f"version {version}: {counts['parsed']} files read, {counts['reused']} reused")
    elif args[0] == "json":
        print(model_json(tables))
    else:
        found = answer(Project.of(model, scan(spark, args[1])), explore(" ".join(args[2:])))
        print(found.text or f"{found.status}: {'; '.join(found.errors)}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
