"""Extraction: one `mapInPandas` over source files gives each file's facts as arrays, ready to be merged."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.operators.model import SCHEMAS, Model, merged
from symgraph.operators.resolve import resolved

from .langs import braces, html, python
from .langs.facts import TABLES, Facts
from .store import PIPELINE_VERSION, cached
from .walk import scan

PARTIAL = "file_path string, ordinal long, content_hash string, pipeline_version int, " + ", ".join(f"`{t}` array<struct<{re.sub(r'(\w+) ([\w<>]+)', r'\1:\2', SCHEMAS[t])}>>" for t in TABLES)


def facts_of(path: str, lang: str, text: str, link_file_members: bool = False) -> dict[str, list[dict[str, Any]]]:
    """The facts of one file; a file that can't be read at all has its own symbol and a diagnostic."""
    lines = text.split("\n")
    facts = Facts(path, (len(lines) - 1, len(lines[-1])), link_file_members)
    try:
        if lang == "python":
            python.read(facts, text)
        elif lang == "html":
            html.read(facts, text)
        else:
            braces.read(facts, text, lang)
    except RecursionError:
        facts.problem(0)
    return facts.rows


def extracted(sources: DataFrame, link_file_members: bool = False) -> DataFrame:
    """Per-file facts (`PARTIAL`) of sources (file_path, language, source, content_hash, ordinal)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                rows = facts_of(r.file_path, r.language, r.source, link_file_members)
                out.append({"file_path": r.file_path, "ordinal": r.ordinal, "content_hash": r.content_hash, "pipeline_version": PIPELINE_VERSION, **rows})
            yield pd.DataFrame(out, columns=["file_path", "ordinal", "content_hash", "pipeline_version", *TABLES])

    return sources.select("file_path", "ordinal", "language", "source", "content_hash").mapInPandas(run, PARTIAL)


def partials(sources: DataFrame, stored: DataFrame | None = None, version: int = PIPELINE_VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts of all files, files read anew, files reused): what `stored` has with the same path, hash and version is not read again."""
    if stored is None:
        return extracted(sources), sources, sources.limit(0)
    keys = sources.select(F.col("file_path").alias("path"), "content_hash")
    hits, misses = cached(keys, stored.withColumnRenamed("file_path", "path"), version)
    new = sources.join(misses.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    old = sources.join(hits.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    reused = stored.drop("ordinal").join(old.select("file_path", "content_hash", "ordinal"), ["file_path", "content_hash"]).select(*[f.name for f in stored.schema])
    return extracted(new).unionByName(reused), new, old


def build(sources: DataFrame, project: str = "::project", stored: DataFrame | None = None) -> tuple[Model, DataFrame, dict[str, int]]:
    """(resolved model, per-file facts, how many files were read and reused). Resolution is always over the whole."""
    from symgraph.functions.shared import materialized

    facts, new, old = partials(sources, stored)
    counts = {"parsed": new.count(), "reused": old.count()}
    facts = materialized(facts, "facts")
    return resolved(merged(facts, project)), facts, counts


def index(spark: SparkSession, root: str) -> tuple[Model, DataFrame, dict[str, int]]:
    name = root.rstrip("/").rsplit("/", 1)[-1]
    return build(scan(spark, root), f"::{name}")
