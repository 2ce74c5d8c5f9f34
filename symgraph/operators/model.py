"""The semantic model: schemas, identifiers, merging of per-file facts, scopes, and the catalog of tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = "start_line int, start_col int, end_line int, end_col int"
SCHEMAS = {
    "symbols": f"id string, kind string, name string, qualified_name string, file_path string, {RANGE}, exported boolean, visibility string, api_method string, api_path string, table_name string, is_service boolean, is_external boolean, declared_type array<string>, seq long",
    "scopes": f"id string, kind string, parent_scope_id string, owner_symbol_id string, file_path string, {RANGE}, seq long",
    "containments": "parent_id string, child_id string, kind string, seq long",
    "references": f"id string, from_symbol_id string, kind string, raw_name string, qualifier_chain array<string>, import_path string, imported_name string, ast_node_type string, file_path string, {RANGE}, seq long",
    "bindings": f"owner_symbol_id string, name string, file_path string, {RANGE}, type_chain array<string>, seq long",
    "diagnostics": f"kind string, severity string, message string, file_path string, {RANGE}, related_candidate_id string",
}


def symbol_id(path: str, chain: list[str]) -> str:
    return "::".join([path.replace("\\", "/"), *chain])


def reference_id(source: str, name: str, at: tuple[int, int, int, int]) -> str:
    return ":".join(["ref", source, name, *map(str, at)])


def scope_id(path: str, kind: str, at: tuple[int, int, int, int]) -> str:
    return ":".join(["scope", path, kind, *map(str, at)])


def range_size(prefix: str = "") -> Column:
    return (F.col(f"{prefix}end_line") - F.col(f"{prefix}start_line")) * 10000 + F.col(f"{prefix}end_col") - F.col(f"{prefix}start_col")


def contains(outer: str, inner: str) -> Column:
    """Whether the range of columns prefixed `outer` holds that of `inner`, ends included."""
    at = lambda p, end: F.struct(F.col(f"{p}{end}_line").alias("l"), F.col(f"{p}{end}_col").alias("c"))
    return (at(outer, "start") <= at(inner, "start")) & (at(inner, "end") <= at(outer, "end"))


@dataclass(frozen=True)
class Model:
    """The tables of a project. `project` is the id of its root symbol."""

    project: str
    symbols: DataFrame
    scopes: DataFrame
    containments: DataFrame
    references: DataFrame
    bindings: DataFrame
    diagnostics: DataFrame
    resolved: DataFrame | None = None
    unresolved: DataFrame | None = None

    def with_files(self, path: str, new: Model | None) -> Model:
        """Facts of one file replaced by those of `new`, or removed."""
        gone = self.symbols.where(F.col("file_path") == path).select(F.col("id").alias("child_id"))

        def swapped(a: DataFrame, b: DataFrame | None) -> DataFrame:
            kept = a.where(F.col("file_path") != path)
            return kept if b is None else kept.unionByName(b.where(F.col("file_path") == path))

        out = {n: swapped(getattr(self, n), getattr(new, n) if new else None) for n in ("symbols", "scopes", "references", "bindings", "diagnostics")}
        held = self.containments.join(gone, "child_id", "left_anti").select(*self.containments.columns)
        if new:
            own = new.symbols.where(F.col("file_path") == path).select(F.col("id").alias("child_id"))
            held = held.unionByName(new.containments.join(own, "child_id", "left_semi").select(*held.columns))
        return replace(self, containments=held, resolved=None, unresolved=None, **out)


def merged(partials: DataFrame, project: str) -> Model:
    """One model of per-file facts (file_path, ordinal, and an array for each table of `SCHEMAS`).

    Sequence numbers go by file, then by place in the file. A file without a symbol of its own gets one, and the
    project owns every file.
    """
    base = (F.col("ordinal") * 1_000_000).cast("long")

    def table(name: str) -> DataFrame:
        rows = partials.select(base.alias("__base"), F.explode(name).alias("r")).select("__base", "r.*")
        return rows.withColumn("seq", F.col("__base") + F.col("seq")).drop("__base") if "seq" in rows.columns else rows.drop("__base")

    symbols = table("symbols")
    files = partials.select("file_path", base.alias("seq"))
    own = symbols.where("kind = 'file'").select("file_path")
    missing = files.join(own, "file_path", "left_anti")
    blank = {c: F.lit(None) for c in symbols.columns}
    made = blank | {
        "id": F.concat_ws("::", "file_path", "file_path"), "kind": F.lit("file"), "name": F.element_at(F.split("file_path", "/"), -1), "qualified_name": F.col("file_path"), "file_path": F.col("file_path"),
        "start_line": F.lit(0), "start_col": F.lit(0), "end_line": F.lit(100000), "end_col": F.lit(0), "exported": F.lit(True), "visibility": F.lit("public"), "is_service": F.lit(False), "is_external": F.lit(False), "seq": F.col("seq"),
    }
    types = {f.name: f.dataType for f in symbols.schema}
    symbols = symbols.unionByName(missing.select(*[v.cast(types[c]).alias(c) for c, v in made.items()]))
    root = made | {"id": F.lit(project), "kind": F.lit("project"), "name": F.lit(project.lstrip(":")), "qualified_name": F.lit(project.lstrip(":")), "file_path": F.lit(""), "seq": F.lit(-1)}
    symbols = symbols.unionByName(partials.sparkSession.range(1).select(*[v.cast(types[c]).alias(c) for c, v in root.items()]))
    owned = symbols.where("kind = 'file'").select(F.lit(project).alias("parent_id"), F.col("id").alias("child_id"), F.lit("owns").alias("kind"), "seq")
    return Model(project, symbols, table("scopes"), table("containments").unionByName(owned), table("references"), table("bindings"), table("diagnostics"))


def scope_members(symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope_id, id, name, seq): the innermost scope of its file that holds each symbol and isn't its own."""
    s = symbols.where(~F.col("kind").isin("file", "project")).select("id", "name", "file_path", "seq", *[F.col(c).alias(f"s_{c}") for c in ("start_line", "start_col", "end_line", "end_col")])
    inside = s.join(scopes.select(F.col("id").alias("scope_id"), "owner_symbol_id", "file_path", F.col("seq").alias("scope_seq"), "start_line", "start_col", "end_line", "end_col"), "file_path")
    inside = inside.where(contains("", "s_") & (F.col("owner_symbol_id").isNull() | (F.col("owner_symbol_id") != F.col("id"))))
    best = inside.groupBy("id", "name", "seq").agg(F.min_by("scope_id", F.struct(range_size().alias("size"), "scope_seq")).alias("scope_id"))
    return best.select("scope_id", "id", "name", "seq")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])
