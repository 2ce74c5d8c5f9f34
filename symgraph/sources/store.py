"""Storing a model: versioned folders of Parquet with a pointer to the newest, JSON, and the per-file cache."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION, PIPELINE_VERSION = 4, 2


class MissingIndex(RuntimeError):
    """There is no stored model at a path."""


class Store:
    """Tables under `root` as `v=<n>/<table>`; `pointer-<n>` names a finished version, and readers take the greatest.

    A version is written whole before its pointer, so readers see the old one or the new one. All access is
    through Spark's file systems.
    """

    def __init__(self, spark: SparkSession, root: str, schema_version: int = SCHEMA_VERSION) -> None:
        self.spark, self.root, self.schema_version = spark, root.rstrip("/"), schema_version
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n.removeprefix("pointer-")) for n in names if n.startswith("pointer-"))

    def save(self, tables: dict[str, DataFrame], meta: dict[str, Any] | None = None, keep: int = 2) -> int:
        """Write a new version, switch to it, and drop all but the newest `keep`."""
        have = self.versions()
        n = (have[-1] if have else 0) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v={n}/{name}")
        told = {"schema_version": self.schema_version, "pipeline_version": PIPELINE_VERSION, "built_at": datetime.now(timezone.utc).isoformat(), "tables": sorted(tables)} | (meta or {})
        rows = [(k, json.dumps(v)) for k, v in told.items()]
        self.spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/v={n}/meta")
        self._fs.create(self._path(f"{self.root}/pointer-{n}")).close()
        for old in have[: max(0, len(have) + 1 - keep)]:
            self._fs.delete(self._path(f"{self.root}/pointer-{old}"), False)
            self._fs.delete(self._path(f"{self.root}/v={old}"), True)
        return n

    def meta(self) -> dict[str, Any]:
        have = self.versions()
        if not have:
            raise MissingIndex(f"no stored model in {self.root}; build one first")
        return {r.key: json.loads(r.value) for r in self.spark.read.parquet(f"{self.root}/v={have[-1]}/meta").collect()} | {"version": have[-1]}

    def built_at(self) -> str:
        return self.meta()["built_at"]

    def changed(self, version: int) -> bool:
        """Whether there is a newer version than the one in use; loading again then gives its tables."""
        return self.versions()[-1:] != [version]

    def load(self) -> dict[str, DataFrame]:
        """The newest version's tables; none if it has another schema version, which means building anew."""
        meta = self.meta()
        if meta["schema_version"] != self.schema_version:
            return {}
        return {t: self.spark.read.parquet(f"{self.root}/v={meta['version']}/{t}") for t in meta["tables"]}


def cached(scan: DataFrame, stored: DataFrame, version: int = PIPELINE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of `scan` (path, content_hash): what `stored` has with the same hash and pipeline version."""
    good = stored.where(F.col("pipeline_version") == version).select("path", "content_hash").distinct()
    return scan.join(good, ["path", "content_hash"], "left_semi"), scan.join(good, ["path", "content_hash"], "left_anti")


def to_json(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as lines of JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def from_json(spark: SparkSession, path: str, schemas: dict[str, Any]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(s).json(f"{path}/{name}") for name, s in schemas.items()}


def model_json(tables: dict[str, DataFrame], most: int = 100_000) -> str:
    """The model as one JSON text, for a dashboard. Refuses tables of more than `most` rows."""
    out = {}
    for name, df in tables.items():
        rows = df.limit(most + 1).toJSON().collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows; store it instead")
        out[name] = [json.loads(r) for r in rows]
    return json.dumps(out)
