"""Watching a project: change events, quiet times, and rebuilding once for all changes of a burst.

Events come from any stream of (path, ts). A session window with the quiet time as its gap closes when nothing
has come for that long; each closed window is one rebuild, with what came meanwhile in the next.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from symgraph.sources.walk import walk

QUIET, LATE = "1 second", "0 seconds"


def bursts(events: DataFrame, quiet: str = QUIET, late: str | None = LATE, keys: list[str] | None = None) -> DataFrame:
    """(keys, start, end, n, paths): bursts of `events` (path, ts); batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    # a stream's session windows need a key: without one, the same empty text for all
    own = [F.col(k) for k in keys] if keys else [F.substring("path", 1, 0).alias("all")]
    out = rows.groupBy(*own, F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("paths"))
    return out.select(*(keys or []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "paths")


class ChangeReader(SimpleDataSourceStreamReader):
    """Changes of the sources under a folder since the last offset, found by size and time of each file."""

    def __init__(self, root: str) -> None:
        self.root = root

    def _state(self) -> dict[str, list[int]]:
        return {p: [m, os.path.getsize(full)] for p, full, _, m in walk(self.root) if os.path.exists(full)}

    def initialOffset(self) -> dict[str, Any]:
        return {"state": {}, "first": True}

    def read(self, start: dict[str, Any]) -> tuple[Iterator[tuple], dict[str, Any]]:
        now, old = self._state(), start["state"]
        stamp = time.time()
        changed = [] if start.get("first") else sorted(p for p in {*now, *old} if now.get(p) != old.get(p))
        from datetime import datetime, timezone

        at = datetime.fromtimestamp(stamp, timezone.utc).replace(tzinfo=None)
        return iter([(p, at) for p in changed]), {"state": now, "first": False}

    def readBetweenOffsets(self, start: dict[str, Any], end: dict[str, Any]) -> Iterator[tuple]:
        from datetime import datetime

        old, new = start["state"], end["state"]
        if start.get("first"):
            return iter([])
        return iter([(p, datetime.now()) for p in sorted({*new, *old}) if new.get(p) != old.get(p)])


class Changes(DataSource):
    """`spark.readStream.format("source_changes").option("root", ...)`: (path, ts) of each changed source file."""

    @classmethod
    def name(cls) -> str:
        return "source_changes"

    def schema(self) -> str:
        return "path string, ts timestamp"

    def simpleStreamReader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(self.options["root"])


class Rebuilder:
    """One rebuild at a time; a failed one keeps what was built before."""

    def __init__(self, rebuild: Callable[[list[str]], Any]) -> None:
        self.rebuild, self.current, self.failures, self.runs = rebuild, None, 0, 0

    def __call__(self, batch: DataFrame, _: int = 0) -> None:
        paths = sorted({p for r in batch.select("paths").collect() for p in r.paths})
        if not paths:
            return
        self.runs += 1
        try:
            self.current = self.rebuild(paths)
        except Exception:  # noqa: BLE001  the old graph stays in use
            self.failures += 1


def watch(spark: SparkSession, root: str, rebuild: Callable[[list[str]], Any], checkpoint: str, quiet: str = QUIET):
    """Start the stream that rebuilds after each burst of changes under `root`; gives the query and its rebuilder."""
    spark.dataSource.register(Changes)
    events = spark.readStream.format("source_changes").option("root", root).load()
    handler = Rebuilder(rebuild)
    query = bursts(events, quiet).writeStream.outputMode("append").foreachBatch(handler).option("checkpointLocation", checkpoint).start()
    return query, handler
