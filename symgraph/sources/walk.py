"""Finding source files: excluded folders, ignore rules, languages. Spark's own listing hides names that begin with `_` or `.`,
so the tree is walked on the driver, which needs names only, and files are read on the executors."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from symgraph.functions.text import LANGUAGES

# Folders that are never entered.
EXCLUDED = {"node_modules", "dist", "build", "__pycache__", ".git", "venv", ".venv", "env", ".env"}
FILES = "file_path string, absolute_path string, language string, mtime_ms long, ordinal long"
SOURCES = f"{FILES}, source string, content_hash string"


def language(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in os.path.basename(path) else None


def ignore_rules(text: str) -> list[tuple[re.Pattern[str], bool, bool]]:
    """(pattern, negated, folders only) of each rule of an ignore file, with the usual glob meanings."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        folders, line = line.endswith("/"), line.rstrip("/")
        rooted, line = "/" in line, line.removeprefix("/")
        out, i = "", 0
        while i < len(line):
            if line.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif line.startswith("**", i):
                out, i = out + ".*", i + 2
            else:
                out += {"*": "[^/]*", "?": "[^/]"}.get(line[i], re.escape(line[i]))
                i += 1
        rules.append((re.compile(("^" if rooted else "(?:^|/)") + out + "$"), negated, folders))
    return rules


def ignored(path: str, is_folder: bool, rules: list[tuple[re.Pattern[str], bool, bool]]) -> bool:
    """The last rule that matches decides."""
    verdict = False
    for pattern, negated, folders in rules:
        if (is_folder or not folders) and pattern.search(path):
            verdict = not negated
    return verdict


def walk(root: str) -> list[tuple[str, str, str, int]]:
    """(path, absolute path, language, mtime) of the sources of a project, in order of path."""
    rules, out = [], []
    at = os.path.join(root, ".gitignore")
    if os.path.isfile(at):
        with open(at, encoding="utf-8", errors="replace") as f:
            rules = ignore_rules(f.read())
    for folder, names, files in os.walk(root):
        here = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = lambda n, here=here: n if here == "." else f"{here}/{n}"
        names[:] = sorted(n for n in names if n.lower() not in EXCLUDED and not n.startswith(".") and not ignored(rel(n), True, rules))
        for n in files:
            if (lang := language(n)) and not n.startswith(".") and not ignored(rel(n), False, rules):
                full = os.path.join(folder, n)
                out.append((rel(n), full, lang, int(os.path.getmtime(full) * 1000)))
    return sorted(out)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The sources of a project (`SOURCES`); a file that can't be read is left out."""
    rows = [(*r, i) for i, r in enumerate(walk(root))]
    found = spark.createDataFrame(rows, FILES)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for path in pdf["absolute_path"]:
                try:
                    with open(path, encoding="utf-8", errors="replace", newline="") as f:
                        texts.append(f.read())
                except OSError:
                    texts.append(None)
            pdf = pdf.assign(source=texts)
            pdf = pdf[pdf["source"].notna()]
            yield pdf.assign(content_hash=[hashlib.sha1(t.encode("utf-8", "surrogatepass")).hexdigest() for t in pdf["source"]])

    return found.mapInPandas(read, SOURCES)


def from_texts(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Sources given as texts by path, for tests and for tables of code."""
    rows = [(p, p, language(p), 0, i, t, hashlib.sha1(t.encode()).hexdigest()) for i, (p, t) in enumerate(sorted(files.items())) if language(p)]
    return spark.createDataFrame(rows, SOURCES)
