"""Evidence for an answer: roles, source slices, call sites, merged spans, and what fits a token budget."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles by priority, kinds whose body is never shown, characters of a snippet, lines that a gap may have.
ROLE_PRIORITY = {"anchor": 100, "path": 80, "impacted": 70, "direct_neighbor": 50, "transitive_neighbor": 20}
NO_BODY = ["class", "file", "module", "project", "package"]
SNIPPET, GAP, DOC_LINES, DOC_BACK = 800, 5, 6, 200


def role(kind: str, distance: Column) -> Column:
    """A node's part in a result of `kind` region, path or impact."""
    rest = {"region": F.when(distance <= 1, "direct_neighbor").otherwise("transitive_neighbor"), "path": F.lit("path"), "impact": F.lit("impacted")}[kind]
    return F.when(distance == 0, "anchor").otherwise(rest)


def source_lines(files: DataFrame, path: str = "file_path", text: str = "source") -> DataFrame:
    """(file_path, line, text): the lines of each file from 0."""
    return files.select(F.col(path).alias("file_path"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("line", "text"))


def sliced(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """`ranges` (id, file_path, lo, hi) with the text of their lines and the first of them without blanks, as signature."""
    inside = ranges.join(lines, "file_path").where((F.col("line") >= F.col("lo")) & (F.col("line") <= F.col("hi")))
    rows = F.array_sort(F.collect_list(F.struct("line", "text")))
    out = inside.groupBy("id", "file_path", "lo", "hi").agg(rows.alias("rows"))
    texts = F.transform("rows", lambda r: r["text"])
    return out.select("id", "file_path", "lo", "hi", F.array_join(texts, "\n").alias("text"), F.trim(F.get(texts, 0)).alias("signature"))


def numbered(lines: DataFrame) -> DataFrame:
    """Lines shown as `n`, a tab, and the text, counted from 1."""
    return lines.select("file_path", "line", F.concat((F.col("line") + 1).cast("string"), F.lit("\t"), F.col("text")).alias("shown"))


def first_match(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """Call sites of `edges` (edge, name, file_path, lo, hi): the first line in range that has the callee's name as a
    word and does not define or declare it, as (edge, line from 1, snippet)."""
    inside = edges.join(lines, "file_path").where((F.col("line") >= F.col("lo")) & (F.col("line") <= F.col("hi")))
    name = F.regexp_replace("name", r"([^A-Za-z0-9_])", r"\\$1")
    named = F.regexp_count("text", F.concat(F.lit(r"\b"), name, F.lit(r"\b"))) > 0
    declared = F.regexp_count("text", F.concat(F.lit(r"\b(?:def|function|class)\s+"), name, F.lit(r"\b"))) > 0
    typed = F.regexp_count("text", F.concat(F.lit(r"(?i)\b"), name, F.lit(r"\s*:\s*(?:callable|str|int|float|bool|list|dict|tuple|set|any|optional|union)\b"))) > 0
    good = inside.where(named & ~declared & ~typed)
    return good.groupBy("edge").agg(F.min(F.struct("line", "text")).alias("m")).select("edge", (F.col("m.line") + 1).alias("line"), F.trim("m.text").alias("snippet"))


def covered(kind: Column, tested: Column) -> Column:
    """Whether tests refer to it; null for what tests don't refer to."""
    return F.when(kind.isin("function", "method", "class", "interface"), tested)


def doc_comment(lines: list[str], start: int) -> str | None:
    """The comment just above a definition: its first six lines without comment marks."""
    found: list[str] = []
    i = start - 1
    while i >= 0 and start - i <= DOC_BACK and lines[i].strip().startswith("@"):
        i -= 1
    block = i >= 0 and lines[i].strip().endswith("*/")
    while i >= 0 and start - i <= DOC_BACK:
        s = lines[i].strip()
        if block:
            found.append(s)
            if s.startswith("/*"):
                break
        elif s.startswith(("//", "#")):
            found.append(s)
        else:
            break
        i -= 1
    text = [t for s in reversed(found) if (t := re.sub(r"^(/\*+|\*+/|\*|//+|#+)\s?|\s*\*+/$", "", s).strip())]
    if not text:
        return None
    return "\n".join(text[:DOC_LINES] + (["…"] if len(text) > DOC_LINES else []))


def merge_spans(spans: DataFrame, key: list[str], gap: int = GAP) -> DataFrame:
    """Spans (key, lo, hi) merged where the next begins at most `gap` after the last has ended: (key, lo, hi, n).

    Spans without an end come last of those that begin with them, so they join what is open there. Equal spans need no
    order among themselves: both windows read one sort.
    """
    order = [F.asc_nulls_last("lo"), F.asc_nulls_last("hi")]
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("lo") <= F.max("hi").over(before) + gap, 0).otherwise(1)
    marked = spans.select(*key, "lo", "hi").withColumn("new", new).withColumn("island", F.sum("new").over(upto))
    return marked.groupBy(*key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).drop("island")


def downgraded(nodes: DataFrame, budget: int, root: list[str] | None = None) -> DataFrame:
    """`nodes` (id, priority, cost) with level SIGNATURE, or OMIT for those of least priority that the budget has no room for.

    The lowest go first until the rest fits, so a node goes if what is left without those before it is still too much.
    """
    parts = root or []
    before = Window.partitionBy(*parts).orderBy("priority", "id").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("cost").over(Window.partitionBy(*parts))
    left = whole - F.coalesce(F.sum("cost").over(before), F.lit(0))
    return nodes.withColumn("level", F.when(left > budget, "OMIT").otherwise("SIGNATURE"))


def upgraded(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Greedy: highest priority first, the whole body if it fits, else a snippet, else the signature.

    `rows`: id, priority, kind, base (characters always shown), body (characters of source, may be missing).
    """
    total, level = int(rows["base"].sum()), {}
    for r in rows.sort_values(["priority", "id"], ascending=[False, True], kind="stable").itertuples():
        level[r.id] = "SIGNATURE"
        if r.kind in NO_BODY or pd.isna(r.body) or not r.body:
            continue
        for name, more in (("FULL", int(r.body)), ("SNIPPET", min(SNIPPET, int(r.body)))):
            if -(-(total + more) // 4) <= budget:
                total, level[r.id] = total + more, name
                break
    return rows[["id"]].assign(level=rows["id"].map(level))


def allocated(nodes: DataFrame, budget: int) -> DataFrame:
    """(root, id, level) for `nodes` (root, id, priority, kind, base, body): a group is one result, of 200 nodes at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if -(-int(pdf["base"].sum()) // 4) <= budget:
            out = upgraded(pdf, budget)
        else:
            left, levels = int(pdf["base"].sum()), {}
            for r in pdf.sort_values(["priority", "id"]).itertuples():
                levels[r.id] = "SIGNATURE" if -(-left // 4) <= budget else "OMIT"
                left -= 0 if levels[r.id] == "SIGNATURE" else int(r.base)
            out = pdf[["id"]].assign(level=pdf["id"].map(levels))
        return out.assign(root=pdf["root"].iloc[0])[["root", "id", "level"]]

    return nodes.groupBy("root").applyInPandas(run, "root string, id string, level string")


def doc_comments(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """(id, docs) for `ranges` (id, file_path, lo) over `files` (file_path, source)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "docs": [doc_comment(re.split("\r?\n", s), int(lo)) for s, lo in zip(pdf["source"], pdf["lo"], strict=True)]})

    return ranges.join(files, "file_path").select("id", "lo", "source").mapInPandas(run, "id string, docs string")
