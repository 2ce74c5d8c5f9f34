"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A text's lines, long ones wrapped at sentence ends or after `WORDS` words, are hashed. Of every two
neighbouring runs of three line hashes the lesser one is the fingerprint of the four lines that they
span, so any two places with the same four lines have a fingerprint in common. Fingerprints that are seen
once are dropped; the others are joined, and each match is extended to the line before or after it, which
decides whether all four lines repeat. Lines of a run of four or more that has come before, in order of
doc_id and place, are deleted.

Only hashes are shuffled until the end, when the deleted runs are joined to the texts that have any; bitmaps of
bounded size keep most other rows out of the joins. The first place of
a fingerprint is a pre-aggregated minimum, so no task gathers all places of a common line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_in, text_or_empty, written

WORDS, RUN = 16, 4
_W, _H = r"[^ \t\r\n]", r"[ \t\r]"
#: Up to sixteen words; a word that ends a sentence or line is the last. Blanks after it belong to it.
LINE = rf"[ \t\r\n]*(?:{_W}*[^ \t\r\n.!?]{_H}+){{0,{WORDS - 1}}}{_W}+[ \t\r\n]*"


def lines_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, u): a key of the text, and the hashes of its lines without the blanks around them."""
    t = docs.select("doc_id", text_or_empty().alias("t"))
    u = F.transform(lines_of(F.col("t")), lambda x: F.xxhash64(F.btrim(x, F.lit(" \t\r\n"))))
    return t.select("doc_id", F.xxhash64("t", F.lit(1)).alias("key"), u.alias("u"))


def fingerprints(lines: DataFrame) -> DataFrame:
    """(doc_id, key, g, pos, before, after): each chosen run of three lines from `pos`, and the line
    before or after it where it is the lesser run of the four lines with that one."""
    runs = F.transform(F.sequence(F.lit(0), F.size("u") - 3), lambda i: F.xxhash64(F.get("u", i), F.get("u", i + 1), F.get("u", i + 2)))
    some = lines.where(F.size("u") >= RUN).select("doc_id", "key", "u", runs.alias("g"))
    last = F.size("g") - 1
    left = lambda i: (i > 0) & (F.get("g", i) < F.get("g", i - 1))
    right = lambda i: (i < last) & (F.get("g", i) <= F.get("g", i + 1))
    chosen = F.filter(F.sequence(F.lit(0), last), lambda i: left(i) | right(i))
    each = F.transform(
        chosen,
        lambda i: F.struct(F.get("g", i).alias("g"), i.alias("pos"), F.when(left(i), F.get("u", i - 1)).alias("before"), F.when(right(i), F.get("u", i + 3)).alias("after")),
    )
    return some.select("doc_id", "key", F.explode(each).alias("f")).select("doc_id", "key", "f.*")


def repeated_runs(lines: DataFrame) -> DataFrame:
    """(doc_id, key, runs): the stretches of lines to delete, as an array in order of (first, last)."""
    prints = fingerprints(lines)
    common = written(prints.groupBy("g").count().where("count > 1").select("g"), "common")
    again = maybe_in(prints, common, F.col("g"), "maybe").where("maybe").drop("maybe")
    again = written(again.join(common.hint("merge"), "g", "left_semi"), "again")
    sides = F.array(
        F.struct(F.lit(True).alias("early"), F.col("before").alias("line"), (F.col("pos") - 1).alias("at")),
        F.struct(F.lit(False).alias("early"), F.col("after").alias("line"), F.col("pos").alias("at")),
    )
    fours = again.select("doc_id", "key", "g", F.explode(sides).alias("s")).select("doc_id", "key", "g", "s.*").where("line is not null")
    same = ["g", "early", "line"]
    first = written(fours.groupBy(*same).agg(F.min(F.struct("doc_id", "key", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    later = fours.join(first.hint("merge"), same).where(F.struct("doc_id", "key", "at") > F.col("first")).select("doc_id", "key", "at").distinct()
    return stretches(later, RUN)


def stretches(later: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, runs): what the runs of `size` places from each `at` of `later` (doc_id, key, at) cover, in order."""
    ordered = Window.partitionBy("doc_id", "key").orderBy("at")
    apart = F.when(F.col("at") > F.lag("at").over(ordered) + size, 1).otherwise(0)
    islands = later.withColumn("apart", apart).withColumn("island", F.sum("apart").over(ordered))
    merged = islands.groupBy("doc_id", "key", "island").agg(F.min("at").alias("a"), (F.max("at") + size - 1).alias("b"))
    return written(merged.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs")), "runs")


def kept_text(text: Column, runs: Column, units=lines_of) -> Column:
    """`text` without the lines, or other units, of `runs`."""
    lines = units(text)
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["b"] + 1))
    ends = F.concat(F.transform(runs, lambda r: r["a"]), F.array(F.size(lines)))
    return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))))), "")


def line_dedup(docs: DataFrame, lines: str = "n_lines", removed: str = "n_removed") -> DataFrame:
    """`docs` (doc_id, text, any other columns) with later repeated runs of lines deleted from `text`, and two
    columns more: how many lines each text had and how many of them were deleted.

    Order is that of (doc_id, text hash, line); null doc_ids come first. Null texts stay null and empty ones
    empty. Rows that repeat both doc_id and text are one document with one result, given for each. An empty
    table gives no rows. If columns named `lines` or `removed` are there already, they are replaced.
    """
    hashes = written(hashed(docs), "lines")
    runs = repeated_runs(hashes)
    own = [c for c in docs.columns if c not in (lines, removed)]
    text, count = F.col("text").cast("string"), F.size(lines_of(text_or_empty())).cast("long").alias(lines)
    marked = docs.select(*own, F.xxhash64(text_or_empty(), F.lit(1)).alias("__key"))
    marked = maybe_in(marked, runs.select(F.xxhash64("doc_id", "key").alias("k")), F.xxhash64("doc_id", "__key"), "__maybe")
    whole = marked.where(~F.col("__maybe")).select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in own], count, F.lit(0).cast("long").alias(removed))
    cuts = runs.select(F.col("doc_id").alias("__id"), F.col("key").alias("__cut"), F.col("runs").alias("__runs")).hint("merge")
    some = marked.where("__maybe").join(cuts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__cut")), "left")
    gone = F.coalesce(F.aggregate("__runs", F.lit(0), lambda n, r: n + r["b"] - r["a"] + 1), F.lit(0)).cast("long").alias(removed)
    kept = F.when(F.col("__runs").isNull(), text).otherwise(kept_text(text, F.col("__runs"))).alias("text")
    return whole.unionByName(some.select(*[kept if c == "text" else F.col(f"`{c}`") for c in own], count, gone))


#: DuckDB: the rows of the query, from the definition alone: every run of four lines that has come before.
ORACLE = rf"""
    WITH u AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{LINE}') AS lines FROM documents
    ), l AS (
        SELECT doc_id, unnest(range(1, len(lines) - 2)) AS p, list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))) AS trimmed
        FROM u WHERE len(lines) >= {RUN}
    ), w AS (
        SELECT doc_id, p, trimmed[p:p + {RUN - 1}] AS four FROM l
    ), f AS (
        SELECT doc_id, p, row_number() OVER (PARTITION BY four ORDER BY doc_id, p) AS nth FROM w
    ), gone AS (
        SELECT doc_id, list_distinct(flatten(list(range(p, p + {RUN})))) AS lost FROM f WHERE nth > 1 GROUP BY doc_id
    ), kept AS (
        SELECT u.doc_id, u.t, u.lines, coalesce(len(g.lost), 0) AS n,
               array_to_string(list_filter(u.lines, lambda x, i: NOT list_contains(coalesce(g.lost, []), i)), '') AS rest
        FROM u LEFT JOIN gone g ON u.doc_id = g.doc_id
    )
    SELECT doc_id, len(lines)::BIGINT AS n_lines, n::BIGINT AS n_removed, sha256(CASE WHEN n = 0 THEN t ELSE rest END) AS kept_sha256 FROM kept
"""
