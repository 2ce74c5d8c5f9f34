"""Passages of `SPAN` words or more that come again, wherever they start, in DataFrame functions only.

Hashes of all runs of `SPAN` words are made of hashes of shorter runs, twice as long each time. The fingerprint of a
run is the least hash of the runs of `GRAM` words in it, so equal runs have equal fingerprints, and neighbours mostly share
theirs. Only runs whose fingerprint is in another text too, or of texts that repeat a run within, become rows. Words of a run
that has come before, in order of doc_id and place, are deleted; runs overlap, so a longer passage goes whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, text_or_empty, written
from .line_dedup import kept_text, stretches

SPAN, GRAM = 51, 26
#: A word and the blanks after it; those before the first belong to it.
WORD = r"[ \t\r\n]*[^ \t\r\n]+[ \t\r\n]*"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _pairs(name: str, gap: int, f) -> Column:
    """`f` of each entry of an array and the one `gap` places on."""
    n = F.size(name) - gap
    return F.zip_with(F.slice(name, 1, n), F.slice(name, gap + 1, n), f)


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, h, m) of texts of `SPAN` words or more: hash and fingerprint of the run from each word."""
    t = docs.select("doc_id", text_or_empty().alias("t"))
    trimmed = F.transform(words_of(F.col("t")), lambda x: F.xxhash64(F.btrim(x, F.lit(" \t\r\n"))))
    rows = t.select("doc_id", F.xxhash64("t", F.lit(1)).alias("key"), trimmed.alias("h")).where(F.size("h") >= SPAN)
    for gap in (1, 2, 4, 8, GRAM - 16):
        rows = rows.withColumn("h", _pairs("h", gap, lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn("m", F.col("h")).withColumn("h", _pairs("h", SPAN - GRAM, lambda a, b: F.xxhash64(a, b)))
    for gap in (1, 2, 4, 8, SPAN - GRAM + 1 - 16):
        rows = rows.withColumn("m", _pairs("m", gap, lambda a, b: F.least(a, b)))
    return rows


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, key, runs): the stretches of words to delete, as an array in order of (first, last)."""
    prints = spans(docs).select("doc_id", "key", F.explode(F.array_distinct("m")).alias("f"))
    common = written(prints.groupBy("f").agg(F.min(F.struct("doc_id", "key")).alias("a"), F.max(F.struct("doc_id", "key")).alias("b")).where("a <> b").select("f"), "passages")
    last = F.size("m") - 1
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get("m", i) != F.get("m", i - 1)))
    rows = spans(docs).select("doc_id", "key", "h", "m", starts.alias("s"), (F.size(F.array_distinct("h")) < F.size("h")).alias("self"))
    each = F.transform("s", lambda p, k: F.struct(F.get("m", p).alias("f"), p.alias("p"), F.slice("h", p + 1, F.coalesce(F.get("s", k + 1), F.size("m")) - p).alias("h")))
    rows = rows.select("doc_id", "key", "self", F.explode(each).alias("e")).select("doc_id", "key", "self", "e.*")
    some = written(maybe_in(rows, common, F.col("f"), "maybe").where("maybe or self").drop("maybe", "self"), "runs-of-words")
    runs = some.select("doc_id", "key", "p", F.posexplode("h").alias("k", "h")).select("doc_id", "key", "h", (F.col("p") + F.col("k")).alias("at"))
    first = written(runs.groupBy("h").agg(F.min(F.struct("doc_id", "key", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-words")
    later = maybe_in(runs, first.select("h"), F.col("h"), "maybe").where("maybe").drop("maybe")
    later = later.join(first.hint("merge"), "h").where(F.struct("doc_id", "key", "at") > F.col("first")).select("doc_id", "key", "at").distinct()
    return stretches(later, SPAN)


def without_passages(docs: DataFrame, removed: str = "n_words_removed") -> DataFrame:
    """`docs` (doc_id, text, any other columns) with later repeats of `SPAN` words or more deleted from `text`, and
    how many words of each were.

    A repeat may start at any word; words are what stands between blanks. Nulls, repeated rows and empty tables as in `line_dedup`.
    """
    runs = repeated_passages(docs)
    own = [c for c in docs.columns if c != removed]
    text = F.col("text").cast("string")
    marked = docs.select(*own, F.xxhash64(text_or_empty(), F.lit(1)).alias("__key"))
    marked = maybe_in(marked, runs.select(F.xxhash64("doc_id", "key").alias("k")), F.xxhash64("doc_id", "__key"), "__maybe")
    whole = marked.where(~F.col("__maybe")).select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in own], F.lit(0).cast("long").alias(removed))
    cuts = runs.select(F.col("doc_id").alias("__id"), F.col("key").alias("__cut"), F.col("runs").alias("__runs")).hint("merge")
    some = marked.where("__maybe").join(cuts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__cut")), "left")
    gone = F.coalesce(F.aggregate("__runs", F.lit(0), lambda n, r: n + r["b"] - r["a"] + 1), F.lit(0)).cast("long").alias(removed)
    kept = F.when(F.col("__runs").isNull(), text).otherwise(kept_text(text, F.col("__runs"), words_of)).alias("text")
    return whole.unionByName(some.select(*[kept if c == "text" else F.col(f"`{c}`") for c in own], gone))
