"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so (a sentence end after a least length, or the greatest length),
each chunk gets a 64-bit identifier, and a document becomes the ordered list of its identifiers. The
identifiers are verified: a SHA-256 digest of every chunk goes with it, and an identifier under which
two digests are found is replaced by the digests in every text that has it. Then whole lists are
compared. Text is read once and never shuffled; what moves is eight to forty bytes a chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

LEAST, GREATEST = 512, 4096


def chunk_pattern(least: int = LEAST, greatest: int = GREATEST) -> str:
    """Shortest run of at least `least` characters that ends a sentence or line; else `greatest` characters."""
    return rf"(?s).{{{least}}}.{{0,{greatest - least}}}?(?<=[.!?;:\n])|.{{1,{greatest}}}"


def recipes(docs: DataFrame, least: int = LEAST, greatest: int = GREATEST, identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, n_bytes, sha, chunks): one row per row of `docs`; null text counts as empty, which has no chunk."""
    t = docs.select("doc_id", text_or_empty().alias("t"))
    one = lambda c: F.struct(identify(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("d"))
    return t.select(
        "doc_id",
        F.octet_length("t").cast("long").alias("n_bytes"),
        F.sha2("t", 256).alias("sha"),
        F.transform(F.regexp_extract_all("t", F.lit(chunk_pattern(least, greatest)), F.lit(0)), one).alias("chunks"),
    )


def exact_dedup(docs: DataFrame, least: int = LEAST, greatest: int = GREATEST, identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The row with the largest doc_id stays. Rows that
    repeat both doc_id and text count in group_size and share its fate (they cannot be told apart); a null
    doc_id stays only where its group has no other. `identify` makes the identifier of a chunk, a long. Empty tables give no rows; other columns are ignored.
    """
    made = written(recipes(docs, least, greatest, identify), "recipes")
    known = made.select(F.explode("chunks").alias("c")).select("c.h", "c.d").distinct()
    doubtful = written(known.groupBy("h").count().where("count > 1").select("h"), "doubtful")
    doubted = made.select("sha", F.explode("chunks.h").alias("h")).join(doubtful, "h", "left_semi").select("sha").distinct()
    doubted = written(doubted, "doubted").withColumn("doubt", F.lit(True))
    by_id = F.transform("chunks.h", lambda h: F.hex(h))
    by_digest = F.transform("chunks.d", lambda d: F.hex(d))
    rows = made.join(doubted, "sha", "left").select(
        "doc_id", "n_bytes", F.col("sha").alias("text_sha256"), F.when(F.col("doubt"), by_digest).otherwise(by_id).alias("recipe")
    )
    rows = rows.withColumn("key", F.xxhash64("recipe"))
    same = ["key", "n_bytes", "recipe"]
    groups = rows.groupBy(*same).agg(F.max("doc_id").alias("keep"), F.count("*").alias("size")).where("size > 1")
    groups = written(groups, "groups")
    out = rows.join(groups, same, "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
