"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of packets, pieces of at most `packet` tokens of its documents, in a fixed mixed order.
In each round, one a window, a source earns `window` times its target share of tokens and sends the
packets it can pay for; what it has not spent is carried to the next round. A packet that ends at token E
of its queue is therefore sent in round ceil(E / quantum), so rounds come from running sums over the
queues, taken block by block on all machines, and the deficits carried into a partition are the sums of
the blocks before it. Packets in order of round, source and queue place fill the windows without gaps.

Token ids are made once and stored; sizes alone go through the sorts, and ids are joined to the finished
pieces at the end. No task holds a whole queue.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import before_in_block, blocks_for, text_batches, text_or_empty, written
from .tokens import encoder

WINDOW, PACKET, END = 2048, 512, 1


def tokenized(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """A written table (row, doc_id, source, n, ids): `ids` with `end` after each text, two or four bytes an id, and `wide` to tell."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text_or_empty().alias("t"))
    text_batches(docs.sparkSession)

    # only texts go to Python: ids of documents would lose digits there beside a null
    @F.pandas_udf("n long, wide boolean, ids binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        last = np.array([end], enc.dtype).tobytes()
        for texts in batches:
            ids = [enc.encode(t) + last for t in texts]
            n = np.fromiter((len(x) // enc.dtype.itemsize for x in ids), np.int64, len(ids))
            yield pd.DataFrame({"n": n, "wide": np.full(len(ids), enc.dtype.itemsize == 4), "ids": ids})

    made = rows.select("doc_id", "source", run.asNondeterministic()("t").alias("x")).select("doc_id", "source", "x.*")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "tokens")


def _block(col: Column, blocks: int) -> Column:
    """Number of the equal part of the range of longs that `col` lies in, in its order."""
    return F.least(F.lit(blocks - 1), F.floor((col.cast("double") / 2.0**64 + 0.5) * blocks)).cast("long")


def placed(tokens: DataFrame, window: int = WINDOW, packet: int = PACKET, weights: dict[str, float] | None = None) -> DataFrame:
    """Pieces (row, start, length, sequence_id, offset) of the rows of `tokenized`."""
    sizes = tokens.select("row", "doc_id", "source", "n")
    rows = sizes.count()
    blocks = blocks_for(rows)
    h = F.xxhash64("doc_id", F.lit("queue"))
    sizes = sizes.withColumn("h", h).withColumn("block", _block(F.col("h"), blocks))
    sums = written(sizes.groupBy("source", "block").agg(F.sum("n").alias("tokens")), "queues")
    ahead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "block", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("before"), F.sum("tokens").over(Window.partitionBy("source")).alias("total"))
    sums = written(sums, "offsets")
    everything = sums.select("source", "total").distinct().agg(F.sum("total")).first()[0] or 0
    share = F.col("total") / F.lit(float(max(everything, 1)))
    if weights and any(v < 0 for v in weights.values()):
        raise ValueError("weights are shares, not below zero")
    if weights and sum(weights.values()) > 0:
        whole = float(sum(weights.values()))
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, v / whole)])
        share = F.coalesce(F.try_element_at(given, "source"), share)
    queued = before_in_block(sizes, ["source", "block"], [F.col("h"), F.col("doc_id"), F.col("row")], "n", "inside")
    sums = sums.withColumn("quantum", share * window)
    # sources whose target is zero wait until all others are sent, then go by the corpus's own shares
    last = sums.where("quantum > 0").agg(F.max(F.ceil(F.col("total") / F.col("quantum")))).first()[0] or 0
    late = F.when(F.col("quantum") > 0, 0).otherwise(int(last)).cast("long")
    own = F.greatest(F.col("total") / F.lit(float(max(everything, 1))), F.lit(1e-18)) * window
    sums = sums.withColumn("late", late).withColumn("quantum", F.when(F.col("quantum") > 0, F.col("quantum")).otherwise(own))
    queued = queued.join(sums, ["source", "block"])
    cut = queued.select(
        "row", "source", "n", "quantum", "late", (F.col("before") + F.col("inside")).alias("at"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / packet).cast("long"))).alias("k"),
    )
    packets = cut.select(
        "row", "source", (F.col("k") * packet).alias("start"), F.least(F.lit(packet).cast("long"), F.col("n") - F.col("k") * packet).alias("length"),
        "quantum", "late", (F.col("at") + F.col("k") * packet).alias("place"),
    )
    packets = packets.withColumn("round", F.col("late") + F.ceil((F.col("place") + F.col("length")) / F.col("quantum")).cast("long")).drop("quantum", "late")
    packets = written(packets, "packets")
    last, count = packets.agg(F.max("round"), F.count("*")).first()
    parts = blocks_for(count, most=4096)
    packets = packets.withColumn("part", F.floor(F.col("round") * F.lit(float(parts)) / F.lit(float((last or 0) + 1))).cast("long"))
    part_sums = packets.groupBy("part").agg(F.sum("length").alias("tokens"))
    # at most 4096 rows in this window
    part_sums = written(part_sums.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")), "parts")
    lined = before_in_block(packets, ["part"], [F.col("round"), F.xxhash64("source"), F.col("source"), F.col("place")], "length", "inside").join(part_sums, "part")
    lined = lined.withColumn("at", F.col("before") + F.col("inside"))
    w = F.lit(window)
    spread = lined.select("row", "start", "length", "at", F.explode(F.sequence(F.floor(F.col("at") / w), F.floor((F.col("at") + F.col("length") - 1) / w))).alias("sequence_id"))
    begin, end = F.greatest("at", F.col("sequence_id") * w), F.least(F.col("at") + F.col("length"), (F.col("sequence_id") + 1) * w)
    return spread.select(
        "row", (F.col("start") + begin - F.col("at")).cast("long").alias("start"), (end - begin).cast("long").alias("length"),
        F.col("sequence_id").cast("long").alias("sequence_id"), (begin - F.col("sequence_id") * w).cast("long").alias("offset"),
    )


def with_ids(tokens: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows of `tokens` with `pieces`, an array in order of start of (start, length, sequence_id, offset)."""
    own = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    return tokens.join(own, "row")


def _of_pieces(kind: str, each):
    """A UDF over (ids, wide, starts, lengths) that gives `each` of every piece's ids as 32-bit numbers."""

    @F.pandas_udf(f"array<{kind}>")
    def run(ids: pd.Series, wide: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        out = []
        for x, w, a, n in zip(ids, wide, starts, lengths, strict=True):
            row = np.frombuffer(x, "<u4" if w else "<u2").astype("<u4")
            out.append([each(row[i : i + k]) for i, k in zip(a, n, strict=True)])
        return pd.Series(out)

    return run("ids", "wide", F.col("pieces.start"), F.col("pieces.length"))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, packet: int = PACKET, weights: dict[str, float] | None = None, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of `docs` (doc_id, text, source) is tokenized whole (null text as empty), `end` is added, and each
    id lies in exactly one piece. `weights` are target shares by source (default: the corpus's own, by
    tokens; sources that it lacks keep theirs; those of weight zero come after all others, and with no weight above zero the
    corpus's own shares hold). A source that runs out leaves its share to the others. Null
    sources count as the empty name; repeated rows are packed each; an empty table gives no rows; other
    columns are ignored. Only the last sequence can be short.
    """
    tokens = tokenized(docs, tokenizer, end)
    rows = with_ids(tokens, placed(tokens, window, packet, weights))
    made = rows.select("doc_id", F.col("n").alias("doc_tokens"), "pieces", _of_pieces("long", lambda x: zlib.crc32(x.tobytes())).alias("crc"))
    out = made.select("doc_id", "doc_tokens", F.explode(F.arrays_zip("pieces", "crc")).alias("p"))
    return out.select(
        "doc_id", F.col("p.pieces.start").alias("start"), F.col("p.pieces.length").alias("length"), F.col("p.crc").alias("ids_crc32"), "doc_tokens",
        F.col("p.pieces.sequence_id").alias("sequence_id"), F.col("p.pieces.offset").alias("offset"),
    )


def sequences(docs: DataFrame, tokenizer: str, window: int = WINDOW, packet: int = PACKET, weights: dict[str, float] | None = None, end: int = END) -> DataFrame:
    """The packed windows themselves: sequence_id, n_tokens, input_ids (array of int), as `pack` places them."""
    tokens = tokenized(docs, tokenizer, end)
    rows = with_ids(tokens, placed(tokens, window, packet, weights))
    made = rows.select("pieces", _of_pieces("array<int>", lambda x: x.astype("<i4")).alias("part"))
    out = made.select(F.explode(F.arrays_zip("pieces", "part")).alias("p")).select(F.col("p.pieces.sequence_id").alias("sequence_id"), F.col("p.pieces.offset").alias("offset"), F.col("p.part").alias("part"))
    joined = out.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "part"))), lambda x: x["part"])).alias("input_ids"))
    return joined.select("sequence_id", F.size("input_ids").alias("n_tokens"), "input_ids")
