"""Suffix dedup: every byte covered by a 200-byte string that starts anywhere else too is removed.

Strings that repeat are found by bucket-pointer refinement. Suffixes begin in buckets by their first eight bytes;
a bucket is refined by sorting its suffixes on the identifiers of the buckets in which their continuations,
as many bytes later as the bucket has depth, lie. The refined identifiers are the pointers of the next round, so
the depth doubles each time until it is that of the strings, and suffixes alone in a bucket drop out.

What is sorted, and where: of the 101 runs of 100 bytes in a string the one with the least hash is its anchor (the
last of equals), so equal strings have equal anchors at equal places. Anchors that occur once are dropped.
The rest of the text, the strings of one anchor with the bytes they span being a context, is dealt to tasks by
anchor. Equal contexts are first reduced to one, by partial aggregation. A task refines a few
megabytes of whole buckets of contexts at a time. An anchor with very many contexts is dealt again, its strings
parted by where the anchor lies in them and by the bytes that all strings of a part must share, until
no bucket is large; no task gathers all places of a common passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_in, text_batches, text_or_empty, written

LENGTH, LARGE, PIECE, BATCH = 200, 20_000, 1 << 18, 1 << 20
_B = 0x9E3779B97F4A7C15
_MASK = np.uint64((1 << 20) - 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        n = max(n, PIECE * 2)
        up, down = np.full(n, _B, np.uint64), np.full(n, pow(_B, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[0] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def run_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of `q` bytes."""
    up, down = powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    h = (sums[q:] - sums[:-q]) * down[: len(data) - q + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def least_of(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    out, have = key, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    if have < width:
        out = np.minimum(out[: len(key) - width + 1], out[width - have :])
    return out


def anchors(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, place of the anchor, first and last start of its strings, hash) for each text or piece of one."""
    q = length // 2
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def done() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        data = np.frombuffer(b"".join(p for *_, p in parts), np.uint8).astype(np.uint64)
        h = run_hashes(data, q)
        place = np.arange(len(h), dtype=np.uint64)
        key = least_of((h & ~_MASK) | (_MASK - place), length - q + 1)
        at = (_MASK - (key & _MASK)).astype(np.int64)
        begins = np.cumsum([0, *(len(p) for *_, p in parts)])
        good = np.ones(len(at), bool)
        for b in begins[1:-1]:
            good[max(0, b - length + 1) : b] = False
        new = np.concatenate(([True], (at[1:] != at[:-1]) | ~good[:-1]))
        lo = np.flatnonzero(good & new)
        ends = np.flatnonzero(good & np.concatenate((new[1:] | ~good[1:], [True])))
        where = np.searchsorted(lo, begins)
        for i, (number, base, _) in enumerate(parts):
            cut = slice(where[i], where[i + 1])
            shift = base - begins[i]
            if cut.stop > cut.start:
                yield number, at[lo[cut]] + shift, lo[cut] + shift, ends[cut] + shift, h[at[lo[cut]]].view(np.int64)

    for number, text in enumerate(texts):
        for base in range(0, len(text) - length + 1, PIECE):
            part = text[base : base + PIECE + length - 1]
            if size and size + len(part) > PIECE + length:
                yield from done()
                parts, size = [], 0
            parts.append((number, base, part))
            size += len(part)
    if parts:
        yield from done()


def refined(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of `starts` begin a string of `length` bytes that starts at another of them too.

    `data` has `length` bytes from each start on.
    """
    q = 8
    if length < q:
        raise ValueError("strings of under eight bytes are not supported")
    need = np.zeros(len(data) + 1, np.int64)
    np.add.at(need, starts, 1)
    np.add.at(need, starts + length - q + 1, -1)
    live = np.flatnonzero(np.cumsum(need[:-1]) > 0)  # suffixes whose first bytes lie in some string
    grams = np.zeros(len(live), np.uint64)
    for j in range(q):
        grams = (grams << np.uint64(8)) | data[live + j].astype(np.uint64)
    pointer = np.full(len(data), -1, np.int64)
    _name(pointer, live, grams)
    depth = q
    while depth < length:
        step = min(depth, length - depth)
        live = live[pointer[live] >= 0]
        on = pointer[np.minimum(live + step, len(data) - 1)]
        both = on >= 0
        gone, live, on = live[~both], live[both], on[both]
        own = pointer[live]
        pointer[gone] = -1
        _name(pointer, live, (own.astype(np.uint64) << np.uint64(32)) | on.astype(np.uint64))
        depth += step
    found = pointer[starts]
    count = np.bincount(found[found >= 0]) if (found >= 0).any() else np.zeros(1, int)
    return (found >= 0) & (count[np.maximum(found, 0)] > 1)


def _name(pointer: np.ndarray, live: np.ndarray, keys: np.ndarray) -> None:
    """Sort suffixes by their keys and write each one's bucket, or -1 where it is alone."""
    if not len(live):
        return
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    bucket = np.cumsum(first) - 1
    alone = np.bincount(bucket) == 1
    pointer[live[order]] = np.where(alone[bucket], -1, bucket)


def spans(flags: np.ndarray, at: int) -> list[tuple[int, int]]:
    """First and last of each run of set flags, counted from `at`."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(at + int(a), at + int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def digest(data: bytes) -> tuple[int, int]:
    raw = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


CONTEXT = "bucket long, row long, s0 long, r0 int, d1 long, d2 long, done boolean, ctx binary"


def _contexts(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in CONTEXT.split(", ")])


def cut_contexts(texts: DataFrame, length: int) -> DataFrame:
    """Contexts of `texts` (row, t, wanted: hashes of anchors). A context that a text has twice is given once, with
    rows without `ctx` for all its places; r0 is how far the anchor lies from the first start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = [t.encode("utf-8", "surrogatepass") for t in pdf["t"]]
            wanted, ids = [np.sort(np.asarray(w, np.int64)) for w in pdf["wanted"]], pdf["row"].tolist()
            out: list[tuple] = []
            seen: dict[tuple[int, int, int, int], tuple | None] = {}
            last = -1
            for i, at, lo, hi, g in anchors(data, length):
                if i != last:
                    seen, last = {}, i
                place = np.minimum(np.searchsorted(wanted[i], g), len(wanted[i]) - 1)
                for k in np.flatnonzero(wanted[i][place] == g).tolist():
                    a, b, r0 = int(lo[k]), int(hi[k]), int(at[k] - lo[k])
                    ctx = data[i][a : b + length]
                    d = digest(ctx)
                    key = (int(g[k]), *d, r0)
                    if key in seen:
                        if (first := seen[key]) is not None:
                            out.append(first)
                            seen[key] = None
                        out.append((0, ids[i], a, b - a, 0, 0, True, None))
                        continue
                    seen[key] = (0, ids[i], a, b - a, 0, 0, True, None)
                    out.append((int(g[k]), ids[i], a, r0, *d, False, ctx))
                if len(out) > 5_000:
                    yield _contexts(out)
                    out = []
            yield _contexts(out)

    return texts.select("row", "t", "wanted").mapInPandas(run, CONTEXT)


def parted(contexts: DataFrame, width: int, length: int) -> DataFrame:
    """Contexts cut by how far the anchor lies from the start of a string, in ranges of `width`. All strings of a
    range share the bytes around the anchor that name its new bucket; at width 1 those are the whole string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for bucket, row, s0, r0, ctx, done in zip(pdf["bucket"], pdf["row"], pdf["s0"], pdf["r0"], pdf["ctx"], pdf["done"], strict=True):
                strings = len(ctx) - length + 1
                for low in range((r0 - strings + 1) // width * width, r0 + 1, width):
                    a, b = max(0, r0 - low - width + 1), min(strings - 1, r0 - low)
                    if a <= b:
                        part, shared = ctx[a : b + length], ctx[r0 - low : r0 - low - width + 1 + length]
                        out.append((digest(b"%d %d " % (bucket, low) + shared)[0], row, s0 + a, r0 - a, *digest(part), done, part))
            yield _contexts(out)

    return contexts.mapInPandas(run, CONTEXT)


def refined_within(contexts: DataFrame, length: int) -> DataFrame:
    """(row, a, b): starts of repeated strings among the contexts of each bucket; whole buckets, a few megabytes at a time."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.frombuffer(b"".join(pdf["ctx"]), np.uint8)
        size = pdf["ctx"].map(len).to_numpy(np.int64)
        base = np.concatenate(([0], np.cumsum(size)))
        strings = size - length + 1
        starts = np.repeat(base[:-1] - np.concatenate(([0], np.cumsum(strings)[:-1])), strings) + np.arange(strings.sum())
        flags = refined(data, starts, length)
        begin = np.concatenate(([0], np.cumsum(strings)))
        hit = np.flatnonzero(np.add.reduceat(flags, begin[:-1]) > 0) if len(flags) else []
        out = []
        for i, row, s0, done in zip(hit, pdf["row"].to_numpy()[hit], pdf["s0"].to_numpy()[hit], pdf["done"].to_numpy()[hit], strict=True):
            if not done:
                out += [(row, *x) for x in spans(flags[begin[i] : begin[i + 1]], int(s0))]
        return pd.DataFrame(out, columns=["row", "a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            size += int(pdf["ctx"].map(len).sum())
            if size >= BATCH and pdf["bucket"].iloc[0] != pdf["bucket"].iloc[-1]:
                whole = pd.concat(held, ignore_index=True)
                last = int(np.searchsorted(whole["bucket"].to_numpy(), whole["bucket"].iloc[-1]))
                yield one(whole.iloc[:last])
                held = [whole.iloc[last:]]
                size = int(held[0]["ctx"].map(len).sum())
        if held:
            yield one(pd.concat(held, ignore_index=True))

    return contexts.select("bucket", "row", "s0", "done", "ctx").repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, "row long, a long, b long")


def repeated_starts(contexts: DataFrame, length: int, large: int) -> DataFrame:
    """(row, a, b): runs of starts of strings that start elsewhere too."""
    contexts = written(contexts, "contexts")
    found = contexts.where("ctx is null").select("row", F.col("s0").alias("a"), (F.col("s0") + F.col("r0")).alias("b"))
    contexts, width = contexts.where("ctx is not null"), 1 << (length - length // 2).bit_length()
    while True:
        same, here = ["bucket", "r0", "d1", "d2"], F.struct("row", "s0")
        one = contexts.groupBy(*same).agg(F.min(here).alias("x"), F.max(here).alias("y"), F.max("done").alias("done"), F.any_value("ctx").alias("ctx"))
        one = written(one, "distinct")
        many = one.where("x <> y").select(*same)
        placed = maybe_in(contexts, many.select(F.xxhash64(*same).alias("k")), F.xxhash64(*same), "maybe").where("maybe and not done")
        placed = placed.join(many.hint("merge"), same, "left_semi")
        found = found.unionByName(placed.select("row", F.col("s0").alias("a"), (F.col("s0") + F.length("ctx") - length).cast("long").alias("b")))
        one = one.select("bucket", F.col("x.row").alias("row"), F.col("x.s0").alias("s0"), "r0", (F.col("done") | F.expr("x <> y")).alias("done"), "ctx")
        hot = written(one.groupBy("bucket").count().where(F.col("count") > large).select("bucket"), "hot")
        last = width == 1 or hot.isEmpty()
        found = found.unionByName(refined_within(one if last else one.join(hot, "bucket", "left_anti"), length))
        if last:
            return found
        width //= 2
        contexts = written(parted(one.join(hot, "bucket", "left_semi"), width, length), "contexts")


def text_key(col: str = "t") -> Column:
    """What tells texts apart: SHA-256, as 32 bytes."""
    return F.unhex(F.sha2(col, 256))


def verdicts(docs: DataFrame, length: int = LENGTH, large: int = LARGE) -> DataFrame:
    """(key, spans): for each text that loses bytes its SHA-256 and the spans to remove, as an array of (from, to)."""
    text_batches(docs.sparkSession)
    keyed = docs.select("doc_id", text_or_empty().alias("t")).withColumn("key", text_key())

    # only texts go to Python: ids of documents would lose digits there beside a null
    @F.pandas_udf("n long, g array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            found: list[list[np.ndarray]] = [[] for _ in data]
            for i, *_, g in anchors(data, length):
                found[i].append(g)
            yield pd.DataFrame({"n": np.array([len(x) for x in data], np.int64), "g": [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]})

    marked = keyed.select("doc_id", "key", run.asNondeterministic()("t").alias("x")).select("doc_id", "key", "x.*")
    marked = written(marked.withColumn("row", F.monotonically_increasing_id()), "anchors")
    # of equal texts one row goes on; all of a text that another row has too is removed, if it is long enough
    copies = written(marked.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("c"), F.max("n").alias("n")).where("c > 1").drop("c"), "copies")
    single = maybe_in(marked, copies.select(F.xxhash64("key").alias("k")), F.xxhash64("key"), "maybe")
    checked = single.where("maybe").drop("maybe").join(copies.select("key", "first").hint("merge"), "key", "left").where("first is null or first = row").drop("first")
    single = single.where("not maybe").drop("maybe").unionByName(checked)
    each = single.select("row", F.explode("g").alias("g"))
    common = written(each.groupBy("g").count().where("count > 1").select("g"), "common")
    wanted = maybe_in(each, common, F.col("g"), "maybe").where("maybe").select("row", "g").join(common.hint("merge"), "g", "left_semi")
    wanted = wanted.groupBy("row").agg(F.collect_set("g").alias("wanted"))
    wanted = written(wanted.join(marked.select("row", "key", "doc_id"), "row").select("row", F.col("key").alias("k2"), F.col("doc_id").alias("i2"), "wanted"), "wanted")
    texts = maybe_in(keyed, wanted.select(F.xxhash64("i2", "k2").alias("k")), F.xxhash64("doc_id", "key"), "maybe").where("maybe")
    texts = texts.join(wanted.hint("merge"), (F.col("key") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("i2")))
    starts = repeated_starts(cut_contexts(texts, length), length, large)
    starts = starts.select("row", "a", (F.col("b") + length).alias("b")).distinct()
    ordered = Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    islands = starts.withColumn("apart", F.when(F.col("a") > F.max("b").over(ordered), 1).otherwise(0))
    islands = islands.withColumn("island", F.sum("apart").over(Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("row", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    merged = merged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    parts = written(merged.join(marked.select("row", "key"), "row").select("key", "spans"), "spans")
    full = copies.where(F.col("n") >= length).select("key", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))).alias("spans"))
    return written(parts.join(full, "key", "left_anti").unionByName(full), "verdicts")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, large: int = LARGE) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and `kept`, the
    remaining bytes where some were removed (else null: the text as it is).

    A byte is removed if a string of `length` bytes covers it that also starts anywhere else, in the same
    text or another; strings never cross texts and are judged on the input. Null texts are empty; rows that
    repeat both doc_id and text are two places of one text. An empty table gives no rows; other columns are ignored.
    """
    found = verdicts(docs, length, large)
    rows = docs.select("doc_id", text_or_empty().alias("t")).withColumn("key", text_key())
    rows = maybe_in(rows, found.select(F.xxhash64("key").alias("k")), F.xxhash64("key"), "maybe")
    n = F.octet_length("t").cast("long").alias("n_bytes")
    none = F.lit(0).cast("long")
    clean = lambda df: df.select("doc_id", n, none.alias("n_removed"), none.alias("n_spans"), F.sha2("t", 256).alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))

    @F.pandas_udf("binary")
    def cut(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(texts, begins, ends, strict=True):
            data = t.encode("utf-8", "surrogatepass")
            out.append(b"".join(data[x:y] for x, y in zip([0, *b], [*a, len(data)], strict=True)))
        return pd.Series(out)

    joined = rows.where("maybe").join(found.hint("merge"), "key", "left")
    changed = joined.where("spans is not null")
    gone = F.aggregate("spans", none, lambda s, x: s + x["b"] - x["a"]).alias("n_removed")
    some = changed.select("doc_id", n, gone, F.size("spans").cast("long").alias("n_spans"), cut("t", F.col("spans.a"), F.col("spans.b")).alias("kept"))
    some = some.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "kept")
    return clean(rows.where("not maybe")).unionByName(clean(joined.where("spans is null"))).unionByName(some)
