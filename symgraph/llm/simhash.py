"""SimHash near-dedup with pivot distance tables.

A fingerprint's distances to a set of reference fingerprints (pivots) are computed once. By the triangle
inequality two fingerprints within r bits differ by at most r in every coordinate of that table, so a
pair is discarded by its greatest coordinate difference before its own distance is computed.

Which pairs are looked at: the 64 bits are dealt to six blocks; a link of at most four bits leaves two
blocks untouched, so each fingerprint goes to fifteen buckets, one for each pair of blocks, and only
rows of a bucket are compared, in order of their first pivot distance. A bucket that is still large is
dealt again by another division of the bits, so no group is compared whole. A task emits the links that join two of its groups,
not all pairs.

`one_of_each` asks for a similarity instead: 0.8 or more is up to a fifth of the bits, too many for blocks of
bits. There fingerprints are 256 bits wide, and documents meet in the buckets of their least shingle hashes: of two
that share four shingles in five, one of eight such hashes is the same but for three cases in a million. Sizes of the
shingle sets, the pivot distance table and a loose bound of bits, in this order, only pick the documents whose shingles are
compared; the similarity decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, maybe_in, text_batches, text_or_empty, written

BITS, BLOCKS, MOST_BITS, PIVOTS, LARGE, LEVELS = 64, 6, 4, 16, 8192, 4
PARTS, KEYS, SPARE = 4, 8, 6


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit SimHash over shingles of `words` words (bytes between ASCII white space, A-Z lowered)."""
    return int.from_bytes(majority(shingle_hashes(text, words), 1).tobytes(), "big")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included, as eight bytes each, greatest first."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) > words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = partial(xxhash.xxh64_digest, seed=42)
    raw = b"".join([digest(joined[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(raw, np.uint8).reshape(-1, 8)


def majority(hashes: np.ndarray, parts: int) -> np.ndarray:
    """`parts` times 64 bits, each 1 if set in over half the hashes; parts after the first are of mixed hashes."""
    out, n = [], len(hashes)
    for i in range(parts):
        counts = np.zeros(BITS, np.int64)
        for at in range(0, n, 255 * 512):
            some = hashes[at : at + 255 * 512]
            if i:
                h = some.view(">u8").ravel().astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * i & (1 << 64) - 1)
                h *= np.uint64(0xC2B2AE3D27D4EB4F)
                h ^= h >> np.uint64(31)
                h *= np.uint64(0x165667B19E3779F9)
                some = (h ^ (h >> np.uint64(32))).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(some).reshape(-1, BITS)
            whole = len(bits) // 255
            counts += bits[: whole * 255].reshape(whole, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            counts += bits[whole * 255 :].sum(axis=0, dtype=np.int64)
        out.append(np.packbits(counts * 2 > n) if n else np.zeros(8, np.uint8))
    return np.concatenate(out)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; null text has fingerprint zero."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    text_batches(docs.sparkSession)
    return docs.select("doc_id", of(text_or_empty()).alias("fp"))


def masks(level: int) -> list[int]:
    """The bits of each block of the given division, as signed longs; divisions cut across one another."""
    order = [(i * (1, 29, 37, 11)[level] + level) % BITS for i in range(BITS)]
    per = -(-BITS // BLOCKS)
    found = [sum(1 << b for b in order[i * per : (i + 1) * per]) for i in range(BLOCKS)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def pairs_of_blocks(level: int) -> list[int]:
    return [a | b for a, b in combinations(masks(level), 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivot_table(fps: DataFrame, pivots: list[int]) -> DataFrame:
    """Adds p0, p1, ...: the distances to eight pivots each, one a byte."""
    far = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p)).cast("long"))).cast("long") for p in pivots]
    packed: list[Column] = []
    for i in range(0, len(pivots), 8):
        packed.append(sum((F.shiftleft(d, 8 * j) for j, d in enumerate(far[i : i + 8])), F.lit(0).cast("long")).alias(f"p{i // 8}"))
    return fps.select("*", *packed)


def dealt(rows: DataFrame, level: int) -> DataFrame:
    """Each row to a bucket for each pair of blocks; `key` so far is kept within the new one."""
    keys = [F.xxhash64("key", F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(pairs_of_blocks(level))]
    rest = [c for c in rows.columns if c != "key"]
    return rows.select(*rest, F.explode(F.array(*keys)).alias("key"))


def links_within(pdf: pd.DataFrame, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between different groups of one sorted run of whole buckets, enough to join what is linked."""
    key, names = pdf["key"].to_numpy(), sorted(c for c in pdf.columns if c[0] == "f")
    fp = np.stack([pdf[c].to_numpy() for c in names], axis=1).view(np.uint64)
    node = pdf["node" if "node" in pdf.columns else "fp"].to_numpy()
    table = np.stack([pdf[c].to_numpy() for c in sorted(x for x in pdf.columns if x[0] == "p")], axis=1).astype("<i8").view(np.uint8).astype(np.int16)
    order = np.lexsort((node, table[:, 0], key))
    key, fp, table, node = key[order], fp[order], table[order], node[order]
    group, out_a, out_b = np.arange(len(fp)), [], []
    at, lag = np.arange(len(fp) - 1), 1
    while len(at):
        at = at[at + lag < len(fp)]
        at = at[(key[at] == key[at + lag]) & (table[at + lag, 0] - table[at, 0] <= most_bits)]
        near = at[group[at] != group[at + lag]]
        near = near[np.abs(table[near] - table[near + lag]).max(axis=1, initial=0) <= most_bits]
        near = near[np.bitwise_count(fp[near] ^ fp[near + lag]).sum(axis=1, dtype=np.int64) <= most_bits]
        if len(near):
            parent: dict[int, int] = {}

            def root(x: int, parent: dict[int, int] = parent) -> int:
                while (y := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(y, y)
                return x

            for i in near.tolist():
                a, b = root(int(group[i])), root(int(group[i + lag]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out_a.append(i)
                    out_b.append(i + lag)
            if parent:
                to = np.arange(len(group))
                to[list(parent)] = [root(x) for x in parent]
                group = to[group]
        lag += 1
    return node[out_a], node[out_b]


def compared(rows: DataFrame, most_bits: int) -> DataFrame:
    """Links (a, b) among the rows of each bucket."""

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = links_within(pdf, most_bits)
        return pd.DataFrame({"a": a, "b": b})

    return in_runs(rows, done, "a long, b long")


def in_runs(rows: DataFrame, done: Callable[[pd.DataFrame], pd.DataFrame], schema: str, least: int = 50_000) -> DataFrame:
    """What `done` makes of runs of whole buckets; memory holds `least` rows, or one bucket, and a batch."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            size += len(pdf)
            if size >= least and pdf["key"].iloc[0] != pdf["key"].iloc[-1]:
                whole = pd.concat(held, ignore_index=True)
                last = int(np.searchsorted(whole["key"].to_numpy(), whole["key"].iloc[-1]))
                yield done(whole.iloc[:last])
                held = [whole.iloc[last:]]
                size = len(held[0])
        if held:
            yield done(pd.concat(held, ignore_index=True))

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(runs, schema)


def links(fps: DataFrame, most_bits: int = MOST_BITS, pivots: int = PIVOTS, large: int = LARGE) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that join everything within `most_bits` (4 at most)."""
    if not 0 <= most_bits <= BLOCKS - 2:
        raise ValueError(f"most_bits is 0 to {BLOCKS - 2}")
    chosen = [r.fp & (1 << 64) - 1 for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(pivots).collect()]
    chosen += [0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1 for i in range(pivots - len(chosen))]
    rows = pivot_table(fps.select("fp").withColumn("key", F.lit(0).cast("long")), chosen)
    found = None
    for level in range(LEVELS):
        rows = dealt(rows, level)
        if level == LEVELS - 1:
            hot, cool = None, rows
        else:
            hot = written(rows.groupBy("key").count().where(F.col("count") > large).select("key"), "hot")
            cool = rows.join(hot, "key", "left_anti")
        some = compared(cool, most_bits)
        found = some if found is None else found.unionByName(some)
        if hot is None or hot.isEmpty():
            break
        rows = rows.join(hot, "key", "left_semi")
    return found.distinct()


def near_groups(docs: DataFrame, words: int = 4, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked when their fingerprints differ in `most_bits` bits or fewer; component_id is the
    least doc_id that can be reached, itself included (null doc_ids don't count; null if there is no
    other). Null and wordless texts have fingerprint zero and are linked like any other. Repeated rows
    give repeated results; an empty table gives none; other columns are ignored.
    """
    marked = written(fingerprints(docs, words), "fingerprints")
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(links(fps, most_bits))
    rooted = fps.join(joined, fps.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    labels = written(rooted.join(least, "root").select("fp", "component_id"), "labels")
    return marked.join(labels, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different shingle hashes, least first."""
    return np.unique(shingle_hashes(text, words).view(">u8").astype(np.uint64).ravel())


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, f0 .. f3, keys, n, whole): 256 bits of fingerprint of the set of shingles, the least eight of
    their hashes, how many shingles there are, and a hash of all of them."""

    @F.pandas_udf("f0 long, f1 long, f2 long, f3 long, keys array<long>, n int, whole long")
    def of(texts: pd.Series) -> pd.DataFrame:
        wide, keys, n, whole = [], [], [], []
        for t in texts:
            h = shingle_set(t, words)
            wide.append(majority(h.astype(">u8").view(np.uint8).reshape(-1, 8), PARTS).view(">i8").astype(np.int64))
            keys.append(h[:KEYS].view(np.int64))
            n.append(len(h))
            whole.append(signed(xxhash.xxh64_intdigest(h.tobytes())))
        out = pd.DataFrame(np.stack(wide) if wide else np.zeros((0, PARTS), np.int64), columns=[f"f{i}" for i in range(PARTS)])
        return out.assign(keys=keys, n=np.array(n, np.int32), whole=np.array(whole, np.int64))

    text_batches(docs.sparkSession)
    return docs.select("doc_id", of(text_or_empty()).alias("s")).select("doc_id", "s.*")


def bits_for(similarity: float, deviations: int = 1) -> int:
    """Most differing bits of 256 for shingle sets of a similarity, with some standard deviations more for chance."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = BITS * PARTS
    return int(n * share + deviations * math.sqrt(n * share * (1 - share)))


def pivoted(fps: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Adds p0, p1, ... to `fps` (f0 .. f3, other columns): the distances of the wide fingerprints to eight pivots each, one a byte."""
    parts = [f"f{i}" for i in range(PARTS)]
    chosen = fps.select(*parts).orderBy(F.xxhash64(*parts), *parts).limit(pivots).collect()
    table = []
    for i in range(0, max(pivots, 8), 8):
        packed = F.lit(0).cast("long")
        for j, r in enumerate(chosen[i : i + 8]):
            far = sum((F.bit_count(F.col(c).bitwiseXOR(F.lit(r[c]).cast("long"))) for c in parts), F.lit(0))
            packed = packed + F.shiftleft(F.least(far, F.lit(255)).cast("long"), 8 * j)
        table.append(packed.alias(f"p{i // 8}"))
    return fps.select("*", *table)


def similar_links(fps: DataFrame, most_bits: int, pivots: int = PIVOTS, large: int = LARGE) -> DataFrame:
    """Links (a, b) between the `node`s of `fps` (node, f0 .. f3, keys) that share a key and differ in `most_bits` at most.

    A key with very many nodes is dealt again by pairs, then triples, of a node's keys.
    """
    rows = pivoted(fps.select("node", *[f"f{i}" for i in range(PARTS)], "keys"), pivots)
    return compared(in_buckets(rows, large), most_bits).where("a <> b").distinct()


def in_buckets(fps: DataFrame, large: int = LARGE) -> DataFrame:
    """Each row of `fps` (keys, other columns) once for each bucket that it is in, as `key` in place of `keys`.

    Rows with fewer keys than a bucket takes have all their shingles among them: only an equal set is similar to one of two.
    """
    own = [c for c in fps.columns if c != "keys"]
    rows, found = fps.withColumn("path", F.array().cast("array<long>")), None
    for level in range(3):
        rows = rows.withColumn("more", F.explode(F.array_except("keys", "path")))
        rows = rows.withColumn("path", F.array_sort(F.array_append("path", F.col("more")))).drop("more").withColumn("key", F.xxhash64("path"))
        if level < 2:
            hot = written(rows.groupBy("key").count().where(F.col("count") > large).select("key"), "hot")
            cool = rows.join(hot, "key", "left_anti")
        else:
            hot, cool = None, rows
        some = cool.select(*own, "key")
        found = some if found is None else found.unionByName(some)
        if hot is None or hot.isEmpty():
            break
        rows = rows.join(hot, "key", "left_semi").drop("key")
    return found


def pairs_of_size(key: np.ndarray, n: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a bucket, in order of (key, n), whose sizes allow the similarity."""
    at, lag = np.arange(len(n) - 1), 1
    while len(at):
        at = at[at + lag < len(n)]
        at = at[(key[at] == key[at + lag]) & (n[at] >= similarity * n[at + lag] - 1e-6)]
        yield at, at + lag
        lag += 1


def ordered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows in order of (key, n), their fingerprints and their distances to the pivots."""
    pdf = pdf.sort_values(["key", "n", "node"], ignore_index=True)
    packed = np.stack([pdf[c].to_numpy() for c in sorted(x for x in pdf.columns if x[0] == "p")], axis=1)
    return pdf, np.stack([pdf[f"f{i}"].to_numpy() for i in range(PARTS)], axis=1).view(np.uint64), packed.astype("<i8").view(np.uint8).astype(np.int16)


def near_bits(fp: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, most_bits: int) -> np.ndarray:
    """Which pairs of rows differ in `most_bits` at most: by the greatest difference of their distances to a pivot, then by their own distance."""
    near = np.abs(table[a] - table[b]).max(axis=1, initial=0) <= most_bits
    near[near] = np.bitwise_count(fp[a[near]] ^ fp[b[near]]).sum(axis=1, dtype=np.int64) <= most_bits
    return near


def maybe_similar(pdf: pd.DataFrame, most_bits: int, similarity: float) -> pd.DataFrame:
    """The rows that may be similar to another of their bucket, by size, pivots and bits."""
    pdf, fp, table = ordered(pdf)
    met = np.zeros(len(pdf), bool)
    for a, b in pairs_of_size(pdf["key"].to_numpy(), pdf["n"].to_numpy(), similarity):
        new = ~(met[a] & met[b])
        a, b = a[new], b[new]
        near = near_bits(fp, table, a, b, most_bits)
        met[a[near]] = met[b[near]] = True
    return pdf[met]


def similar_within(pdf: pd.DataFrame, most_bits: int, similarity: float) -> pd.DataFrame:
    """Links (a, b) that join what is similar in each bucket, by the shingles `h` themselves."""
    pdf, fp, table = ordered(pdf)
    n, node, sets = pdf["n"].to_numpy(), pdf["node"].to_numpy(), [np.asarray(h) for h in pdf["h"]]
    parent, group, out = list(range(len(pdf))), np.arange(len(pdf)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs_of_size(pdf["key"].to_numpy(), n, similarity):
        apart = group[a] != group[b]
        a, b = a[apart], b[apart]
        near = near_bits(fp, table, a, b, most_bits)
        before = len(out)
        for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
            x, y = root(i), root(j)
            if x != y:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (n[i] + n[j] - both) - 1e-6:
                    parent[max(x, y)] = min(x, y)
                    out.append((node[i], node[j]))
        if len(out) > before:
            group = np.array([root(x) for x in range(len(pdf))])
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def verified_links(docs: DataFrame, fps: DataFrame, words: int, similarity: float, large: int = LARGE) -> DataFrame:
    """Links (a, b) that join the `node`s of `fps` (node, f0 .. f3, keys, n, whole) whose shingle sets are as similar or more.

    Distances to the pivots are computed once for each node. Shingles are made again from the texts of `docs` (doc_id, text),
    only where size, pivots and bits leave a pair possible.
    """
    parts, most_bits = [f"f{i}" for i in range(PARTS)], bits_for(similarity, SPARE)
    far = written(pivoted(fps.select("node", *parts, "n", "whole", "keys")), "pivots")
    held = [c for c in far.columns if c != "keys"]
    kinds = ", ".join(f"{c} {'int' if c == 'n' else 'long'}" for c in [*held, "key"])
    some = written(in_runs(in_buckets(far, large).select(*held, "key"), lambda pdf: maybe_similar(pdf, most_bits, similarity), kinds), "maybe")
    wanted = some.select("node", "whole").distinct()

    @F.pandas_udf("h array<long>, own long")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, words) for t in texts]
        return pd.DataFrame({"h": [h.view(np.int64) for h in sets], "own": np.array([signed(xxhash.xxh64_intdigest(h.tobytes())) for h in sets], np.int64)})

    texts = maybe_in(docs.select("doc_id", text_or_empty().alias("t")), wanted.select(F.xxhash64("node").alias("k")), F.xxhash64("doc_id"), "__maybe").where("__maybe")
    texts = texts.join(wanted.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    made = texts.select("doc_id", of("t").alias("s")).select(F.col("doc_id").alias("node"), F.col("s.own").alias("whole"), "s.h")
    sets = written(made.dropDuplicates(["node", "whole"]), "sets")
    return in_runs(some.join(sets.hint("merge"), ["node", "whole"]), lambda pdf: similar_within(pdf, most_bits, similarity), "a long, b long", 1000).where("a <> b").distinct()


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` (doc_id, text, any other columns) with one document of each group of near copies: the least doc_id.

    Near copies have shingle sets of `similarity` (Jaccard) or more, verified by the sets; groups are what such
    links connect, and equal sets, those of all wordless texts among them. Rows without a doc_id stay, since they
    can't be told apart; so do all rows that repeat a doc_id that stays. An empty table gives no rows.
    Only documents that go are joined to the texts, by way of a bitmap of bounded size.
    """
    parts = [*(f"f{i}" for i in range(PARTS)), "n", "whole"]
    known = docs.where("doc_id is not null")
    marked = written(sketches(known, words), "sketches")
    fps = written(marked.groupBy(*parts).agg(F.min("doc_id").alias("node"), F.min("keys").alias("keys")), "wide")
    joined = components(verified_links(known, fps, words, similarity)).where("node <> root").select("node")
    same = marked.join(fps.select(*parts, "node").hint("merge"), parts).where("doc_id <> node").select("doc_id")
    gone = written(same.unionByName(joined.select(F.col("node").alias("doc_id"))).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    marked = maybe_in(docs, gone.select(F.xxhash64("__gone").alias("k")), F.xxhash64("doc_id"), "__maybe")
    some = marked.where("__maybe").join(gone.hint("merge"), F.col("doc_id") == F.col("__gone"), "left_anti")
    return marked.where("not __maybe").unionByName(some).drop("__maybe")
