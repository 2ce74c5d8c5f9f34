"""Benchmark decontamination by the q-gram lemma.

A passage of L characters that is found with at most e edits still shares L - q + 1 - q * e of its q-grams
with the place, all on diagonals at most e apart. So the q-grams that a document shares with a passage are
counted in diagonal bands that overlap by half, a band with fewer than that bound is dropped, and the rest,
once the same bound holds for shorter q-grams, are verified by an alignment within the band.

Texts are compared in lower case with every run of other than letters and digits as one space. A
benchmark item is one passage, or, if it is long, windows of it, so that a part that leaked is found too: any stretch of
`WINDOW + STEP - 1` characters of such an item holds a whole window. An item that is edited within the rate as a whole has a
window that is, unless its edits all but fill it and it has few windows; where that can be, the item is a passage too.
Passages too short for the bound over grams of eight characters are searched by shorter grams.
The benchmark is taken in blocks of bounded size, each of which is searched in all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, text_or_empty, written

Q, RATE, WINDOW, STEP, BLOCK_CHARS, PIECE, CELLS = 8, 0.1, 160, 40, 4 << 20, 1 << 20, 1 << 21
_BITS, _SLOTS = 22, 18


@lru_cache(1)
def plain_codes() -> np.ndarray:
    """For each code point its lower case if that is a letter or digit, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def squeezed(text: str, after: bool, base: int = 0) -> tuple[np.ndarray, np.ndarray, bool]:
    """Codes with 32 for each run of other characters, each code's offset (from `base`), and whether the last character has
    a code. `after`: whether the one before `text` had; a run that goes on, or begins a text, is no space."""
    codes = plain_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = codes > 0
    end = bool(keep[-1]) if len(keep) else after
    keep[1:] |= codes[:-1] > 0
    if after:
        keep[:1] = True
    at = np.flatnonzero(keep)
    codes = codes[at]
    codes[codes == 0] = 32
    return codes, at + base, end


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes with 32 for each inner run of other characters, and each code's offset in `text`."""
    codes, at, end = squeezed(text, False)
    return (codes, at) if end or not len(codes) else (codes[:-1], at[:-1])


def normal_pieces(text: str, lap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`normal` of a text, or of pieces of a very long one, of which neighbours share `lap` codes, however much lies between them."""
    if len(text) <= PIECE:
        yield normal(text)
        return
    held, after = (np.zeros(0, np.uint32), np.zeros(0, np.int64)), False
    for base in range(0, len(text), PIECE):
        codes, at, after = squeezed(text[base : base + PIECE], after, base)
        held = np.concatenate((held[0], codes)), np.concatenate((held[1], at))
        yield held
        held = held[0][len(held[0]) - min(lap, len(held[0])) :], held[1][len(held[1]) - min(lap, len(held[1])) :]


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    h, c = np.zeros(len(codes) - q + 1, np.uint64), codes.astype(np.uint64)
    for j in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : j + len(h)] + np.uint64(1)
    return h ^ (h >> np.uint64(29))


@dataclass
class Passages:
    """Passages of a block of benchmark items, and an index of their grams of `q` characters."""

    q: int
    items: list
    codes: list[np.ndarray]
    edits: np.ndarray
    needed: np.ndarray
    grams: np.ndarray
    begin: np.ndarray
    of: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    slot: np.ndarray


def passages(items: list[tuple[Any, str]], q: int = Q, rate: float = RATE, window: int = WINDOW, step: int = STEP) -> list[Passages]:
    """The passages of `items`, in one index for those that bear grams of `q` characters and one for those that need shorter ones."""
    found: dict[bool, list[tuple[Any, np.ndarray, int]]] = {True: [], False: []}
    for item, text in items:
        c = normal(text or "")[0]
        n = len(c)
        if n < q:
            continue
        own = [c]
        if n > window + step // 2:
            own = [c[s : s + window] for s in [*range(0, n - window, step), n - window]]
            # whole windows one after another, each with an edit too many, would be over the rate of the item
            if int(n * rate) >= n // window * (int(window * rate) + 1):
                own.append(c)
        for x in own:
            e = int(len(x) * rate)
            found[q * (e + 1) <= len(x)].append((item, x, e))
    least = min((len(x) // (e + 1) for _, x, e in found[False]), default=q)
    return [indexed(rows, g) for rows, g in ((found[True], q), (found[False], max(1, least))) if rows]


def indexed(rows: list[tuple[Any, np.ndarray, int]], q: int) -> Passages:
    codes, edits = [c for _, c, _ in rows], np.array([e for *_, e in rows], np.int64)
    size = np.array([len(c) for c in codes], np.int64)
    hashes = [gram_hashes(c, q) for c in codes]
    grams = np.concatenate(hashes)
    of = np.repeat(np.arange(len(codes)), [len(h) for h in hashes])
    place = np.concatenate([np.arange(len(h)) for h in hashes])
    order = np.argsort(grams, kind="stable")
    unique, begin = np.unique(grams[order], return_index=True)
    seen = np.zeros(1 << _BITS, bool)
    seen[(grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    slot = np.searchsorted(unique, np.arange(1 << _SLOTS, dtype=np.uint64) << np.uint64(64 - _SLOTS))
    return Passages(q, [i for i, *_ in rows], codes, edits, size - q + 1 - q * edits, unique, np.append(begin, len(grams)), of[order], place[order], seen, slot)


def bands(codes: np.ndarray, p: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Passage and first diagonal of each band, 2 * (edits + 1) wide, with as many shared q-grams as its bound."""
    h = gram_hashes(codes, p.q)
    x = np.flatnonzero(p.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hx, end = h[x], len(p.grams) - 1
    at = np.minimum(p.slot[(hx >> np.uint64(64 - _SLOTS)).astype(np.int64)], end)
    less = np.flatnonzero(p.grams[at] < hx)
    while len(less):  # few grams share a slot
        at[less] += 1
        less = less[at[less] <= end]
        less = less[p.grams[at[less]] < hx[less]]
    at = np.minimum(at, end)
    known = p.grams[at] == hx
    x, at = x[known], at[known]
    low, n = p.begin[at], p.begin[at + 1] - p.begin[at]
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    of = p.of[hit]
    width = p.edits[of] + 1
    band = (np.repeat(x, n) - p.place[hit]) // width
    key = (of << 40) + band + (1 << 24)
    key = np.sort(np.concatenate((key, key - 1)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    of = key >> 40
    good = count >= p.needed[of]
    key, of = key[good], of[good]
    return of, ((key & (1 << 40) - 1) - (1 << 24)) * (p.edits[of] + 1)


def likely(text: np.ndarray, p: Passages, of: np.ndarray, first: np.ndarray, q: int = 4) -> np.ndarray:
    """Which bands also meet the bound for shorter q-grams, counted in the whole stretch of text that the band spans."""
    h = (gram_hashes(text, q) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.array([len(c) for c in p.codes], np.int64)[of]
    begin, end = np.clip(first, 0, len(h)), np.clip(first + size + 2 * (p.edits[of] + 1), 0, len(h))
    n = np.maximum(end - begin, 0)
    row = np.arange(len(of)) << 32
    there = np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    there = np.unique(h[there] + np.repeat(row, n))
    own = {i: (gram_hashes(p.codes[i], q) & np.uint64(0xFFFFFFFF)).astype(np.int64) for i in np.unique(of)}
    grams = np.concatenate([own[i] + r for i, r in zip(of, row, strict=True)])
    at = np.minimum(np.searchsorted(there, grams), max(len(there) - 1, 0))
    kept = np.concatenate(([0], np.cumsum(there[at] == grams))) if len(there) else np.zeros(len(grams) + 1, int)
    ends = np.cumsum(size - q + 1)
    return kept[ends] - kept[ends - (size - q + 1)] >= size - q + 1 - q * p.edits[of]


def aligned(text: np.ndarray, patterns: np.ndarray, sizes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits with which each pattern (the first of `sizes` codes of a row) meets a stretch of `text` on the
    `width` diagonals from its `first`, and that stretch: (edits, start, end). One step a character, all at once."""
    n, far = len(first), np.int32(1 << 20)
    step = np.arange(width, dtype=np.int32)
    padded = np.concatenate((np.zeros(1, text.dtype), text, np.zeros(1, text.dtype)))
    place = first[:, None] + step
    cost = np.where((place >= 0) & (place <= len(text)), np.int32(0), far)
    begin = np.broadcast_to(step, (n, width)).copy()
    edge = np.full((n, 1), far, np.int32)
    rows = np.arange(n)
    out = np.full(n, far), first.copy(), first.copy()
    for y in range(int(sizes.max(initial=0)) + 1):
        done = np.flatnonzero(sizes == y)
        if len(done):
            best = cost[done].argmin(axis=1)
            out[0][done], out[1][done], out[2][done] = cost[done, best], first[done] + begin[done, best], first[done] + best + y
        if y == patterns.shape[1]:
            break
        here = padded[np.clip(place + (y + 1), 0, len(text) + 1)]
        keep = cost + np.where(here == 0, far, here != patterns[:, y, None]).astype(np.int32)
        drop = np.concatenate((cost[:, 1:] + 1, edge), axis=1)
        take = drop < keep
        now = np.where(take, drop, keep)
        origin = np.where(take, np.concatenate((begin[:, 1:], begin[:, -1:]), axis=1), begin)
        # insertions: the best of all places to the left, one edit a step
        moved = now - step
        run = np.minimum.accumulate(moved, axis=1)
        at = np.maximum.accumulate(np.where(moved == run, step, 0), axis=1)
        begin = origin[rows[:, None], at]
        cost = np.minimum(run + step, far)
    return out


def hits(texts: list[tuple[np.ndarray, np.ndarray]], p: Passages) -> list[tuple[int, Any, int, int, int]]:
    """(number of the text, item, edits, start, end) of the best place of each item in each text, given as `normal` does."""
    gap = int(p.edits.max(initial=0)) + 1  # wider than any alignment may skip
    parts, starts, size = [], [], 0
    for codes, _ in texts:
        parts += [codes, np.zeros(gap, np.uint32)]
        starts.append(size)
        size += len(codes) + gap
    joined, begins = np.concatenate(parts), np.array(starts)
    of, first = bands(joined, p)
    if len(of):
        good = likely(joined, p, of, first)
        of, first = of[good], first[good]
    found: dict[tuple[int, Any], tuple[int, int, int]] = {}
    sizes = np.array([len(p.codes[i]) for i in of], np.int64)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):  # alignments of like size together, of a bounded number of cells
        width = 4 * int(p.edits[of[order[at]]]) + 3
        some = order[at : at + min(1024, max(1, CELLS // width))]
        some = some[sizes[some] <= max(64, 2 * sizes[some[0]])]
        at += len(some)
        patterns = np.zeros((len(some), int(sizes[some[-1]])), np.uint32)
        for row, i in enumerate(of[some]):
            patterns[row, : sizes[some[row]]] = p.codes[i]
        edits, a, b = aligned(joined, patterns, sizes[some], first[some] - p.edits[of[some]], 4 * int(p.edits[of[some]].max()) + 3)
        good = np.flatnonzero((edits <= p.edits[of[some]]) & (b > a))
        doc = np.searchsorted(begins, a[good], side="right") - 1
        for i, d in zip(good.tolist(), doc.tolist(), strict=True):
            at_, base = texts[d][1], begins[d]
            one = (int(edits[i]), int(at_[a[i] - base]), int(at_[b[i] - 1 - base]) + 1)
            key = (d, p.items[of[some[i]]])
            if key not in found or one < found[key]:
                found[key] = one
    return [(*key, *x) for key, x in found.items()]


def pieces(texts: list[str], lap: int) -> Iterator[tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]]:
    """Runs of about `PIECE` codes: number of the text, and its codes and their offsets; very long texts come in pieces."""
    numbers, held, size = [], [], 0
    for i, t in enumerate(texts):
        for codes, at in normal_pieces(t, lap):
            if size and size + len(codes) > PIECE + lap:
                yield numbers, held
                numbers, held, size = [], [], 0
            numbers.append(i)
            held.append((codes, at))
            size += len(codes)
    if held:
        yield numbers, held


def found_in(texts: list[str], ps: list[Passages]) -> list[tuple[int, Any, int, int, int]]:
    """(number of the text, item, edits, start, end) of the best place of each item in each text, of any length."""
    best: dict[tuple[int, Any], tuple[int, int, int]] = {}
    if ps:
        lap = max(len(c) + int(e) for p in ps for c, e in zip(p.codes, p.edits, strict=True)) + 1
        for numbers, held in pieces(texts, lap):
            for p in ps:
                for i, item, *one in hits(held, p):
                    key = (numbers[i], item)
                    if key not in best or tuple(one) < best[key]:
                        best[key] = tuple(one)
    return [(*key, *x) for key, x in sorted(best.items())]


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[Any, str]]]:
    """The benchmark's items in blocks of about `most` characters; no more than one block is on the driver."""
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // most))
    dealt = rows if parts == 1 else written(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "benchmark")
    for part in range(parts):
        own = dealt if parts == 1 else dealt.where(F.col("part") == part)
        yield [(r["item_id"], r["text"]) for r in own.select("item_id", "text").orderBy("item_id", "text").collect()]


def _clean(ps: list[Passages]):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        out = np.ones(len(texts), bool)
        out[[x[0] for x in found_in(texts.tolist(), ps)]] = False
        return pd.Series(out)

    return clean.asNondeterministic()


def _places(ps: list[Passages], item: str):
    """What is found in each text. Only texts go to Python: ids of documents would lose digits there beside a null."""

    @F.pandas_udf(f"item_id array<{item}>, edits array<long>, start array<long>, end array<long>")
    def places(texts: pd.Series) -> pd.DataFrame:
        out: list[list[list]] = [[[], [], [], []] for _ in range(len(texts))]
        for i, *one in found_in(texts.tolist(), ps):
            for column, x in zip(out[i], one, strict=True):
                column.append(x)
        return pd.DataFrame(out, columns=["item_id", "edits", "start", "end"])

    return places.asNondeterministic()


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """`docs` (text, any other columns) without the rows in which a benchmark item is found, see `leaks`.

    Each row is judged by its own text, so nothing is shuffled. Null texts stay; an empty benchmark keeps all.
    """
    rows = docs
    text_batches(docs.sparkSession)
    for block in blocks(benchmark):
        rows = rows.where(_clean(passages(block, rate=rate))(text_or_empty()))
    return rows


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, key: str = "doc_id") -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, edits, start, end.

    `docs` (doc_id, text), `benchmark` (item_id, text). A passage counts with at most `rate` of its characters
    edited; passages are whole items, or windows of long ones: a verbatim part of `WINDOW + STEP - 1` characters of a long item is
    always found, a shorter part or one of a short item need not be. start, end: characters of the text. Items with fewer than
    eight letters, digits and inner spaces, null items and null texts match nothing; empty tables give no rows; of repeated items
    and rows each is reported once; other columns are ignored. `key` names another column to carry for doc_id.
    """
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty().alias("t"))
    kind = benchmark.schema["item_id"].dataType.simpleString()
    found = None
    text_batches(docs.sparkSession)
    for block in blocks(benchmark):
        some = rows.select("doc_id", _places(passages(block, rate=rate), kind)("t").alias("x")).where(F.size("x.edits") > 0)
        some = some.select("doc_id", F.explode(F.arrays_zip("x.item_id", "x.edits", "x.start", "x.end")).alias("m")).select("doc_id", "m.*")
        found = some if found is None else found.unionByName(some)
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start", "end")).alias("m")).select("doc_id", "item_id", "m.edits", "m.start", "m.end")
