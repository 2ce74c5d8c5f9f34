"""Toxicity scores by a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first four and five letters.
Filters of several widths run over the words, the greatest answer of each filter over the whole text is
kept, and a logistic layer joins them. The threshold is calibrated for each language, where the language
is guessed from the text alone (word endings), and the score is shifted so that it is 0.5 there.

Learned from every labelled row and whole texts: words are counted over all of them, thresholds are set on a quarter of them, and
filters and embeddings are trained on the rest, dealt to shards. In each round every shard goes on from the same model, and the
models are averaged, an embedding over the shards that have moved it. Sums are of whole numbers, so the model does not depend on
how tasks are dealt or in what order they end. Scoring reads whole texts, a run of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_of_id, maybe_in, text_batches, text_or_empty, written
from .words import Words, after_words, chunks, edge, whole, word_cuts, words_of

SLOTS, DIM, FILTERS, WIDTHS, ENDINGS = 1 << 16, 12, 12, (1, 2, 3), 1 << 12
POSITIVE, NEGATIVE, WINDOW, PIECE = 1500, 3000, 20_000, 1 << 20
#: Texts of a shard, of a step, words looked at together, and what a unit of a sum and of a score is divided into.
SHARD, STEP, TOGETHER, UNIT, BINS, LEAST = 4096, 64, 1 << 16, 1 << 36, 1024, 15


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    languages: list[str] = field(default_factory=list)
    endings: np.ndarray | None = None
    thresholds: np.ndarray | None = None


@dataclass
class Moved:
    """Sums of squared gradients: of each slot, and of filters, bias, `out` and `out_bias`."""

    table: np.ndarray
    rest: list[np.ndarray]


def slots_of(w: Words) -> np.ndarray:
    """Three slots of each word."""
    return np.stack([h & np.uint32(SLOTS - 1) for h in (whole(w), edge(w, 4, False), edge(w, 5, False))], axis=1)


def laid_out(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with room after each text for the widest filter: each word's row, each text's first row, its number of windows."""
    sizes = np.diff(w.first)
    blocks = np.maximum(sizes, 1) + max(WIDTHS) - 1
    begin = np.concatenate(([0], np.cumsum(blocks)))[:-1]
    rows = np.arange(len(w.starts)) - np.repeat(w.first[:-1], sizes) + np.repeat(begin, sizes)
    return rows, begin, np.maximum(sizes, 1)


def vectors(slots: np.ndarray, rows: np.ndarray, n: int, m: Model) -> np.ndarray:
    x = np.zeros((n, m.table.shape[1]), np.float32)
    if len(slots):
        x[rows] = m.table[slots[:, 0]] + m.table[slots[:, 1]] + m.table[slots[:, 2]]
    return x


def answers(x: np.ndarray, m: Model) -> list[np.ndarray]:
    """Each width's filters at each row, before pooling."""
    found = []
    for i, f in enumerate(m.filters):
        z = np.repeat(m.bias[i][None], len(x), axis=0)
        for j in range(len(f)):
            z[: len(x) - j] += x[j:] @ f[j]
        found.append(z)
    return found


def pooled(z: np.ndarray, begin: np.ndarray, windows: np.ndarray) -> np.ndarray:
    at = np.stack([begin, begin + windows], axis=1).ravel()
    return np.maximum.reduceat(z, at, axis=0)[::2]


def tops(w: Words, m: Model, windows: np.ndarray | None = None) -> np.ndarray:
    """The greatest answer of each filter over each text, or over its first `windows` words."""
    rows, begin, every = laid_out(w)
    n = int(begin[-1] + every[-1] + max(WIDTHS) - 1) if len(begin) else 0
    windows = every if windows is None else windows
    return np.concatenate([pooled(z, begin, windows) for z in answers(vectors(slots_of(w), rows, n, m), m)], axis=1)


def joined(h: np.ndarray, m: Model) -> np.ndarray:
    return np.maximum(h, 0) @ m.out + m.out_bias


def raw_scores(w: Words, m: Model) -> np.ndarray:
    return joined(tops(w, m), m) if len(w.first) > 1 else np.zeros(0, np.float32)


def ending_sums(w: Words, m: Model) -> np.ndarray:
    """For each text how much its word endings speak for each language."""
    h = edge(w, 3, True) & np.uint32(ENDINGS - 1)
    total = np.concatenate((np.zeros((1, m.endings.shape[1])), np.cumsum(m.endings[h], axis=0, dtype=np.float64)))
    return total[w.first[1:]] - total[w.first[:-1]]


def guessed(w: Words, m: Model) -> np.ndarray:
    """Number of the likeliest language of each text."""
    return ending_sums(w, m).argmax(axis=1)


def score_long(text: str, m: Model) -> np.ndarray:
    """The raw score, less its threshold, of a very long text: piece by piece, each with the words that its last windows need."""
    cuts, best, speaks = word_cuts(text, PIECE), None, 0.0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = words_of([text[a:b]])
        n = len(own.starts)
        if n or b == len(text) and best is None:
            here = tops(words_of([text[a : after_words(text, b, max(WIDTHS) - 1)]]), m, np.array([max(n, 1)]))
            best = here if best is None else np.maximum(best, here)
        speaks = speaks + ending_sums(own, m)
    return joined(best, m) - m.thresholds[np.argmax(speaks, axis=1)]


def score_texts(texts: list[str], m: Model) -> np.ndarray:
    out = []
    for a, b in chunks(texts):
        if b - a == 1 and len(texts[a]) > PIECE:
            s = score_long(texts[a], m)
        else:
            w = words_of(texts[a:b])
            s = raw_scores(w, m) - m.thresholds[guessed(w, m)]
        out.append(1 / (1 + np.exp(-np.clip(s, -30, 30).astype(np.float64))))
    return np.concatenate(out) if out else np.zeros(0)


def peaks(docs: list[np.ndarray], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each text, given as the slots of its words, the greatest answer of each filter and at which word it is."""
    more, n = max(WIDTHS) - 1, FILTERS * len(WIDTHS)
    top, where = np.full((len(docs), n), -np.inf, np.float32), np.zeros((len(docs), n), np.int64)
    pieces = [(j, a) for j, d in enumerate(docs) for a in range(0, max(len(d), 1), TOGETHER)]
    at = 0
    while at < len(pieces):
        begin, sizes, blocks, run = [], [], [], 0
        first = at
        while at < len(pieces) and (not run or run + len(docs[pieces[at][0]]) <= TOGETHER):
            j, a = pieces[at]
            own = docs[j][a : a + TOGETHER + more]
            begin.append(run)
            sizes.append(max(1, min(len(docs[j]) - a, TOGETHER)))
            blocks.append(own)
            run += max(len(own), sizes[-1]) + more
            at += 1
        x = np.zeros((run, m.table.shape[1]), np.float32)
        for b, own in zip(begin, blocks, strict=True):
            x[b : b + len(own)] = m.table[own].sum(axis=1)
        zs = answers(x, m)
        for i, (b, size) in enumerate(zip(begin, sizes, strict=True)):
            j, a = pieces[first + i]
            for k, z in enumerate(zs):
                here, cols = z[b : b + size], slice(k * FILTERS, (k + 1) * FILTERS)
                best = here.argmax(axis=0)
                value = here[best, np.arange(FILTERS)]
                new = value > top[j, cols]
                top[j, cols] = np.where(new, value, top[j, cols])
                where[j, cols] = np.where(new, best + a, where[j, cols])
    return top, where


def blank(rng: np.random.Generator) -> Model:
    return Model(
        rng.normal(0, 0.05, (SLOTS, DIM)).astype(np.float32),
        [rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS],
        np.zeros((len(WIDTHS), FILTERS), np.float32), rng.normal(0.3, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
    )


def primed(m: Model, seen: np.ndarray, n0: int, n1: int) -> Moved:
    """Let the first dimension start from how much more often a slot is seen in toxic texts."""
    odds = np.log((seen[1] + 0.3) / (n1 + 1)) - np.log((seen[0] + 0.3) / (n0 + 1))
    m.table[:, 0] = np.where(seen.sum(axis=0) > 0, odds.clip(-3, 6) / 3, 0)
    for f in m.filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3
    return Moved(np.full(SLOTS, 1e-2), [np.full(v.shape, 1e-2) for v in dense(m)])


def dense(m: Model) -> list[np.ndarray]:
    return [*m.filters, m.bias, m.out, np.array([m.out_bias])]


def put(m: Model, parts: list[np.ndarray]) -> None:
    m.filters, m.bias, m.out, m.out_bias = [f.astype(np.float32) for f in parts[:-3]], parts[-3].astype(np.float32), parts[-2].astype(np.float32), float(parts[-1][0])


def descend(m: Model, moved: Moved, docs: list[np.ndarray], y: np.ndarray, balance: float, step: float) -> None:
    """One step over a few texts; toxic ones weigh `balance`."""
    top, where = peaks(docs, m)
    pad = np.full((max(WIDTHS), 3), -1)
    flat = np.concatenate([part for d in docs for part in (d.astype(np.int64), pad)])
    begin = np.concatenate(([0], np.cumsum([len(d) + len(pad) for d in docs])))[:-1]
    h = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias, -60, 60)))
    g = (p - y) * np.where(y == 1, balance, 1) / len(docs)
    gh = g[:, None] * m.out[None] * (h > 0)
    grads, biases, touched, moves = [], [], [], []
    for i, f in enumerate(m.filters):
        gz = gh[:, i * FILTERS : (i + 1) * FILTERS]
        best = begin[:, None] + where[:, i * FILTERS : (i + 1) * FILTERS]
        grad_f = np.empty(f.shape)
        for j in range(len(f)):
            s = flat[best + j]
            xs = m.table[s].sum(axis=2) * (s[:, :, :1] >= 0)[:, :, 0, None]
            grad_f[j] = np.einsum("bfd,bf->df", xs, gz)
            touched.append(s.reshape(-1, 3))
            moves.append((f[j].T[None] * gz[:, :, None]).reshape(-1, DIM))
        grads.append(grad_f)
        biases.append(gz.sum(axis=0))
    grads += [np.stack(biases), h.T @ g + 1e-4 * m.out, np.array([g.sum()])]
    touched, moves = np.concatenate(touched), np.concatenate(moves)
    some = (touched[:, 0] >= 0) & moves.any(axis=1)
    ids, inverse = np.unique(touched[some].ravel(), return_inverse=True)
    grad_t = np.zeros((len(ids), DIM))
    np.add.at(grad_t, inverse, np.repeat(moves[some], 3, axis=0))
    moved.table[ids] += (grad_t**2).mean(axis=1)
    m.table[ids] -= (step * grad_t / np.sqrt(moved.table[ids])[:, None]).astype(np.float32)
    for sums, d in zip(moved.rest, grads, strict=True):
        sums += d**2
    put(m, [v - step * d / np.sqrt(sums) for v, d, sums in zip(dense(m), grads, moved.rest, strict=True)])


def fit(texts: list[str], toxic: list[int], langs: list[str | None], weight: float = 1.0, rounds: int = 5, rate: float = 0.05, seed: int = 11) -> Model:
    """The model of a few texts, in memory. `weight`: how many rows each non-toxic text stands for, when thresholds are set."""
    rng, y = np.random.default_rng(seed), np.array(toxic, np.float32)
    m = blank(rng)
    m.languages = sorted({g or "" for g in langs} or {""})
    m.endings = np.ones((ENDINGS, len(m.languages)))
    m.thresholds = np.zeros(len(m.languages))
    every = [words_of([t]) for t in texts]
    slots = [slots_of(w) for w in every]
    for w, g in zip(every, langs, strict=True):
        np.add.at(m.endings[:, m.languages.index(g or "")], edge(w, 3, True) & np.uint32(ENDINGS - 1), 1)
    m.endings = np.log(m.endings / m.endings.sum(axis=0))
    if not 0 < y.sum() < len(y):
        return constant(m, len(y) > 0 and bool(y.all()))
    learn = rng.random(len(y)) < 0.75
    seen = np.zeros((2, SLOTS))
    for i in np.flatnonzero(learn):
        seen[int(y[i])][np.unique(slots[i])] += 1
    n1, n0 = (y[learn] == 1).sum(), (y[learn] == 0).sum()
    moved = primed(m, seen, n0, n1)
    for turn in range(rounds):
        for batch in np.array_split(rng.permutation(np.flatnonzero(learn)), max(1, int(learn.sum()) // STEP)):
            descend(m, moved, [slots[i] for i in batch], y[batch], n0 / n1, rate / (1 + turn / 4))
    check = np.flatnonzero(~learn)
    if len(check):
        w = words_of([texts[i] for i in check])
        set_thresholds(m, raw_scores(w, m), guessed(w, m), y[check], np.where(y[check] == 1, 1.0, weight), np.ones(len(check)))
    return m


def constant(m: Model, toxic: bool) -> Model:
    m.out[:] = 0
    m.out_bias = 3.0 if toxic else -3.0
    return m


def set_thresholds(m: Model, s: np.ndarray, lang: np.ndarray, truth: np.ndarray, worth: np.ndarray, count: np.ndarray) -> None:
    """Of scores that stand for `count` texts each: one threshold for all, and one for each language with enough of both kinds."""
    if not (truth == 1).any() or not (truth == 0).any():
        return
    m.thresholds[:] = threshold(s, truth, worth)
    for g in range(len(m.languages)):
        own = lang == g
        if min(count[own & (truth == 1)].sum(), count[own & (truth == 0)].sum()) >= LEAST:
            m.thresholds[g] = threshold(s[own], truth[own], worth[own])


def threshold(s: np.ndarray, truth: np.ndarray, worth: np.ndarray) -> float:
    """Midway between the two scores where F1 is greatest."""
    order = np.argsort(-s, kind="stable")
    s, hit, false = s[order], np.cumsum(truth[order] * worth[order]), np.cumsum((1 - truth[order]) * worth[order])
    f1 = np.where(np.append(s[1:] != s[:-1], True), 2 * hit / (hit + false + hit[-1]), -1)  # equal scores stay together
    i = int(f1.argmax())
    return float((s[i] + s[min(i + 1, len(s) - 1)]) / 2)


def sample(docs: DataFrame, labels: DataFrame, learn: Column, positive: int = POSITIVE, negative: int = NEGATIVE, window: int = WINDOW):
    """(texts, toxic, langs, weight) of a bounded sample of labelled rows that satisfy `learn` (over doc_id), for trials by `fit`: `score` takes all.

    Of several texts of one doc_id the least is taken; of one longer than `window` characters a window of as many, from anywhere in it.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(learn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().where("toxic in (0, 1)").collect()}
    h, parts = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), []
    for kind, most in ((1, positive), (0, negative)):
        within = min(1 << 30, int((1 << 30) * (1.3 * most + 50) / max(1, counts.get(kind, 0))) + 1)
        parts.append(known.where((F.col("toxic") == kind) & (h < within)).limit(2 * most))
    ids = parts[0].unionByName(parts[1])  # at most 2 * (positive + negative) rows
    at = F.greatest(F.lit(1), F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - window)).cast("int"))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.substring(F.col("text"), at, F.lit(window)).alias("text"), "lang")
    one = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("m"))
    got = one.select("toxic", "m.text", "m.lang", F.xxhash64("doc_id").alias("h")).collect()
    got.sort(key=lambda r: (r["toxic"], r["h"], r["text"]))
    chosen = [r for kind, most in ((1, positive), (0, negative)) for r in [x for x in got if x["toxic"] == kind][:most]]
    taken = sum(r["toxic"] == 0 for r in chosen)
    share = counts.get(1, 0) / max(1, sum(r["toxic"] == 1 for r in chosen))
    weight = counts.get(0, 0) / max(1, taken) / max(share, 1e-9) if taken and share else 1.0
    return [r["text"] for r in chosen], [r["toxic"] for r in chosen], [r["lang"] for r in chosen], weight


def known_labels(labels: DataFrame, learn: Column) -> DataFrame:
    known = labels.where("doc_id is not null and toxic is not null").where(learn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return known.where("toxic in (0, 1)")


def word_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(shard, h, toxic, lang, check, slots, ends) of every row of `docs` whose doc_id is in `known`: slots of all its words, and their endings.

    Rows to `check` lie in shards of their own, behind the others; without both kinds on each side there are none. Labels are joined
    to hashes, and come to the texts in the shuffle that deals these to shards: texts are moved once, whatever the size of `known`.
    """

    @F.pandas_udf("slots binary, ends binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        texts, slots, ends = texts.tolist(), [], []
        for a, b in chunks(texts):
            cuts = word_cuts(texts[a], PIECE) if b - a == 1 else None
            parts = [words_of([texts[a][i:j]]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)] if cuts else [words_of(texts[a:b])]
            s = np.concatenate([slots_of(w) for w in parts]).astype("<u2")
            e = np.concatenate([edge(w, 3, True) & np.uint32(ENDINGS - 1) for w in parts]).astype("<u2")
            first = [0, len(e)] if cuts else parts[0].first
            for i, j in zip(first[:-1], first[1:], strict=True):
                slots.append(s[i:j].tobytes())
                ends.append(e[i:j].tobytes())
        return pd.DataFrame({"slots": slots, "ends": ends})

    text_batches(docs.sparkSession)
    rows = docs.where("doc_id is not null").select("doc_id", text_or_empty().alias("t"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    rows = maybe_in(rows, known.select(F.xxhash64("doc_id").alias("k")), F.xxhash64("doc_id"), "__maybe").where("__maybe").drop("__maybe")
    rows = rows.withColumn("h", F.xxhash64("doc_id", "t"))
    labelled = written(rows.select("doc_id", "h").join(known, "doc_id").select("doc_id", "h", "toxic"), "labelled")
    check = F.pmod(F.xxhash64("h", F.lit(2)), F.lit(4)) == 0
    n = {(r["check"], r["toxic"]): r["count"] for r in labelled.groupBy(check.alias("check"), "toxic").count().collect()}
    if any(not n.get((c, k)) for c in (False, True) for k in (0, 1)):
        check = F.lit(False)
        n = {(False, None): sum(n.values())}
    count, more = (max(1, -(-sum(v for (c, _), v in n.items() if c == side) // SHARD)) for side in (False, True))
    place = F.xxhash64("h", F.lit(1))
    shard = F.when(check, count + F.pmod(place, F.lit(more))).otherwise(F.pmod(place, F.lit(count))).cast("int")
    both = rows.withColumn("toxic", F.lit(None).cast("int")).unionByName(labelled, allowMissingColumns=True).withColumns({"shard": shard, "check": check})
    tasks = min(count + more, 2000)
    both = both.withColumn("task", F.floor(F.col("shard").cast("long") * tasks / (count + more)).cast("int")).repartitionById(tasks, F.col("task"))
    both = both.withColumn("toxic", F.max("toxic").over(Window.partitionBy("task", "shard", "h", "doc_id"))).where("t is not null and toxic is not null")
    return written(both.select("shard", "h", "toxic", "lang", "check", of("t").alias("w")).select("shard", "h", "toxic", "lang", "check", "w.slots", "w.ends"), "words", "zstd")


def slots_in(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2").reshape(-1, 3)


def counted(rows: DataFrame, languages: list[str], checked: bool) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts of each kind that are learned from a slot is, and how often an ending is in each language, in all texts."""
    place = {g: i for i, g in enumerate(languages)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, endings = np.zeros((2, SLOTS), np.int64), {}
        for pdf in batches:
            for toxic, lang, check, slots, ends in pdf.itertuples(index=False):
                if not check or checked:
                    seen[toxic][np.unique(slots_in(slots))] += 1
                g = place.get(lang, place.get("", 0))
                if g not in endings:
                    endings[g] = np.zeros(ENDINGS, np.int64)
                endings[g] += np.bincount(np.frombuffer(ends, "<u2"), minlength=ENDINGS)
        for kind, part, n in [("s", i, seen[i]) for i in (0, 1)] + [("e", g, v) for g, v in endings.items()]:
            at = np.flatnonzero(n)
            yield pd.DataFrame({"kind": kind, "part": part, "at": at, "n": n[at]})

    out = rows.select("toxic", "lang", "check", "slots", "ends").mapInPandas(run, "kind string, part int, at int, n long")
    got = out.groupBy("kind", "part", "at").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    seen, endings = np.zeros((2, SLOTS)), np.ones((ENDINGS, len(languages)))
    a, b = got[got["kind"] == "s"], got[got["kind"] == "e"]
    seen[a["part"], a["at"]] = a["n"]
    endings[b["at"], b["part"]] += b["n"]
    return seen, endings


def whole_files(spark: SparkSession) -> dict[str, str | None]:
    """Let a task read one whole file, so that no shard is divided; gives the settings as they were."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, str(1 << 40))
    return before


def trained(shards: DataFrame, m: Model, moved: Moved, balance: float, step: float) -> None:
    """One round over `shards` (shard, toxic, slots), sorted, of which no task holds a part: all go on from `m`, which becomes their mean."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, own, sums, held, shard = np.zeros(SLOTS, np.int64), None, None, [], None
        total_t, total_a = np.zeros((SLOTS, DIM), np.int64), np.zeros(SLOTS, np.int64)
        start = dense(m)
        total_d, total_e, done = [np.zeros(v.shape, np.int64) for v in start], [np.zeros(v.shape, np.int64) for v in start], 0
        fixed = lambda v: np.rint(np.asarray(v, np.float64) * UNIT).astype(np.int64)

        def steps(least: int) -> None:
            while len(held) >= least:
                some = held[:STEP]
                del held[:STEP]
                descend(own, sums, [s for _, s in some], np.array([t for t, _ in some], np.float32), balance, step)

        def finish() -> None:
            nonlocal done
            steps(1)
            at = np.flatnonzero(sums.table != moved.table)
            n[at] += 1
            total_t[at] += fixed(own.table[at].astype(np.float64) - m.table[at])
            total_a[at] += fixed(sums.table[at] - moved.table[at])
            for i, (a, b, c, d) in enumerate(zip(dense(own), start, sums.rest, moved.rest, strict=True)):
                total_d[i] += fixed(a.astype(np.float64) - b)
                total_e[i] += fixed(c - d)
            done += 1

        for pdf in batches:
            for where, toxic, raw in pdf.itertuples(index=False):
                if where != shard:
                    if own is not None:
                        finish()
                    shard, own, sums = where, deepcopy(m), deepcopy(moved)
                held.append((toxic, slots_in(raw)))
                steps(STEP)
        if own is not None:
            finish()
            at = np.flatnonzero(n)
            yield pd.DataFrame({"at": at, "n": n[at], "a": total_a[at]} | {f"v{i}": total_t[at, i] for i in range(DIM)})
            flat, acc = (np.concatenate([v.ravel() for v in t]) for t in (total_d, total_e))
            yield pd.DataFrame({"at": SLOTS + np.arange(len(flat)), "n": done, "a": acc, "v0": flat} | {f"v{i}": 0 for i in range(1, DIM)})

    values = ["a", *(f"v{i}" for i in range(DIM))]
    out = shards.select("shard", "toxic", "slots").mapInPandas(run, "at int, n long, " + ", ".join(f"{v} long" for v in values))
    # a shard moves a weight by less than 16, so 2^23 shards fit into a long; squared gradients have no such bound
    mean = [(F.sum(F.col(v).cast("decimal(38,0)") if v == "a" else v).cast("double") / F.sum("n")).alias(v) for v in values]
    got = out.groupBy("at").agg(*mean).toArrow().to_pandas().sort_values("at")
    slot, rest = got[got["at"] < SLOTS], got[got["at"] >= SLOTS]
    at = slot["at"].to_numpy()
    m.table[at] += (slot[values[1:]].to_numpy() / UNIT).astype(np.float32)
    moved.table[at] += slot["a"].to_numpy() / UNIT
    parts, begin = [], 0
    for i, v in enumerate(dense(m)):
        end = begin + v.size
        parts.append(v + (rest["v0"].to_numpy()[begin:end] / UNIT).reshape(v.shape))
        moved.rest[i] = moved.rest[i] + (rest["a"].to_numpy()[begin:end] / UNIT).reshape(v.shape)
        begin = end
    put(m, parts)


def calibrated(rows: DataFrame, m: Model) -> None:
    """Thresholds from the scores of all `rows` (toxic, slots, ends), counted in bins of 1/1024."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = np.concatenate([joined(peaks([slots_in(r) for r in pdf["slots"][a : a + STEP]], m)[0], m) for a in range(0, len(pdf), STEP)]) if len(pdf) else np.zeros(0)
            lang = [int(m.endings[np.frombuffer(e, "<u2")].sum(axis=0, dtype=np.float64).argmax()) for e in pdf["ends"]]
            yield pd.DataFrame({"lang": lang, "bin": np.floor(np.clip(s, -1000, 1000) * BINS).astype(np.int64), "toxic": pdf["toxic"].to_numpy()})

    out = rows.select("toxic", "slots", "ends").mapInPandas(run, "lang int, bin long, toxic int")
    got = out.groupBy("lang", "bin", "toxic").count().toArrow().to_pandas().sort_values(["lang", "bin", "toxic"])
    n = got["count"].to_numpy().astype(np.float64)
    set_thresholds(m, (got["bin"].to_numpy() + 0.5) / BINS, got["lang"].to_numpy(), got["toxic"].to_numpy(), n, n)


def learned(docs: DataFrame, labels: DataFrame, learn: Column, rounds: int = 5, rate: float = 0.05, seed: int = 11) -> Model:
    """The model of all rows of `docs` with a label that satisfies `learn` (over doc_id): nothing is sampled or cut.

    Languages with fewer than 15 labelled texts of either kind, which can't have a threshold of their own, count as one.
    """
    spark = docs.sparkSession
    rows = word_rows(docs, written(known_labels(labels, learn), "labels"))
    m = blank(np.random.default_rng(seed))
    n = {(r["check"], r["toxic"]): r["count"] for r in rows.groupBy("check", "toxic").count().collect()}
    kinds = [F.sum((F.col("toxic") == k).cast("long")) for k in (0, 1)]
    m.languages = sorted({"", *(r["lang"] for r in rows.groupBy("lang").agg(*[k.alias(f"n{i}") for i, k in enumerate(kinds)]).where(f"n0 >= {LEAST} and n1 >= {LEAST}").select("lang").collect())})
    # without both kinds on each side, all rows are learned from and no threshold is set
    checked = any(not n.get((c, k)) for c in (False, True) for k in (0, 1))
    n0, n1 = (n.get((False, k), 0) + (n.get((True, k), 0) if checked else 0) for k in (0, 1))
    seen, endings = counted(rows, m.languages, checked)
    m.endings, m.thresholds = np.log(endings / endings.sum(axis=0)), np.zeros(len(m.languages))
    if not n0 or not n1:
        return constant(m, n1 > 0)
    moved = primed(m, seen, n0, n1)
    shards = rows if checked else rows.where("not check")
    before = whole_files(spark)
    try:
        for turn in range(rounds):
            trained(shards, m, moved, n0 / n1, rate / (1 + turn / 4))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    if not checked:
        calibrated(rows.where("check"), m)
    return m


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): doc_id, held_out, score, predicted.

    Learned from all `labels` (doc_id, toxic) of documents whose crc32(doc_id as text) mod `folds` is not `held`, and from whole texts;
    a document with several labels counts as toxic if one of them is. Null and empty texts get the score of
    a text without words. Without labels of both kinds, all texts get the same score. Repeated rows give
    repeated results; an empty table gives none; other columns are ignored.
    """
    fold = F.pmod(crc32_of_id(), F.lit(folds))
    m = learned(docs, labels, fold != held)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(texts.tolist(), m))

    text_batches(docs.sparkSession)
    out = docs.select("doc_id", (fold == held).alias("held_out"), scored(text_or_empty()).alias("score"))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
