"""Language identification with a linear-chain conditional random field over words.

Each word gets a score for each language from its affixes, its character n-grams and a learned lexicon;
learned transitions tie neighbours, and forward-backward gives every word's posterior, so a text that
changes language is labelled word by word. A document's language is that of the greatest share of words.

The model is fitted in numpy on a bounded sample of labelled rows: `per_language` texts of each of the `languages` most
frequent languages, whole or, of texts longer than that, a window of `window` characters from anywhere in the text; it
sees spliced texts of several languages, so transitions are learned too.
Prediction reads whole texts. Forward-backward runs on segments of `SEGMENT` words, all at once: first each
segment's product of matrices, then along each document from segment to segment, then within segments; the
result is that of the plain recursion.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of_id, text_batches, text_or_empty
from .words import M, Words, chunks, edge, mixed, whole, word_cuts, words_of

SLOTS, SEGMENT, PER_LANGUAGE, LANGUAGES, WINDOW, PIECE, UNKNOWN = 1 << 16, 64, 300, 400, 3000, 1 << 20, "und"


@dataclass
class Model:
    """`weights`: a row for each hashed feature; `trans`: scores from language to language; `lexicon`: known words' slots."""

    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray
    lexicon: np.ndarray


def grams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the bigrams and trigrams that end at each letter or just after a word, and where each word's begin."""
    c = w.codes
    used = c > 0
    used[w.ends] = True
    at = np.flatnonzero(used)
    a, b, d = c[at - 2], c[at - 1], c[at]
    a = np.where(b == 0, np.uint32(0), a)
    two = mixed(b * M[0] + d * M[1] + np.uint32(7), 11) & np.uint32(SLOTS - 1)
    three = mixed(a * M[3] + b * M[0] + d * M[1] + np.uint32(9), 12) & np.uint32(SLOTS - 1)
    return two, three, np.searchsorted(at, w.starts)


def word_slots(w: Words, lexicon: np.ndarray) -> list[np.ndarray]:
    """Slots of the affixes and of the word itself; slot SLOTS, which has no weight, for words outside the lexicon."""
    affixes = [edge(w, n, s) & np.uint32(SLOTS - 1) for n in (1, 2, 3) for s in (False, True)]
    h = whole(w) & np.uint32(SLOTS - 1)
    return [*affixes, np.where(lexicon[h], h, np.uint32(SLOTS))]


def emissions(w: Words, m: Model) -> np.ndarray:
    if not len(w.starts):
        return np.zeros((0, len(m.labels)), np.float32)
    two, three, begin = grams(w)
    inside = m.weights[two]
    inside += m.weights[three]
    scores = np.add.reduceat(inside, begin, axis=0)
    scores /= np.sqrt(w.ends - w.starts + 1).astype(np.float32)[:, None]
    for s in word_slots(w, m.lexicon):
        scores += m.weights[s]
    return scores


def posteriors(scores: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's posterior over labels, and the expected transition counts, by forward-backward.

    `first`: where each document's words begin, and the end. Exact for any length. Transitions are from word to word:
    the first of a document has none.
    """
    n, labels = scores.shape
    expected = np.zeros((labels, labels))
    if not n:
        return scores, expected
    step = np.exp(trans - trans.max()).astype(np.float32)
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) + np.float32(1e-9)
    sizes = np.diff(first)
    docs = np.flatnonzero(sizes)
    per_doc = -(-sizes[docs] // SEGMENT)
    base = np.concatenate(([0], np.cumsum(per_doc)))
    doc = np.repeat(np.arange(len(docs)), per_doc)
    number = np.arange(base[-1]) - base[doc]
    start = first[docs][doc] + number * SEGMENT
    size = np.minimum(SEGMENT, first[docs + 1][doc] - start)
    order = np.argsort(-size, kind="stable")
    opening = (number == 0)[order][:, None]
    start_o, alive = start[order], [int(k) for k in np.searchsorted(-size[order], -np.arange(1, SEGMENT + 1), side="right")]
    product = np.broadcast_to(np.eye(labels, dtype=np.float32), (len(order), labels, labels)).copy()
    for t, k in enumerate(alive):
        if not k:
            break
        p = (product[:k].reshape(-1, labels) @ step).reshape(k, labels, labels)
        if not t:
            p = np.where(opening[:k, :, None], product[:k], p)
        p = p * e[start_o[:k] + t][:, None, :]
        product[:k] = p / p.sum(axis=(1, 2), keepdims=True)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    long_first = np.argsort(-per_doc, kind="stable")
    entering, leaving = np.empty((len(order), labels), np.float32), np.empty((len(order), labels), np.float32)
    many = [int(k) for k in np.searchsorted(-per_doc[long_first], -np.arange(1, int(per_doc.max()) + 1), side="right")]
    state = np.full((len(docs), labels), 1 / labels, np.float32)
    for j, k in enumerate(many):
        seg = place[base[long_first[:k]] + j]
        entering[seg] = state[:k]
        s = np.einsum("ki,kij->kj", state[:k], product[seg])
        state[:k] = s / s.sum(axis=1, keepdims=True)
    state = np.full((len(docs), labels), 1 / labels, np.float32)
    for j in range(len(many) - 1, -1, -1):
        k = many[j]
        seg = place[base[long_first[:k]] + j]
        leaving[seg] = state[:k]
        s = np.einsum("kij,kj->ki", product[seg], state[:k])
        state[:k] = s / s.sum(axis=1, keepdims=True)
    before = np.empty_like(e)
    state = entering
    for t, k in enumerate(alive):
        if not k:
            break
        at = start_o[:k] + t
        ahead = state[:k] @ step
        if not t:
            ahead = np.where(opening[:k], state[:k], ahead)
        before[at] = ahead
        s = ahead * e[at]
        state[:k] = s / s.sum(axis=1, keepdims=True)
    gamma = np.empty_like(e)
    state = leaving
    for t in range(SEGMENT - 1, -1, -1):
        k = alive[t]
        if not k:
            continue
        at = start_o[:k] + t
        g = before[at] * e[at] * state[:k]
        gamma[at] = g / g.sum(axis=1, keepdims=True)
        s = (e[at] * state[:k]) @ step.T
        state[:k] = s / s.sum(axis=1, keepdims=True)
    inner = np.ones(n, bool)
    inner[first[:-1][sizes > 0]] = False
    at = np.flatnonzero(inner)
    # the posterior of a pair, from the forward message of the first and what the second's posterior adds
    ratio = gamma[at] / np.maximum(before[at], 1e-20)
    alpha = before[at - 1] * e[at - 1]
    alpha /= alpha.sum(axis=1, keepdims=True)
    pair = alpha[:, :, None] * step[None] * ratio[:, None, :]
    pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-20)
    return gamma, expected + pair.sum(axis=0)


def spliced(texts: list[str], langs: list[str], rng: np.random.Generator) -> list[list[tuple[str, str]]]:
    """Each text whole, and as many made of pieces of several."""
    out = [[(t, g)] for t, g in zip(texts, langs, strict=True)]
    cut = [t.split() for t in texts]
    for _ in texts:
        parts = []
        for _ in range(int(rng.integers(2, 7))):
            i = int(rng.integers(len(texts)))
            if cut[i]:
                at = int(rng.integers(len(cut[i])))
                parts.append((" ".join(cut[i][at : at + int(rng.integers(3, 30))]), langs[i]))
        out.append(parts)
    return out


def fit(texts: list[str], langs: list[str], rounds: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Adaptive gradient ascent on the conditional log-likelihood of the words' labels."""
    rng, labels = np.random.default_rng(seed), sorted(set(langs)) or [UNKNOWN]
    at = {g: i for i, g in enumerate(labels)}
    h = whole(words_of(texts)) & np.uint32(SLOTS - 1)
    lexicon = np.append(np.bincount(h, minlength=SLOTS) >= 3, False)
    m = Model(labels, np.zeros((SLOTS + 1, len(labels)), np.float32), np.zeros((len(labels), len(labels)), np.float32), lexicon)
    seqs = spliced(texts, langs, rng)
    w_sum, t_sum = np.full_like(m.weights, 1e-3), np.full_like(m.trans, 1e-3)
    for _ in range(rounds):
        for batch in np.array_split(rng.permutation(len(seqs)), max(1, len(seqs) // 40)):
            w = words_of([" ".join(t for t, _ in seqs[i]) for i in batch])
            gold = np.concatenate([np.full(len(words_of([t]).starts), at[g]) for i in batch for t, g in seqs[i]] or [[]]).astype(np.int64)
            if not len(gold):
                continue
            gamma, expected = posteriors(emissions(w, m), w.first, m.trans)
            error = -gamma
            error[np.arange(len(gold)), gold] += 1
            two, three, begin = grams(w)
            scaled = error / np.sqrt(w.ends - w.starts + 1).astype(np.float32)[:, None]
            owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(two))))
            slots = np.concatenate([two, three, *word_slots(w, lexicon)])
            rows = np.concatenate([scaled[owner], scaled[owner], *[error] * 7])
            grad = np.stack([np.bincount(slots, rows[:, j], SLOTS + 1) for j in range(len(labels))], axis=1) / len(gold) * 40
            grad -= 1e-4 * m.weights
            grad[SLOTS] = 0
            w_sum += grad**2
            m.weights += (rate * grad / np.sqrt(w_sum)).astype(np.float32)
            inner = np.ones(len(gold), bool)
            inner[w.first[:-1][np.diff(w.first) > 0]] = False
            j = np.flatnonzero(inner)
            seen = np.bincount(gold[j - 1] * len(labels) + gold[j], minlength=len(labels) ** 2).reshape(m.trans.shape)
            grad = (seen - expected) / max(1, len(j)) * 10 - 1e-3 * m.trans
            t_sum += grad**2
            m.trans += (rate / 3 * grad / np.sqrt(t_sum)).astype(np.float32)
    return m


def label_words(texts: list[str], m: Model) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where each text's words begin, and the end, and the words' posteriors, a run of texts at a time. Very long texts are
    scored piece by piece, so that memory holds a few numbers a word of them, but decoded whole."""
    for a, b in chunks(texts):
        if b - a == 1 and len(texts[a]) > PIECE:
            cuts = word_cuts(texts[a], PIECE)
            scores = np.concatenate([emissions(words_of([texts[a][i:j]]), m) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
            first = np.array([0, len(scores)])
        else:
            w = words_of(texts[a:b])
            scores, first = emissions(w, m), w.first
        yield first, posteriors(scores, first, m.trans)[0]


def sample(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, window: int = WINDOW, languages: int = LANGUAGES) -> tuple[list[str], list[str]]:
    """At most `per_language` labelled texts of each of the `languages` most frequent languages; of a text of more than
    `window` characters a window of as many, from anywhere in it. That bounds what comes to the driver."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return [], []
    h = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30))
    limit = F.create_map(*[F.lit(x) for g, c in counts.items() for x in (g, min(1 << 30, int((1 << 30) * (1.3 * per_language + 50) / c) + 1))])
    at = F.greatest(F.lit(1), F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - window)).cast("int"))
    some = rows.where(h < F.try_element_at(limit, F.col("lang"))).select("lang", F.substring("text", at, F.lit(window)).alias("t"), h.alias("h"))
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("nth") <= per_language)
    got = sorted(some.collect(), key=lambda r: (r["lang"], r["nth"]))
    return [r["t"] for r in got], [r["lang"] for r in got]


def labelled(m: Model):
    """A UDF from a text to (lang_pred, score, n_words, n_switches), see `predict`. Marked as not deterministic so
    that a filter on it does not make Spark run it twice."""

    @F.pandas_udf("lang_pred string, score double, n_words long, n_switches long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = [pd.DataFrame({"lang_pred": [], "score": [], "n_words": [], "n_switches": []})] if not len(texts) else []
            for first, gamma in label_words(texts.tolist(), m):
                best = gamma.argmax(axis=1)
                switch = np.concatenate(([0], np.cumsum(np.concatenate(([0], best[1:] != best[:-1])))))
                total = np.concatenate((np.zeros((1, gamma.shape[1])), np.cumsum(gamma, axis=0, dtype=np.float64)))
                a, b = first[:-1], first[1:]
                share = (total[b] - total[a]) / np.maximum(b - a, 1)[:, None]
                some = b > a
                changes = np.where(some, switch[b] - switch[np.minimum(a + 1, b)], 0)
                out.append(pd.DataFrame({
                    "lang_pred": np.where(some, np.array(m.labels, object)[share.argmax(axis=1)], UNKNOWN),
                    "score": np.where(some, share.max(axis=1).clip(0, 1), 0.0), "n_words": b - a, "n_switches": changes,
                }))
            yield pd.concat(out, ignore_index=True)

    return run.asNondeterministic()


def predict(docs: DataFrame, m: Model, *keep: Column) -> DataFrame:
    """`keep` columns of each row, then lang_pred, score, n_words, n_switches.

    A null text or one without letters is `und` with score 0. score: the mean posterior of the language over
    the text's words. n_switches: neighbouring words whose likeliest languages differ.
    """
    text_batches(docs.sparkSession)
    return docs.select(*keep, labelled(m)(text_or_empty()).alias("__l")).select("*", "__l.*").drop("__l")


def in_language(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """`docs` (doc_id, text, lang, any other columns) without texts that have no language: those without letters and
    those of which no language holds a share of `least`. `lang` becomes the predicted one.

    The model is learned from the rows that have a language; where none has one, only texts without letters go.
    Null and empty texts go; repeated rows share their fate; an empty table gives no rows.
    """
    m = fit(*sample(docs, F.lit(True)))
    text_batches(docs.sparkSession)
    rows = docs.withColumn("__l", labelled(m)(text_or_empty()))
    rows = rows.where((F.col("__l.n_words") > 0) & (F.col("__l.score") >= least))
    return rows.select(*[F.col("__l.lang_pred").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): doc_id, held_out, lang_pred, score, n_words, n_switches.

    Learned from rows with a language whose crc32(doc_id as text) mod `folds` is not `held` (a null doc_id
    counts as the empty text); with no such rows every text with letters gets `und`. Repeated rows give
    repeated results; an empty table gives none; other columns are ignored.
    """
    fold = F.pmod(crc32_of_id(), F.lit(folds))
    m = fit(*sample(docs, fold != held))
    return predict(docs, m, F.col("doc_id"), (fold == held).alias("held_out"))


def fold_of(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds
