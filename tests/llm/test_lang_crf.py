import random

import numpy as np

from symgraph.llm import lang_crf as L

SCHEMA = "doc_id long, text string, lang string, score string"
WORDS = {"aa": "bala kala mala tala sala dala".split(), "zz": "xyzo qyzo vyzo wyzo zyzo ryzo".split()}


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[g], k=rng.randint(3, 40))), g, "clash") for i in range(n) for g in [rng.choice(sorted(WORDS))]]


def plain(scores, trans):
    """Forward-backward for one sequence, step by step."""
    a, e = np.exp(trans - trans.max()), np.exp(scores - scores.max(1, keepdims=True)) + 1e-9
    n, k = scores.shape
    alpha, beta, s = np.zeros((n, k)), np.ones((n, k)), np.full(k, 1 / k)
    for t in range(n):
        s = (s @ a if t else s) * e[t]
        s = alpha[t] = s / s.sum()
    for t in range(n - 2, -1, -1):
        beta[t] = a @ (e[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    g = alpha * beta
    pairs = sum((p / p.sum() for t in range(1, n) for p in [alpha[t - 1][:, None] * a * (e[t] * beta[t])]), np.zeros((k, k)))
    return g / g.sum(1, keepdims=True), pairs


def test_posteriors_match_the_plain_recursion():
    rng = np.random.default_rng(0)
    first = np.array([0, 0, 1, 64, 65, 300, 300])
    scores, trans = rng.normal(size=(300, 3)).astype("f4"), rng.normal(size=(3, 3)).astype("f4")
    gamma, expected = L.posteriors(scores, first, trans)
    found = [plain(scores[a:b], trans) for a, b in zip(first[:-1], first[1:], strict=True) if b > a]
    assert np.abs(gamma - np.concatenate([g for g, _ in found])).max() < 1e-4
    assert np.abs(expected - sum(p for _, p in found)).max() < 1e-2


def test_code_switched_words_are_labelled():
    rows = corpus(200)
    m = L.fit([r[1] for r in rows], [r[2] for r in rows])
    (_, gamma), = L.label_words(["bala kala mala tala sala dala kala xyzo qyzo vyzo wyzo zyzo ryzo xyzo"], m)
    assert [m.labels[i] for i in gamma.argmax(1)] == ["aa"] * 7 + ["zz"] * 7


def test_very_long_texts_are_labelled_as_whole(monkeypatch):
    rows = corpus(100)
    m = L.fit([r[1] for r in rows], [r[2] for r in rows])
    text = " ".join(r[1] for r in rows) + " 1, " + "bala" * 40
    ((first, want),) = L.label_words([text], m)
    monkeypatch.setattr(L, "PIECE", 100)
    monkeypatch.setattr(L, "chunks", lambda ts: [(i, i + 1) for i in range(len(ts))])
    (got,) = [g for f, g in L.label_words([text], m) if f.tolist() == first.tolist()]
    assert np.abs(got - want).max() < 1e-4


def test_samples_are_bounded(spark):
    rows = [(7, "same" + "x" * (i % 50), "aa", None) for i in range(500)] + [(i, f"text {i}", f"l{i % 9}", None) for i in range(90)]
    texts, langs = L.sample(spark.createDataFrame(rows, SCHEMA), L.F.lit(True), per_language=5, languages=4)
    assert {g: langs.count(g) for g in langs} == {"aa": 5, "l0": 5, "l1": 5, "l2": 5} and len(texts) == 20


def test_identify(spark):
    rows = corpus(300) + [(None, None, None, None), (900, "", "aa", None), (901, "12 34 !!", "aa", None), (902, "bala kala " * 30_000, None, "x"), (3, "bala", "aa", "x")]
    out = L.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    assert {r.lang_pred for r in out if r.doc_id in (None, 900, 901)} == {"und"}
    truth = {r[0]: r[2] for r in rows[:300]}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and all(L.fold_of(r.doc_id, 4) == 2 for r in held)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert [r.lang_pred for r in out if r.doc_id == 902] == ["aa"]
    assert all(0 <= r.score <= 1 for r in out)


def test_empty_and_unlabelled(spark):
    assert L.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    (r,) = L.identify(spark.createDataFrame([(1, "bala", None, None)], SCHEMA)).collect()
    assert r.lang_pred == "und"
