import hashlib
import random
from collections import Counter

import numpy as np

from symgraph.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, row string, spans string, key string, t string"


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of each text, from the definition."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((len(d), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, n=80):
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(30, 90))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [" ".join(word() for _ in range(rng.randint(0, 40))), p[a : a + rng.randint(100, 400)] if rng.random() < 0.6 else ""]
        texts.append(" ".join(parts))
    for _ in range(10):
        t = list(rng.choice(texts))
        if t:
            t[rng.randrange(len(t))] = "Z"
        texts.append("".join(t))
    return texts + ["", "x" * 199, "x" * 450, "ab" * 400, "abc " * 300, texts[1], texts[1], texts[2]]


def test_refined_matches_plain():
    rng = random.Random(1)
    for length in (8, 13, 16, 40, 200):
        data = "".join(rng.choices("ab", k=900)) + "ab" * 200 + "".join(rng.choices("abc", k=900))
        data += data[300 : 300 + 2 * length]
        raw = data.encode()
        starts = np.array([i for i in range(len(raw) - length + 1) if i % 3])
        seen = Counter(raw[i : i + length] for i in starts)
        assert S.refined(np.frombuffer(raw, np.uint8), starts, length).tolist() == [seen[raw[i : i + length]] > 1 for i in starts]


def test_anchors_cover_each_string_once(monkeypatch):
    rng = random.Random(2)
    texts = [t.encode() for t in corpus(rng, 20)]
    for piece in (1 << 19, 700):
        monkeypatch.setattr(S, "PIECE", piece)
        got = Counter()
        for i, at, lo, hi, _ in S.anchors(texts):
            for p, a, b in zip(at, lo, hi, strict=True):
                assert a <= p <= a + 100 and b <= p <= b + 100
                got.update((i, s) for s in range(a, b + 1))
        assert got == Counter((i, s) for i, t in enumerate(texts) for s in range(len(t) - 199))


def test_matches_brute_force(spark):
    rng = random.Random(4)
    texts = corpus(rng)
    rows = [(i * 7 % 997, t, "clash", None, "k", "t") for i, t in enumerate(texts)] + [(None, None, None, None, None, None), (None, texts[5], None, None, None, None), (0, texts[0], "x", None, None, None), (5000, "long " * 30_000, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = sorted(str((r[0], *x)) for r, x in zip(rows, plain([r[1] for r in rows], 200), strict=True))
    for large in (20_000, 3):
        got = S.suffix_dedup(df, large=large).collect()
        assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want


def test_great_ids_beside_a_null_stay_whole(spark):
    rng = random.Random(14)
    shared = "".join(rng.choices("abcdef ", k=400))
    texts = [shared + " one", "two " + shared, None, "three", shared + shared, "", "four"]
    ids = [(1 << 60) + 1, (1 << 60) + 3, None, (1 << 60) + 5, None, (1 << 60) + 7, -(1 << 62) - 1]
    df = spark.createDataFrame([(d, t, None, None, None, None) for d, t in zip(ids, texts, strict=True)], SCHEMA).coalesce(1)
    want = sorted(str((d, *x)) for d, x in zip(ids, plain(texts, 200), strict=True))
    got = S.suffix_dedup(df).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want


def test_empty(spark):
    assert S.suffix_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
