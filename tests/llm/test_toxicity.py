import os
import random
import zlib

import numpy as np

from symgraph.llm import toxicity as T
from symgraph.llm.words import words_of

SCHEMA, LABELS = "doc_id long, text string, lang string, toxic string", "doc_id long, quality int, toxic int"


def corpus(n, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(rng.randint(2, 60))]
        bad = i % 4 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["zork", "quux", "vrrmpling", "vrrmpsome"]))
        rows.append((i, " ".join(words), "en", "clash"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_pooled_convolution_matches_the_plain_one():
    rng = np.random.default_rng(1)
    m = T.fit(["a b", "c d e", "x", "zork y"] * 4, [0, 0, 0, 1] * 4, ["en"] * 16, rounds=1)
    texts = ["", "one", "one two", "a b c d e f g", "12 !"]
    w = words_of(texts)
    got = T.raw_scores(w, m)
    for i, t in enumerate(texts):
        own = words_of([t])
        s = T.slots_of(own) if len(own.starts) else np.zeros((0, 3), int)
        x = np.concatenate([m.table[s].sum(axis=1), np.zeros((3, T.DIM), "f4")])
        tops = []
        for k, (f, b) in enumerate(zip(m.filters, m.bias, strict=True)):
            tops.append(np.max([sum(x[p + j] @ f[j] for j in range(len(f))) + m.bias[k] for p in range(max(1, len(s)))], axis=0))
        assert abs(np.maximum(np.concatenate(tops), 0) @ m.out + m.out_bias - got[i]) < 1e-3
    assert rng is not None


def test_very_long_texts_score_as_whole(monkeypatch):
    rows, labels = corpus(300)
    m = T.fit([r[1] for r in rows], [x[2] for x in labels], ["en"] * 300)
    texts = [" ".join(r[1] for r in rows[a : a + 7]) + " ." * 60 for a in range(0, 60, 7)] + ["zork", "", "a" * 500, ". " * 200]
    want = T.score_texts(texts, m)
    for piece in (20, 57, 300):
        monkeypatch.setattr(T, "PIECE", piece)
        monkeypatch.setattr(T, "chunks", lambda ts: [(i, i + 1) for i in range(len(ts))])
        assert np.abs(T.score_texts(texts, m) - want).max() < 1e-4


def test_samples_are_bounded(spark):
    rows = [(7, f"same {i}", "en", None) for i in range(400)] + [(i, "x" * 30_000, "en", None) for i in range(10, 40)]
    labels = [(7, 1, 1)] + [(i, 1, i % 2) for i in range(10, 40)]
    texts, toxic, _, _ = T.sample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS), T.F.lit(True), positive=6, negative=4)
    assert toxic.count(1) == 6 and toxic.count(0) == 4 and max(map(len, texts)) <= T.WINDOW


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus(1200)
    rows += [(None, None, None, None), (5000, "", "en", None), (5001, "clean " * 50_000 + "zork", "en", None), (4, rows[4][1], "en", "clash")]
    labels += [(4, 1, 1), (None, None, 1), (77777, 0, None)]
    out = T.score(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert {r.predicted for r in out if r.doc_id == 5001} == {1} and {r.predicted for r in out if r.doc_id in (None, 5000)} == {0}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert T.score(*empty).collect() == []
    assert [r.predicted for r in T.score(spark.createDataFrame([(1, "a", None, None)], SCHEMA), empty[1]).collect()] == [0]


def test_all_labelled_rows_and_whole_texts_are_learned_from(spark, monkeypatch):
    """Counts, training and thresholds cover every labelled row, more than any sample held; how tasks are dealt does not matter."""
    rows, labels = corpus(6000)
    rows = [(i, t if i else t + " filler" * 9000, g, c) for i, t, g, c in rows]
    own = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    primed, calibrated, seen, checked = T.primed, T.set_thresholds, [], []
    monkeypatch.setattr(T, "SHARD", 1000)
    monkeypatch.setattr(T, "primed", lambda m, s, n0, n1: seen.append((s, n0, n1)) or primed(m, s, n0, n1))
    monkeypatch.setattr(T, "set_thresholds", lambda m, *a: checked.append(a[-1].sum()) or calibrated(m, *a))
    models = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        models.append(T.learned(docs, spark.createDataFrame(labels, LABELS), T.F.pmod(T.crc32_of_id(), T.F.lit(5)) != 0))
    assert seen[0][1] + seen[0][2] + checked[0] == len(own) > 4500 and checked[0] > 1000
    at = T.slots_of(words_of(["zork"]))[0, 0]
    found = sum("zork" in r[1].split() for r in own)
    assert 0.6 * found < seen[0][0][:, at].sum() < 0.9 * found
    a, b = models
    assert (a.table == b.table).all() and (a.out == b.out).all() and (a.thresholds == b.thresholds).all() and all((f == g).all() for f, g in zip(a.filters, b.filters, strict=True))
    p = T.score_texts([r[1] for r in rows], a) >= 0.5
    assert np.mean(p == np.array([x[2] for x in labels])) > 0.95


def test_words_of_a_long_text_are_all_counted(spark):
    known = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "one " * 30_000 + "last", "en"), (1, "two", "en"), (2, None, None), (3, "x", "en")], "doc_id long, text string, lang string")
    got = T.word_rows(docs, known).collect()
    assert sorted(len(T.slots_in(r.slots)) for r in got) == [0, 1, 30_001]
    seen, endings = T.counted(T.word_rows(docs, known), [""], True)
    assert seen[1][np.unique(T.slots_of(words_of(["last"])))].min() >= 1 and endings.sum() == T.ENDINGS + 30_002


def test_peaks_by_pieces_are_those_of_the_whole(monkeypatch):
    rows, labels = corpus(120)
    m = T.fit([r[1] for r in rows], [x[2] for x in labels], ["en"] * 120)
    texts = ["", "zork", *(" ".join(r[1] for r in rows[a : a + 5]) for a in range(0, 60, 5))]
    docs = [T.slots_of(words_of([t])) for t in texts]
    want = T.tops(words_of(texts), m)
    for together in (1 << 16, 90, 7):
        monkeypatch.setattr(T, "TOGETHER", together)
        top, where = T.peaks(docs, m)
        assert np.abs(top - want).max() < 1e-4 and all((where[i] < max(1, len(d))).all() for i, d in enumerate(docs))


def test_texts_are_moved_and_kept_once_whatever_the_size_of_labels(spark, monkeypatch):
    """Without a broadcast of labels, as where they are many, no more is shuffled than with it: the texts, once; and one table holds their words."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=1500)), "en", None) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).localCheckpoint()
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], LABELS).localCheckpoint()
    tables, keep = [], T.written
    monkeypatch.setattr(T, "written", lambda *a: tables.append(keep(*a)) or tables[-1])
    monkeypatch.setattr(T, "trained", lambda *a: None)
    sc, moved = spark.sparkContext._jsc.sc(), []
    for most in ("-1", "10485760"):
        monkeypatch.setattr(T, "counted", lambda rows, languages, checked: (np.zeros((2, T.SLOTS)), np.ones((T.ENDINGS, len(languages)))))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        sc.listenerBus().waitUntilEmpty()
        before = sc.statusStore().executorSummary("driver").totalShuffleWrite()
        T.learned(docs, labels, T.F.lit(True))
        sc.listenerBus().waitUntilEmpty()
        moved.append(sc.statusStore().executorSummary("driver").totalShuffleWrite() - before)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kept = sum(os.path.getsize(f.removeprefix("file:")) for t in tables for f in t.inputFiles()) / 2
    size = sum(len(r[1]) for r in rows)
    assert moved[0] < 1.05 * moved[1] + 10_000 and moved[0] < size and kept < 1.2 * size, (moved, kept, size)


def test_shards_are_whole_and_apart_from_what_is_checked(spark, monkeypatch):
    rows, labels = corpus(900)
    rows += [rows[8], rows[8], (9, "another", "de", None), (None, "zork", "en", None), (5000, "no label", "en", None)]
    monkeypatch.setattr(T, "SHARD", 100)
    docs, known = spark.createDataFrame(rows, SCHEMA).repartition(6), spark.createDataFrame([(i, t) for i, _, t in labels], "doc_id long, toxic int")
    got = T.word_rows(docs, known).withColumn("file", T.F.input_file_name()).collect()
    assert len(got) == 903 and sum(r.toxic for r in got) == sum(x[2] for x in labels) + 2
    assert sorted(r.slots for r in got) == sorted(T.slots_of(words_of([t])).astype("<u2").tobytes() for i, t, _, _ in rows if i is not None and i < 5000)
    assert len({(r.shard, r.file) for r in got}) == len({r.shard for r in got}) > 8
    assert max(r.shard for r in got if not r.check) < min(r.shard for r in got if r.check)
    order = [(r.shard, r.h) for f in sorted({r.file for r in got}) for r in got if r.file == f]
    assert all(a <= b for a, b in zip(order[:-1], order[1:], strict=True) if a[0] == b[0])
